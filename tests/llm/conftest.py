from __future__ import annotations

import random

import pytest

WORDS = "the of and to in that is was for it with as on by river stone cloud winter garden paper silver night window music bread".split()


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared lines and passages, nulls, blanks, unicode, repeats and a hot group."""
    r = random.Random(17)
    say = lambda n: " ".join(r.choice(WORDS) + (r.choice(["", "", ",", "."])) for _ in range(n))
    passage, line = say(30), "This very common line of text is found in many documents."
    texts: list[str | None] = [None, "", " \n\t ", "one", "Ünïcödé ñandú — 漢字 ß", "a" * 400, "a" * 49, "a" * 50]
    base = say(120)
    for i in range(40):
        w = base.split()
        for _ in range(r.choice([0, 1, 2, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    for i in range(60):
        t = say(r.randrange(3, 150))
        if i % 3 == 0:
            t += " " + passage
        if i % 4 == 0:
            t += "\n" + line + ("!" if i % 8 == 0 else "") + "\n" + say(8)
        texts.append(t)
    texts += [texts[20], texts[20], texts[60], texts[60], say(20000)]
    return list(enumerate(texts, 100))


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)
