"""Each operator against a brute-force version, and its edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernlake.llm import exact_dedup as exact_module
from quernlake.llm import line_dedup as line_module
from quernlake.llm import near_dedup as near_module
from quernlake.llm import substring_dedup as substring_module
from quernlake.llm import suffix_tree_lm as lm
from quernlake.llm.decontaminate import decontaminate, uncontaminated
from quernlake.llm.exact_dedup import DigestIndex, exact_dedup
from quernlake.llm.language_id import WIDTHS, ByteCnn, identify_language, window_matrix, within_bytes
from quernlake.llm.license_scan import TEMPLATES, known_templates, scan_licenses
from quernlake.llm.line_dedup import dedup_lines, line_dedup
from quernlake.llm.near_dedup import near_dedup
from quernlake.llm.packing import pack, plan
from quernlake.llm.quality import _FOLD, _KIND, FEATURES, PAIRS, PASSAGE, GatedMil, classify_quality, encode_passages
from quernlake.llm.queries import ORACLE, QUERIES, tokenizer_path
from quernlake.llm.substring_dedup import substring_dedup
from quernlake.llm.suffix_sort import suffix_order

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clash(docs):
    """Extra columns under names that the operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("digest", "kept", "block", "held_out", "score", "_gone", "_doc", "_text", "d", "l", "key", "path", "letter", "label", "rank")})


# --- 1


def windows_brute(corpus, length=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in corpus]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, 1 << 62), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[q] and (q == 0 or not gone[q - 1]) for q in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, hot", [(4 << 20, 4096), (6000, 4096), (6000, 3)])
def test_substrings(docs, corpus, monkeypatch, block, hot):
    monkeypatch.setattr(substring_module, "BLOCK_BYTES", block)
    assert rows(substring_dedup(docs, hot=hot)) == windows_brute(corpus)


def test_substrings_edges(spark, docs):
    assert rows(substring_dedup(docs.limit(0))) == []
    same = spark.createDataFrame([(1, "z" * 60), (1, "z" * 60), (1, "z" * 70), (2, "z" * 60), (None, "z" * 60)], "doc_id long, text string")
    assert [r[:4] for r in rows(substring_dedup(clash(same)))] == [(1, 60, 0, 0), (1, 60, 0, 0), (1, 70, 0, 0), (2, 60, 60, 1), (None, 60, 60, 1)]
    kept = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup(same.where("doc_id is not null"), keep_bytes=True).collect()}
    assert kept[2] == b""


def test_suffix_order():
    r = np.random.default_rng(1)
    for trial in range(40):
        n, kinds, depth = int(r.integers(60, 500)), int(r.integers(1, 4)), int(r.choice([8, 16, 24, 33, 50]))
        buf = r.integers(97, 97 + kinds, n).astype(np.uint8)
        if trial % 3 == 0:
            buf = np.tile(buf[: int(r.integers(1, 40))], n)[:n].copy()
        at = np.arange(n - depth + 1)
        order, new = suffix_order(buf, at, depth)
        ws = [bytes(buf[i : i + depth]) for i in at]
        want = sorted(range(len(at)), key=lambda i: (ws[i], i))  # noqa: B023
        assert order.tolist() == want
        assert new.tolist() == [k == 0 or ws[want[k]] != ws[want[k - 1]] for k in range(len(want))]


# --- 2


def test_exact(docs, corpus):
    group = Counter(t or "" for _, t in corpus)
    top = {t or "": i for i, t in corpus}
    want = sorted(((i, top[t or ""], group[t or ""], i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus), key=repr)
    assert rows(exact_dedup(clash(docs), keep="max")) == want
    # a digest that tells nothing apart still gives the groups of equal texts
    assert rows(exact_dedup(docs, keep="max", digest=lambda c: F.lit(b"same"))) == want
    assert rows(exact_dedup(docs.limit(0))) == []


def test_exact_without_ids(spark):
    got = exact_dedup(spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in got if r["doc_id"]) == [(3, 3, True)]
    assert sorted(r["kept"] for r in got if r["doc_id"] is None) == [False, True]


def test_digest_index(spark):
    frame = lambda ids: spark.createDataFrame([(f"{d:08d}".encode(), i) for d, i in ids], "digest binary, doc_id long")
    index = DigestIndex(spark)
    index.insert(frame([(d, d) for d in range(0, 6000)] + [(5, 90001)]))
    old = index.live()[0]
    asked = frame([(d, d) for d in range(5000, 16000)])
    passed = {r["digest"] for r in index.maybe(asked, old).collect()}
    assert {f"{d:08d}".encode() for d in range(5000, 6000)} <= passed and len(passed) < 1000 + 0.1 * 10000
    index.insert(frame([(d, 70000 + d) for d in range(5990, 8000)]))
    assert [len(level) for level in index.levels] == [2]
    index.insert(frame([(7999, 1), (20000, 2)]))
    assert [len(level) for level in index.levels] == [0, 1]
    entries = {int(r["digest"]): (r["keep_id"], r["n"]) for r in index.live()[0].entries.collect()}
    assert len(entries) == 8001 and entries[5] == (5, 2) and entries[5995] == (5995, 2) and entries[7999] == (1, 2) and entries[20000] == (2, 1)
    index.insert(frame([(20000, 3), (30000, 4)]))
    assert [len(level) for level in index.levels] == [1, 1]
    assert {int(r["digest"]) for r in index.hits().collect()} == {5, *range(5990, 6000), 7999, 20000}


def test_exact_needs_filters_and_levels(spark, monkeypatch):
    docs = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "cast(if(id >= 300, id - 300, id) AS string) AS text")  # copies in the first and the last memtable
    merged, size = [], lambda: Counter(r["group_size"] for r in exact_dedup(docs).collect())
    assert size() == {2: 200, 1: 200}
    monkeypatch.setattr(DigestIndex, "_merged", lambda self, runs, own=DigestIndex._merged: merged.append(len(runs)) or own(self, runs))
    monkeypatch.setattr(DigestIndex, "maybe", lambda self, entries, run: entries.select("digest").limit(0))
    assert size() == {1: 400} and merged == [exact_module.FANOUT]


# --- 3 and 5


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_language(clash(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_edges(spark, docs):
    x = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34", "fr"), (4, "hello there", "en"), (None, "bonjour", None), (4, "hello there", "en")], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]) for r in identify_language(x).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got
    assert identify_language(x.limit(0)).collect() == []
    assert {r["lang_pred"] for r in identify_language(x.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = classify_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got) / len(got)
    most = max(Counter(r["quality"] for r in got).values()) / len(got)
    assert right > max(0.75, most)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x y z"), (None, "w"), (3, "x y z"), (4, "long " * 4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (4, None), (9, 1)], "doc_id long, quality int")
    got = classify_quality(clash(docs), labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert classify_quality(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in classify_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_windows_cover_texts():
    texts = [b"", b"ab", bytes(range(1, 200)) * 3, b"x" * 192, b"y" * 193]
    x, owner = window_matrix(texts)
    assert [owner.tolist().count(i) for i in range(5)] == [1, 1, 4, 1, 2]
    for i, t in enumerate(texts):
        own = [bytes(w) for w in x[owner == i]]
        starts = [max(0, min(192 * k, len(t) - 192)) for k in range(len(own))]
        assert [w.rstrip(b"\0") for w in own] == [t[at : at + 192] for at in starts] and starts[-1] + 192 >= len(t)


def _cnn(seed=1, langs=3):
    net = ByteCnn.fresh([str(i) for i in range(langs)], seed)
    r = np.random.default_rng(seed)
    for b in [*net.bias, net.dense_bias]:
        b += r.normal(0, 0.1, b.shape).astype(np.float32)
    return net


def cnn_brute(net, window):
    h = []
    for w, f, b in zip(WIDTHS, net.filters, net.bias):
        at = [sum(net.embed[window[p + k]].astype(float) @ f[k] for k in range(w)) + b for p in range(len(window) - w + 1)]
        h.append(np.max(at, axis=0))
    z = np.maximum(np.concatenate(h), 0) @ net.dense + net.dense_bias
    z = np.exp(z - z.max())
    return z / z.sum()


def test_language_network():
    net, r = _cnn(), np.random.default_rng(2)
    x = r.integers(0, 256, (7, 24)).astype(np.uint8)
    assert np.allclose(net.probabilities(x, net.tables(), block=3), [cnn_brute(net, w) for w in x], atol=1e-5)


def slopes(parts, loss, r, eps):
    """For some entries of each part, the slope of the loss between two points beside them."""
    for i, p in enumerate(parts):
        for at in r.choice(p.size, min(p.size, 12), replace=False):
            old, ends = p.flat[at], []
            for d in (eps, -eps):
                p.flat[at] = old + d
                ends.append(loss())
            p.flat[at] = old
            yield i, at, (ends[0] - ends[1]) / (2 * eps)


def test_language_gradients():
    net, r = _cnn(), np.random.default_rng(4)
    net.embed, net.dense, net.dense_bias = (a.astype(float) for a in (net.embed, net.dense, net.dense_bias))
    net.filters, net.bias = [f.astype(float) for f in net.filters], [b.astype(float) for b in net.bias]
    x, y, weight = r.integers(0, 40, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([0.5, 1, 2])
    loss = lambda: -np.mean([weight[k] * np.log(cnn_brute(net, w)[k]) for w, k in zip(x, y)])
    grads = net._gradients(x, y, weight)
    assert all(abs(grads[i].flat[at] - s) < 1e-5 for i, at, s in slopes(net.parts(), loss, r, 1e-6))


def passages_brute(text):
    out = []
    for at in range(0, max(1, len(text)), PASSAGE):
        p = text[at : at + PASSAGE]
        pairs, grams = Counter(int(_FOLD[a << 8 | b]) for a, b in zip(p, p[1:])), [p[i : i + 8] for i in range(len(p) - 7)]
        kinds, n = Counter(int(_KIND[b]) for b in p), max(1, len(p))
        row = [math.sqrt(pairs[k] / n) for k in range(PAIRS)] + [kinds[k] / n for k in range(6)]
        out.append([*row, len(pairs) / min(n, PAIRS), len(set(grams)) / max(1, len(grams)), len(p) / PASSAGE, math.log1p(len(text)) / 10])
    return out


def test_passages(corpus):
    texts = [(t or "").encode() for _, t in corpus][:40] + [b"ab" * 700, b"x" * 512, b"y" * 513]
    x, owner = encode_passages(texts)
    want = [(i, row) for i, t in enumerate(texts) for row in passages_brute(t)]
    assert owner.tolist() == [i for i, _ in want]
    assert np.allclose(x, [row for _, row in want], atol=2e-3)  # strings of eight bytes are told apart by 20 bits


def mil_brute(net, bag):
    enc, eb, v, u, w, out, ob = (p.astype(float) for p in net.parts)
    h = [np.tanh(row @ enc + eb) for row in bag]
    a = np.exp([(np.tanh(k @ v) / (1 + np.exp(-(k @ u)))) @ w for k in h])
    z = sum(k * b for k, b in zip(h, a / a.sum()))
    return float(1 / (1 + np.exp(-(z @ out + ob[0]))))


def test_attention_and_its_gradients():
    r, net = np.random.default_rng(5), GatedMil.fresh()
    net.parts = [p.astype(float) for p in net.parts]
    bags = [r.normal(0, 0.2, (n, FEATURES)) for n in (1, 4, 2, 7)]
    x, owner, y = np.concatenate(bags), np.repeat(np.arange(4), [1, 4, 2, 7]), np.array([1.0, 0.0, 1.0, 0.0])
    assert np.allclose(net.score(x, owner, 4), [mil_brute(net, b) for b in bags], atol=1e-5)
    loss = lambda: -np.mean([k * np.log(p) + (1 - k) * np.log(1 - p) for k, p in zip(y, (mil_brute(net, b) for b in bags))])
    grads = net._gradients(x, owner, y)
    assert all(abs(grads[i].flat[at] - s) < 1e-5 for i, at, s in slopes(net.parts, loss, r, 1e-5))


def test_largest_id_is_an_id(spark):
    top = 2**63 - 1
    docs = spark.createDataFrame([(top, "some words"), (None, "other words"), (1, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in classify_quality(docs, spark.createDataFrame([(1, 1), (top, 0)], "doc_id long, quality int")).collect()} == {top, None, 1}
    got = {r["doc_id"]: r for r in pack(docs, tokenizer_path()).collect()}
    assert set(got) == {top, None, 1} and {r["sequence_id"] for r in got.values()} == {0} and got[1]["length"] == 1


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.range(2000).selectExpr("id", "repeat('x', 100) AS text").union(spark.sql("SELECT 5000L, repeat('y', 5000)")).union(spark.sql("SELECT NULL, NULL"))
    assert within_bytes(docs, "id", "text", 10**6, 10**4).count() == 2002
    assert within_bytes(docs, "id", "text", 10**6, 1000).count() == 2001
    assert 400 < within_bytes(docs, "id", "text", 50_000, 1000).count() < 600
    assert within_bytes(docs.limit(0), "id", "text", 10, 10).count() == 0


# --- 4


def licenses_brute(files):
    term = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
    lines = [x for _, _, t in files for x in (t or "").split("\n")]
    vocabulary = {w for xs in TEMPLATES.values() for x in xs for w in term.findall(x.lower())}
    df = {w: sum(w in term.findall(x.lower()) for x in lines) for w in vocabulary}
    idf = lambda w: math.log((len(lines) + 1) / (df.get(w, 0) + 1)) + 1

    def vector(text):
        return {w: (1 + math.log(n)) * idf(w) for w, n in Counter(term.findall(text.lower())).items()}

    def cosine(a, b):
        dot = sum(v * b.get(w, 0) for w, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0

    known = [(name, vector(x)) for name in sorted(TEMPLATES) for x in sorted(TEMPLATES[name])]

    def best(text):
        name, score = None, 0.0
        for n, v in known:
            if (c := cosine(vector(text), v)) > score + 1e-12:
                name, score = n, c
        return name, score

    own, dirs = {}, {}
    for i, path, text in files:
        path = (path or "").strip("/")
        folder, _, name = path.rpartition("/")
        header = max((best(x) for x in (text or "").split("\n")), key=lambda b: b[1])
        whole = best((text or "").replace("\n", " "))
        says = bool(re.match(r"(?i)(licen[cs]e|copying|notice|unlicense)([.-].*)?$", name))
        grant = whole if whole[1] >= 0.9 else header if says and header[1] >= 0.75 else None
        own[i] = (path, folder, header, grant)
        if grant:
            dirs.setdefault(folder, []).append((-grant[1], path, i, grant[0]))
    out = {}
    for i, (path, folder, header, grant) in own.items():
        if grant:
            out[i] = (grant[0], "file")
        elif header[1] >= 0.75:
            out[i] = (header[0], "header")
        else:
            at = folder
            while at and at not in dirs:
                at = at.rpartition("/")[0]
            out[i] = (min(dirs[at])[3], "inherited") if at in dirs else (None, "none")
    return out


def test_licenses(spark):
    r = random.Random(4)
    grants = [x for xs in TEMPLATES.values() for x in xs]
    files = []
    for i in range(150):
        path = "/".join(r.choice("abc") for _ in range(r.randrange(0, 4)))
        name = r.choice(["LICENSE", "COPYING.txt", "x.py", "y.c", "z"])
        body = [" ".join(r.choice(["code", "license", "version", "the", "x", "free"]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 5))]
        if r.random() < 0.3:
            body.insert(r.randrange(len(body) + 1), r.choice(grants) + r.choice(["", "", " indeed"]))
        files.append((i, f"{path}/{name}" if r.random() < 0.95 else None, "\n".join(body) if r.random() < 0.9 else None))
    df = spark.createDataFrame(files, "doc_id long, path string, text string").repartition(4)
    got = {x["doc_id"]: (x["license"], x["basis"]) for x in scan_licenses(df.withColumn("score", F.lit(1)), F.col("path")).collect()}
    assert got == licenses_brute(files)
    assert scan_licenses(df.limit(0), F.col("path")).collect() == []


def test_license_headers_and_texts(spark):
    full = known_templates()
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n"
    files = [
        (1, "a/LGPL.txt", full["LGPL-2.1"][-1]),
        (2, "a/b/c.py", "x = 1"),
        (3, "g/g.py", gpl.format("")),
        (4, "g/a.py", gpl.format("Affero ")),
        (5, "g/m.py", "Some words. Copyright 2020 A B. Licensed under CC BY-NC 4.0. All rights reserved."),
        (6, "g/s.py", "// SPDX-License-Identifier: Apache-2.0\nint x;"),
        (7, "g/t.py", "// SPDX-License-Identifier: ISC\nint x;"),
        (8, "g/b.py", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"),
        (9, "g/u.py", "// SPDX-License-Identifier: GPL-2.0-or-later"),
        (10, "g/v.py", "the words of a text and no more of it"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {x["doc_id"]: (x["license"], x["basis"]) for x in scan_licenses(df, F.col("path")).collect()}
    assert got[1] == ("LGPL-2.1", "file") and got[2] == ("LGPL-2.1", "inherited")
    want = {3: "GPL-3.0", 4: "AGPL-3.0", 5: "CC-BY-NC-4.0", 6: "Apache-2.0", 8: "BSD-3-Clause", 9: "GPL-2.0"}
    assert {i: got[i] for i in want} == {i: (n, "header") for i, n in want.items()}
    assert got[7] == got[10] == (None, "none")


# --- 6


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def lines_brute(corpus, least=24):
    seen, out = [], {}
    for i, t in sorted(corpus):
        kept, removed = [], 0
        for x in (t.split("\n") if t is not None else []):
            long = len(x) >= least and x.strip(" ")
            gone = long and any(abs(len(x) - len(y)) <= 1 and (x == y or edits(x, y) <= 1) for y in seen)
            if long:
                seen.append(x)
            removed += bool(gone)
            if not gone:
                kept.append(x)
        out[i] = (removed, "\n".join(kept) if t is not None else None)
    return out


def test_lines(spark):
    r = random.Random(8)
    line = lambda n: "".join(r.choice("abcd efg") for _ in range(n)).strip() or "x"
    pool = [line(r.randrange(15, 60)) for _ in range(30)]

    def changed(x):
        k, how = r.randrange(len(x)), r.randrange(4)
        return [x, x[:k] + "Q" + x[k:], x[:k] + x[k + 1 :], x[:k] + "é" + x[k + 1 :]][how]

    corpus = [(i, "\n".join(changed(r.choice(pool)) for _ in range(r.randrange(0, 8)))) for i in range(70)] + [(900, None), (901, ""), (902, "\n\n"), (903, "y" * 5000), (904, "y" * 4999 + "z")]
    # many lines that share a half
    corpus += [(1000 + i, "this half is the same everywhere " + line(20)) for i in range(60)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    want = lines_brute(corpus)
    got = {x["doc_id"]: (x["n_removed"], x["kept_text"]) for x in line_dedup(docs).collect()}
    assert got == want
    left = dedup_lines(clash(docs))
    assert left.columns == clash(docs).columns
    assert {x["doc_id"]: x["text"] for x in left.collect()} == {i: t for i, (n, t) in want.items() if not (n and not t.strip(" "))}
    assert rows(line_dedup(docs.limit(0))) == []


@pytest.mark.parametrize("most, percent", [(3, 0), (8, 5), (2, 5)])
def test_lines_within_more_edits(spark, most, percent):
    r = random.Random(most)
    line = lambda n: "".join(r.choice("abcdé efg") for _ in range(n)).strip() or "x"
    pool = [line(n) for n in (24, 26, 39, 40, 41, 59, 61, 80, 99, 150, 165, 200, 319, 321, 330)]

    def changed(x):
        for _ in range(r.randrange(most + 3)):
            k = r.randrange(len(x))
            x = r.choice([x[:k] + "Q" + x[k:], x[:k] + x[k + 1 :], x[:k] + "é" + x[k + 1 :]])
        return x

    same = line(90)
    texts = [(i, changed(r.choice(pool))) for i in range(90)] + [(1000 + i, same + line(40)) for i in range(120)]
    seen, want = [], {}
    for i, x in texts:
        allowed = lambda y: max(1, min(most, min(len(x), len(y)) * percent // 100)) if percent else most  # noqa: B023, E731
        near = [y for y in seen if abs(len(x) - len(y)) <= allowed(y) and edits(x, y) <= allowed(y)]
        want[i] = int(len(x) >= 24 and bool(near))
        seen += [x] if len(x) >= 24 else []
    assert 0 < sum(want.values()) < len(want)
    got = line_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), edits=most, percent=percent)
    assert {x["doc_id"]: x["n_removed"] for x in got.collect()} == want


def test_line_links_of_first_places_without_an_id(spark):
    x = "a line of some words that is first in a row without an id"
    docs = spark.createDataFrame([(None, x), (5, x), (9, x + "!")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup(docs).collect()} == {None: 0, 5: 1, 9: 1}


def test_line_decisions_of_one_id(spark):
    """Several texts of one id, or without one, have their own decisions; rows of equal id and text the same."""
    x, y, z = (f"{w} line of some words for this test of ids" for w in ("first", "second", "quite another third"))
    data = [(None, x), (None, y + "\n" + x), (3, z), (3, y + "\n" + "k" * 30), (3, z), (4, "own " * 9 + "\n" + z)]
    got = rows(line_dedup(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_removed", "kept_text"))
    twice = min([x, y + "\n" + x], key=lambda t: hashlib.md5(t.encode()).digest()) == x  # the text that comes first keeps the line
    want = [(None, int(not twice), x if twice else ""), (None, int(twice), y if twice else y + "\n" + x), (3, 0, z), (3, 1, "k" * 30), (3, 0, z), (4, 1, "own " * 9)]
    assert got == sorted(want, key=repr)


def test_rulers():
    for i in range(40):
        marks = line_module.ruler(i)
        assert {y - x for x in marks for y in marks if y > x} >= set(range(1, i + 1)) and len(marks) <= max(1, i + 1)


def test_lines_of_frequent_keys(spark, monkeypatch):
    """Keys that the sample shows to be frequent are refined at once; the result is the same."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    head = " ".join(word() for _ in range(12))
    texts = [(i, head + " " + word() + " " + word()) for i in range(150)]
    texts += [(1000 + i, t[:30] + "X" * (i % 3) + t[31:]) for i, t in texts[:40]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = rows(line_dedup(docs, edits=4, percent=5))
    assert any(x[2] for x in want)
    monkeypatch.setattr(line_module, "SMALL_KEY", 2)
    assert rows(line_dedup(docs, edits=4, percent=5)) == want
    monkeypatch.setattr(line_module, "DENSE_KEY", 5)
    monkeypatch.setattr(line_module, "SAMPLE", 2)
    monkeypatch.setattr(line_module, "FREQUENT", 5)
    assert rows(line_dedup(docs, edits=4, percent=5)) == want


def test_line_rows_repeat_no_work_on_the_text(spark):
    """The MD5 of a text and the wide form of a line are worked out once, below the loop over lines and entries."""
    docs = spark.createDataFrame([(1, "a line of some words for this test\n" * 3)], "doc_id long, text string")
    lines = line_module.occurrences(docs, 24).withColumn("id", F.lit(1))
    found = line_module.classes(24, 8, 5)
    for df, work in ((lines, "md5("), (line_module._entries(lines, line_module._plan(spark, found), found), "UTF-32")):
        at = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if work in x]
        assert at and all("monotonically_increasing_id" in x for x in at)


def test_line_pairs_that_only_share_a_segment(spark, monkeypatch):
    """Lines that have a key in common and little else are told apart by their words, before they become rows."""
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = [say(4) for _ in range(20)]
    texts = [(7 * k + i, x + " " + say(20)) for k, x in enumerate(shared) for i in range(6)]
    texts += [(1000, texts[3][1][:60] + "Q" + texts[3][1][60:]), (1001, texts[9][1].replace(" ", "", 2))]
    seen, real = [], line_module._verified

    def spy(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(line_module, "_verified", spy)
    got = rows(line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), edits=8, percent=5).where("n_removed > 0").select("doc_id"))
    assert got == [(1000,), (1001,)] and 2 <= seen[0] < 10  # of 300 pairs of one segment


def test_copies_of_a_line_with_other_words_are_no_pairs(spark, monkeypatch):
    """Copies that differ in more words than the edits allow are told apart by their characters, before they become rows."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    texts = []
    for k in range(20):
        base = [word() for _ in range(40)]
        for i in range(8):
            changed = base.copy()
            for at in r.sample(range(40), 4):
                changed[at] = word()
            texts.append((100 * k + i, " ".join(changed)))
    texts += [(5000 + k, texts[8 * k][1].replace(" ", "  ", 2)) for k in range(5)]
    seen, real = [], line_module._verified

    def spy(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(line_module, "_verified", spy)
    got = rows(line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), edits=8, percent=5).where("n_removed > 0").select("doc_id"))
    assert got == [(5000 + k,) for k in range(5)] and 5 <= seen[0] < 20  # of 560 pairs of copies


def test_pairs_of_a_large_key_are_no_rows(spark, monkeypatch):
    """Copies of one line are compared within the rows of their keys: all links are counted, once each, and few pairs become rows."""
    r = random.Random(23)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    base, texts = [word(6) for _ in range(30)], []
    for i in range(90):
        changed = base.copy()
        for at in r.sample(range(30), r.randrange(1, 8)):
            changed[at] = r.choice([changed[at][:-1], changed[at] + "x", "y" + changed[at][1:]])
        changed[i % 30] += "zz"[: i // 30]
        texts.append((i, " ".join(changed)))
    assert len({x for _, x in texts}) == len(texts)
    limit = lambda x, y: max(1, min(8, min(len(x), len(y)) * 5 // 100))
    links = {i: {j for j, y in texts if j != i and abs(len(x) - len(y)) <= 8 and edits(x, y) <= limit(x, y)} for i, x in texts}
    want = sorted(((i, int(any(j < i for j in near)), len(near)) for i, near in links.items()), key=repr)
    n_links = sum(len(x) for x in links.values()) // 2
    assert 200 < n_links < 90 * 89 // 2
    seen, real = [], line_module._verified

    def spy(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(line_module, "_verified", spy)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for part in (256, 7):
        monkeypatch.setattr(line_module, "PART_LINES", part, raising=False)
        got = line_dedup(docs, edits=8, percent=5).select("doc_id", "n_removed", "n_links")
        assert rows(got) == want
        assert seen.pop() < n_links


def test_line_signatures(spark):
    """An edit turns two bits of a signature at most, less one where it changes the length; in any script."""
    r = random.Random(22)
    pairs = []
    for letters in ("abcdefgh ijkl", "абвгд ежз", "漢字仮名😀é"):
        for _ in range(60):
            a = b = "".join(r.choice(letters) for _ in range(r.randrange(1, 200)))
            n = r.randrange(6)
            for _ in range(n):
                k = r.randrange(len(b) + 1)
                b = r.choice([b[:k] + r.choice(letters) + b[k:], b[:k] + b[k + 1 :], b[:k] + r.choice(letters) + b[k + 1 :]])
            pairs.append((a, b, n))
    chars = line_module.frequent_characters(spark.createDataFrame([(x,) for x, _, _ in pairs], "text string"))
    assert len(chars) == len(set("abcdefgh ijklабвгдежз漢字仮名😀é"))
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    sides = [c.alias(f"s{w}_{x}") for x in "ab" for w, c in enumerate(line_module.signature(F.col(x), chars))]
    for x in df.select("a", "b", "n", *sides).select("a", "b", "n", line_module._differ().alias("bits")).collect():
        assert x["bits"] + abs(len(x["a"]) - len(x["b"])) <= 2 * x["n"]
        if x["n"] == 0:
            assert x["bits"] == 0


def test_common_ends_of_lines(spark):
    """What two lines begin and end with in common is cut off, and their distance stays."""
    r = random.Random(13)
    line = lambda n: "".join(r.choice("abé😀") for _ in range(n))
    pairs = [("", ""), ("", "abc"), ("aaa", "aaaaa"), ("abab", "ababab"), ("xay", "xby"), ("é😀", "😀é")]
    for n in (1, 5, 40, 300):
        x = line(n)
        k = r.randrange(n)
        pairs += [(x, x), (x, x[:k] + "Q" + x[k + 1 :]), (x, x[:k] + x[k + 1 :]), (x, line(n)), (x, x + line(3)), (line(3) + x, x)]
    df = spark.createDataFrame([(a, b, a, b, len(a), len(b)) for a, b in pairs], "a string, b string, t_a string, t_b string, n_a int, n_b int")
    got = line_module._without_common_ends(df).collect()
    assert len(got) == len(pairs)
    for x in got:
        a, b, u, v = x["a"], x["b"], x["t_a"], x["t_b"]
        assert edits(u, v) == edits(a, b) and len(a) - len(u) == len(b) - len(v)
        assert not (u and v) or (u[0] != v[0] and u[-1] != v[-1])


# --- 7


def near_brute(corpus, percent):
    sets = {}
    for i, t in corpus:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * (both := len(a & b)) >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=repr)


@pytest.mark.parametrize("percent, bucket", [(85, 16), (80, 2)])
def test_near(docs, corpus, monkeypatch, percent, bucket):
    monkeypatch.setattr(near_module, "SMALL_BUCKET", bucket)
    assert rows(near_dedup(clash(docs), percent=percent)) == near_brute(corpus, percent)


def test_near_dense_group(spark, monkeypatch):
    """Many documents that resemble each other without being linked: the finer bands decide."""
    monkeypatch.setattr(near_module, "SMALL_BUCKET", 3)
    r = random.Random(5)
    base = [str(r.randrange(10**6)) for _ in range(120)]
    corpus = []
    for i in range(110):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 7])):
            w[r.randrange(len(w))] = str(r.randrange(10**6))
        corpus.append((i + (500 if len(set(w) & set(base)) > 117 else 0), " ".join(w)))
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert rows(near_dedup(docs)) == near_brute(corpus, 85)
    # families of several blocks: every block meets every other one, at each level
    monkeypatch.setattr(near_module, "BLOCK", 4)
    monkeypatch.setattr(near_module, "FEW", 3)
    monkeypatch.setattr(near_module, "DENSE", 8)
    assert rows(near_dedup(docs)) == near_brute(corpus, 85)


def test_components(spark):
    from quernlake.llm.components import components

    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = sorted((x, y) for x, y in root.items() if x != y)
    df = spark.createDataFrame(links, "a long, b long")
    for few in (0, 100):
        assert sorted(map(tuple, components(df, few=few).collect())) == want
    assert components(df.limit(0)).collect() == components(df.limit(0), few=-1).collect() == []


def test_near_edges(spark, docs):
    assert rows(near_dedup(docs.limit(0))) == []
    x = spark.createDataFrame([(5, "a b"), (5, "a b"), (7, "A  B"), (None, "a b"), (9, None)], "doc_id long, text string")
    assert rows(near_dedup(x)) == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 0, 9, True), (None, 1, 5, False)]


def test_near_ids(spark):
    """Rows without an id, several texts of one id and the largest id: each row has the figures of its own text."""
    base = [f"w{i}" for i in range(120)]
    near, other = " ".join([*base[:60], "x", *base[61:]]), " ".join(f"v{i}" for i in range(50))
    top = (1 << 63) - 1
    data = [(1, " ".join(base)), (2, near), (2, other), (None, near), (None, other), (None, "all alone here"), (None, "all alone here"), (None, ""), (top, "z y x"), (top, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = [(1, 116, 1, True), (2, 116, 1, False), (2, 46, 2, True), (None, 116, 1, False), (None, 46, 2, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (top, 1, top, True), (top, 0, top, True)]
    assert rows(near_dedup(df)) == sorted(want, key=repr)
    kept = rows(near_module.one_of_each(clash(df)).select("doc_id", "text"))
    assert kept == sorted([data[0], data[2], data[5], (None, ""), data[8], data[9]], key=repr)
    twice = near_module.one_of_each(df.union(df.where("doc_id = 1"))).where("doc_id = 1")
    assert twice.count() == 2  # rows of equal id and text are one document


# --- 8


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for capacity in (4096, 64):
        got = pack(clash(docs), tokenizer_path(), capacity=capacity).collect()
        ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in corpus}
        bins = {}
        for r in got:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] <= capacity and r["start"] == r["piece"] * capacity
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= capacity
        least = -(-sum(map(len, ids.values())) // capacity)
        assert len(bins) <= 1.25 * least + 1
    assert pack(docs.limit(0), tokenizer_path()).collect() == []


def test_packing_words(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["thing, thing,. naïve éa÷ ÿ×b x... a_b a`b foo| xß?", "fóo  x a­ b\u0085c", "a <|endoftext|>b x<|startoftext|> y", "don't stop'll we've 12ab É İstanbul <b> <|ENDOFTEXT|>", " x y\x0bz\x1c q", "漢字 and 😀!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pack(df, tokenizer_path()).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4").tobytes())


def test_plan_fills():
    r = random.Random(6)
    for _ in range(30):
        counts = Counter(r.randrange(1, 101) for _ in range(r.randrange(1, 300)))
        used, ranks = Counter(), Counter()
        for size, lo, hi, k, first, offset in plan(dict(counts), 100):
            ranks[size] += hi - lo
            for n in range(hi - lo):
                used[first + n // k] += size
                assert offset + (n % k + 1) * size <= 100
        assert ranks == counts and max(used.values()) <= 100


# --- 9


def test_scores(docs, corpus):
    words = {i: WORD.findall(lower(t)) + [""] for i, t in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = Counter()
    for i, w in words.items():
        if not held[i]:
            for k in range(1, lm.DEPTH + 2):
                count.update(tuple(w[p : p + k]) for p in range(len(w) - k + 1))
    n, v = sum(c for k, c in count.items() if len(k) == 1), sum(len(k) == 1 for k in count)
    stays = set()

    def prob(past, x):
        p = (count[(x,)] + 0.1) / (n + 0.1 * (v + 1))
        for d in range(1, len(past) + 1):
            c = tuple(past[-d:])
            if count[c] < lm.LEAST:
                break
            if c in stays:
                p = (count[(*c, x)] + lm.WEIGHT * p) / (count[c] + lm.WEIGHT)
        return p

    for d in range(1, lm.DEPTH + 1):
        gain = Counter()
        for i, w in words.items():
            for p in range(d, 0 if held[i] else len(w)):
                c = tuple(w[p - d : p])
                if all(count[c[-k:]] >= lm.LEAST for k in range(1, d + 1)):
                    parent = prob(c[1:], w[p])
                    gain[c] += math.log((count[(*c, w[p])] - 1 + lm.WEIGHT * parent) / (count[c] - 1 + lm.WEIGHT) / parent)
        stays |= {c for c, g in gain.items() if g > lm.GAIN}
    assert stays
    got = {r["doc_id"]: r for r in lm.score_documents(clash(docs)).collect()}
    for i, w in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(count[(x,)] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(prob(w[max(0, p - lm.DEPTH) : p], x)) for p, x in enumerate(w)))


def test_scores_learn_what_is_repeated_a_few_times(spark):
    copied = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(i, copied if i % 5 == 0 else f"a{i} b{i} c{i}") for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert all(got[i]["score"] > got[i]["base_score"] + 5 for i in range(0, 40, 5))


def test_scores_edges(spark, docs):
    assert lm.score_documents(docs.limit(0)).collect() == []
    x = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in lm.score_documents(x).collect()) == [(0, 3), (1, 1), (1, 1)]


# --- 10


def leaks_brute(corpus, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = {}
    for k, t in items:
        w = split(t)
        for p in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[p : p + width]), set()).add(str(k))
    out = []
    for i, t in corpus:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= wins[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [200_000, 0])
def test_leaks(spark, docs, corpus, monkeypatch, most):
    monkeypatch.setattr("quernlake.llm.decontaminate.BROADCAST_WINDOWS", most)
    texts = [t for _, t in corpus if t]
    items = [(1, " ".join(texts[60].split()[:14])), (2, " ".join(texts[70].split()[2:12])), (3, "ONE"), (4, None), (5, ""), (10, "ONE"), (6, "not there at all"), (7, "a" * 400)]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate(clash(docs), clash(b)).drop("spans", "items")) == leaks_brute(corpus, items)
    assert {r["contaminated"] for r in decontaminate(docs, b.limit(0)).collect()} == {False}
    assert decontaminate(docs.limit(0), b).collect() == []


# --- registered queries with twins


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


# --- rows without ids or with shared ones


def test_decontamination_by_text(spark):
    item = " ".join(f"q{i}" for i in range(14))
    data = [(1, "clean words only"), (1, "before " + item + " after"), (None, item), (None, "three clean words"), ((1 << 63) - 1, "more clean"), (2, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, 3, 0, False), (1, 16, 14, True), (None, 14, 14, True), (None, 3, 0, False), ((1 << 63) - 1, 2, 0, False), (2, 0, 0, False)], key=repr)
    left = uncontaminated(clash(docs), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert left.columns == clash(docs).columns and left.count() == 4


# --- blocks


@pytest.mark.parametrize("numbers", [[], [0], [254, 255, 256, 0, 255], [1] * 1000 + [2**40]])
def test_counts_come_back_from_their_bytes(numbers):
    from quernlake.llm.blocks import pack_counts, unpack_counts

    assert unpack_counts(pack_counts(np.array(numbers, np.int64))).tolist() == numbers


def test_shuffle_files_go_with_their_write(spark):
    """Files of the shuffles of a stored table and of a round of replies are gone though their plans are still held."""
    from quernlake.llm.blocks import Replies
    from quernlake.llm.common import stored

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p for d in folders for p in Path(d.toString()).rglob("shuffle_*")}
    before = files()
    rows = spark.range(1000).selectExpr("id % 7 as block", "0 as kind", "0 as part", "binary(string(id)) as data", "id as total", "id as distinct").repartition(3, "data")
    replies = Replies(spark, 1000)
    replies.add(rows)
    held = stored(rows)
    end = time.monotonic() + 20
    while files() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not files() - before
    assert held.count() == replies.table().count() == 1000


def test_scores_do_not_depend_on_the_blocks(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(6)) for _ in range(r.randrange(60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({x["doc_id"]: x["score"] for x in lm.score_documents(docs.repartition(n)).collect()} for n in (1, 9))
    assert one == pytest.approx(many)
