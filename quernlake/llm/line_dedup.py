"""Line deduplication within a number of edits, as a segment-partition join, in DataFrame operations only.

Two lines may be ``edits`` apart, or, with ``percent``, at most so much of the shorter line's characters too (one edit
at least). Lines are put in classes by length, each with its threshold k (``classes``). Every distinct line of at least
``min_chars`` characters is cut into k + 1 segments of its class's segment length, the first half of them counted from
its start and the others from its end. If at most k edits lie between two lines, one of the two sides with s segments
has fewer than s edits, and there is a first segment i of it that is as it was and has just i edits before it, so it
lies at most i characters off in the other line. Each line is indexed under substrings of segment i at the marks of a
sparse ruler: any distance up to i is the difference of two of its marks (``ruler``), so both lines have one substring
in common, whatever their lengths, with far fewer entries than one for each shift. A line close above its class's least
length is also looked up in the classes below, as far as k reaches. Keys hold a range of lengths as well; a line close
above a range's least length is also looked up in the range below.

Lines that share a key with another one go on alone (``_in_play``), with a signature: how often each of the ``COUNTED``
most frequent characters occurs, modulo 16, as eight bits of which the next number differs in one. An edit turns two bits
at most, or one if it changes the length too. The pairs of a key are compared where they meet, and only those become rows
whose lengths and signatures allow the threshold. Keys of more than ``DENSE_KEY`` lines (a template's segment) are refined first: what lies behind the
substring has at most k - i edits and is cut again in the same way, until the keys are smaller or the pieces are shorter
than ``TERMINAL`` characters. Entries are dealt by key once; keys that a sample of the lines shows to be that frequent
are refined at once and never gather in one place.

Lines of a key of more than ``SMALL_KEY`` lines (unless it came from refining) are not paired in rows at all: they are dealt into
parts, two parts are compared within one row, and what leaves it is one row for each line with links: their number and the first
place among them. The pairs of such a key are still compared one by one, so its work, unlike its rows, grows with their square. A pair
counts under the first large key that it shares, and is dropped from the pairs of other keys.

Candidates are verified by Spark's edit distance over the band of diagonals that the threshold leaves. It walks through
one line for each character of the other, so what both begin and end with in common is cut off first.

Order is (doc_id, line number), rows without an id first, several texts of one id by MD5. A line is removed if an earlier
line is equal or within the threshold of it. Defined results: shorter and blank lines are never removed; null texts have
no lines, an empty text has one blank line; rows of equal id and text get the same decisions each; extra columns pass
``dedup_lines`` untouched; an empty table gives an empty result. Lines are told equal by two 64-bit hashes and length.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlake.llm.common import once, small, stored, text_id, unused

EDITS, SMALL_KEY, DENSE_KEY, TERMINAL, LAST_CLASS = 1, 16, 8192, 2, 4096
#: Characters that signatures count, words of 64 bits that these fill, and lines that show which characters are frequent.
COUNTED, WORDS, SEEN = 32, 4, 4096
#: Codes of the numbers modulo 16: the next one differs in one bit, any two in as many as they are apart either way round.
CODES = [(1 << i) - 1 if i <= 8 else 256 - (1 << (i - 8)) for i in range(16)]
#: One line in so many is looked at for keys that are very frequent, and entries of a key there that make it so.
SAMPLE, FREQUENT = 1024, 16
#: Lengths that share keys, for each edit of the threshold.
WIDTH = 8
#: Distances up to which the shortest ruler is searched for.
SEARCHED = 10
#: Common ends up to which lines are cut before their edits are counted, a power of two.
LONGEST_END = 1 << 16
#: Lines of a key, and characters of them, that are compared with as many others in one row.
PART_LINES, PART_CHARS = 256, 1 << 20
LINE = ["h", "g", "chars"]
SIGNED = ["chars", *[f"s{w}" for w in range(WORDS)]]
ENTRY = ["key", "id", "probe", "side", "at", "room", "edits"]


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Two hashes h and g, chars, at (place: d, tid, l from 0) and text of the lines that take part."""
    rows = docs.select("doc_id", once(text_id(F.col("text"))).alias("tid"), F.split("text", "\n").alias("lines"))
    rows = rows.select("doc_id", "tid", F.posexplode("lines").alias("l", "text"))
    rows = rows.where((F.char_length("text") >= min_chars) & (F.trim("text") != ""))
    at = F.struct(F.col("doc_id").alias("d"), "tid", "l").alias("at")
    return rows.select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(LAST_CLASS), "text").alias("g"), F.char_length("text").alias("chars"), at, "text")


def ruler(i: int) -> list[int]:
    """Few marks from 0 of which two differ by d, for each d up to i."""
    whole = set(range(1, i + 1))
    if i <= SEARCHED:
        for n in range(i + 1):
            for inner in combinations(range(1, i), n):
                marks = sorted({0, *inner, i})
                if whole <= {y - x for x, y in combinations(marks, 2)}:
                    return marks
    step = max(1, round(i**0.5))
    return sorted({*range(step), *range(step, i + step, step)})


def threshold(n: int, edits: int, percent: int) -> int:
    """Edits allowed between two lines of which the shorter has n characters; percent 0 leaves ``edits`` alone."""
    return max(1, min(edits, n * percent // 100)) if percent else edits


def classes(min_chars: int, edits: int, percent: int) -> list[tuple[int, int]]:
    """(least length, threshold) of each class: the threshold is one in a class, and its lengths at most double."""
    out, lo = [], max(1, min_chars)
    while True:
        k = threshold(lo, edits, percent)
        out.append((lo, k))
        if lo >= LAST_CLASS and k == edits:
            return out
        steps = [n for n in [-(-100 * (k + 1) // percent)] if k < edits] if percent else []
        lo = min([2 * lo, *steps])


def _class_of(n: Column, found: list[tuple[int, int]]) -> Column:
    c = F.lit(0)
    for i, (lo, _) in enumerate(found):
        c = F.when(n >= lo, i).otherwise(c)
    return c


def _plan(spark: SparkSession, found: list[tuple[int, int]]) -> DataFrame:
    """What a line of class ``own`` and at most ``most`` characters has: substrings of ``size`` characters ``at`` a distance from a side."""
    rows = []
    for own, (lo, _) in enumerate(found):
        for c, (least, k) in enumerate(found[: own + 1]):
            ends = found[c + 1][0] if c + 1 < len(found) else 0
            most = 2**31 - 1 if c == own else ends - 1 + k  # the longest line within k edits of one of class c
            if most < lo:
                continue
            size = least // (k + 1)
            for side, count in enumerate(((k + 2) // 2, (k + 1) // 2)):
                for i in range(count):
                    marks = ruler(i)
                    for m, down in product(marks, (0, 1)):
                        probe = int(c != own or down)
                        rows.append((2 * len(rows) + probe, own, most, c, k, down, side, i, i * size + m, max(0, size - marks[-1]), probe, least - (i + 1) * size, k - i))
    return spark.createDataFrame(rows, "p int, own int, most int, c int, k int, down int, side int, i int, at int, size int, probe int, room int, edits int")


def _entries(lines: DataFrame, plan: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    """key, id and the row ``p`` of the plan; characters of four bytes each are cut without a walk through the text."""
    start = F.when(F.col("side") == 0, F.col("at")).otherwise(F.col("chars") - F.col("at") - F.col("size"))
    got = lines.select("id", "chars", once(F.encode("text", "UTF-32")).alias("wide"), _class_of(F.col("chars"), found).alias("own"))
    width = WIDTH * F.col("k")
    fits = (F.col("down") == 0) | (F.col("chars") % width < F.col("k"))
    got = got.join(F.broadcast(plan), "own").where((F.col("chars") <= F.col("most")) & fits & (start >= 0))
    lengths = F.floor(F.col("chars") / width) - F.col("down")
    return got.select(F.xxhash64("c", "side", "i", lengths, F.substring("wide", 4 * start + 1, 4 * F.col("size"))).alias("key"), "id", "p")


def _sampled(rows: DataFrame) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)


def _shared(entries: DataFrame, sampled: DataFrame) -> DataFrame:
    """Entries of keys that a line of the key's class has and that have another entry, with their number as ``n``."""
    often = sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {FREQUENT}")
    often = stored(often.select("key"))
    n_often = often.count()
    rest = entries.join(small(often, n_often), "key", "left_anti") if n_often else entries
    probe = F.col("probe") if "probe" in entries.columns else F.col("p") % 2
    # one sum counts both: entries below 2^32, those of the key's class above
    rest = rest.withColumn("_both", F.sum(F.when(probe == 1, 1).otherwise((1 << 32) + 1)).over(Window.partitionBy("key")))
    rest = rest.where("_both >= shiftleft(1L, 32) and (_both & 4294967295L) > 1").withColumn("n", F.col("_both").bitwiseAND((1 << 32) - 1)).drop("_both")
    if not n_often:
        return rest
    return rest.unionByName(entries.join(small(often, n_often), "key", "left_semi").withColumn("n", F.lit(SAMPLE * FREQUENT).cast("long")))


def _pairs(entries: DataFrame, more: list[str], allowed: Column) -> DataFrame:
    """Pairs of entries of one key, one of them of the key's class; columns ``more`` of both sides are looked at by ``allowed``."""
    side = lambda c: entries.select("key", F.col("probe").alias(f"p_{c}"), F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in more])
    wanted = F.expr("(p_b = 1 and a <> b) or (p_b = 0 and a < b)")
    return side("a").where("p_a = 0").join(side("b"), "key").where(wanted & allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _limit(a: str, b: str, edits: int, percent: int) -> Column:
    """Edits allowed between two lines of so many characters."""
    return F.greatest(F.lit(1), F.least(F.lit(edits), F.floor(F.least(a, b) * percent / 100).cast("int"))) if percent else F.lit(edits)


def frequent_characters(lines: DataFrame) -> list[str]:
    """The most frequent characters of a few lines; what they are changes no result."""
    chars = lines.select("text").limit(SEEN).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return [r["c"] for r in chars.groupBy("c").count().orderBy(F.desc("count"), "c").limit(COUNTED).collect()]


def signature(text: Column, chars: list[str]) -> list[Column]:
    """s0, s1, ...: the code of the number of each of ``chars`` in a text, eight to a word."""
    codes, size = F.array(*[F.lit(x).cast("long") for x in CODES]), F.octet_length(text)
    out = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for j, c in enumerate(chars[8 * w : 8 * w + 8]):
            n = (size - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / len(c.encode())
            word = word.bitwiseOR(F.shiftleft(codes[n.cast("int") % 16], 8 * j))
        out.append(word.alias(f"s{w}"))
    return out


def _in_play(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """id, chars, at, text and signature of the lines that have entries."""
    ids = stored(entries.select("id").distinct())
    play = lines.join(small(ids, ids.count()), "id", "left_semi")
    return stored(play.select("id", "chars", "at", "text", *signature(F.col("text"), frequent_characters(lines))))


def _differ() -> Column:
    return sum((F.bit_count(F.col(f"s{w}_a").bitwiseXOR(F.col(f"s{w}_b"))) for w in range(WORDS)), F.lit(0))


def _near_pairs(signed: DataFrame, edits: int, percent: int) -> DataFrame:
    """Pairs of a key whose lengths and signatures allow their threshold."""
    apart, limit = F.abs(F.col("chars_a") - F.col("chars_b")), _limit("chars_a", "chars_b", edits, percent)
    return _pairs(signed, SIGNED, (apart <= limit) & (_differ() + apart <= 2 * limit))


def _refined(entries: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The entries of large keys under longer keys: substrings of the pieces behind the part that is equal, at the marks that the edits left ask for."""
    marks = F.array(*[F.array(*map(F.lit, ruler(i))) for i in range(edits + 1)])
    e = entries.join(lines.select("id", "text"), "id").withColumn("text", F.when(F.col("side") == 0, F.col("text")).otherwise(F.reverse("text")))
    e = e.withColumn("size", F.floor(F.col("room") / (F.col("edits") + 1)).cast("int"))
    e = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits")))).withColumn("length", F.col("size") - F.array_max(marks[F.col("i")]))
    # a piece that is too short for its marks tells nothing apart, and once is enough
    e = e.withColumn("mark", F.explode(F.when(F.col("length") > 0, marks[F.col("i")]).otherwise(F.array(F.lit(0))))).withColumn("length", F.greatest("length", F.lit(0)))
    e = e.withColumn("from", F.col("at") + F.col("i") * F.col("size") + F.col("mark"))
    key = F.xxhash64("key", "i", F.substring(F.col("text"), F.col("from") + 1, F.col("length")))
    return e.select(key.alias("key"), "id", "probe", "side", (F.col("from") + F.col("length")).alias("at"), (F.col("room") - (F.col("i") + 1) * F.col("size")).alias("room"), (F.col("edits") - F.col("i")).alias("edits"))


def _without_common_ends(pairs: DataFrame) -> DataFrame:
    """``pairs`` with t_a and t_b short of the characters that they begin and end with in common, which change no distance.

    Lengths of common ends are found bit by bit, from the highest; ends of ``LONGEST_END`` characters or more stay in part.
    """
    made = pairs.withColumns({f"w_{c}": once(F.encode(f"t_{c}", "UTF-32")) for c in "ab"})
    for end in ("_head", "_tail"):
        made = made.withColumn(end, F.lit(0))
        most = F.least("n_a", "n_b") - (F.col("_head") if end == "_tail" else 0)
        step = LONGEST_END // 2
        while step:
            part = lambda c: F.substring(f"w_{c}", 4 * (F.col("_head") if end == "_head" else F.col(f"n_{c}") - F.col("_tail") - step) + 1, F.lit(4 * step))  # noqa: B023, E731
            made = made.withColumn(end, once(F.col(end) + F.when((F.col(end) + step <= most) & (part("a") == part("b")), step).otherwise(0)))
            step //= 2
    return made.withColumns({f"t_{c}": F.substring(f"t_{c}", F.col("_head") + 1, F.col(f"n_{c}") - F.col("_head") - F.col("_tail")) for c in "ab"})


def _with_large_keys(play: DataFrame, signed: DataFrame) -> DataFrame:
    """``play`` with the large keys that each line has, those of most lines first; null if it has none."""
    large = signed.where("large")
    sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.sum("chars").alias("chars"))
    parts = F.ceil(F.greatest(F.col("lines") / PART_LINES, F.col("chars") / PART_CHARS))
    sizes = stored(sizes.select("key", (-F.col("lines")).alias("rank"), parts.alias("parts")))
    ranked = large.select("key", "id", "probe").join(small(sizes, sizes.count()), "key")
    ranked = ranked.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("rank", "key", "probe", "parts"))).alias("keys"))
    return stored(play.join(ranked, "id", "left"))


def _keys(keys: Column, probe: int) -> Column:
    """The keys that a line looks up (``probe`` 1) or is found under (0)."""
    return F.transform(F.filter(keys, lambda k: k["probe"] == probe), lambda k: k["key"])


def _meet(own_a: Column, probe_a: Column, own_b: Column, probe_b: Column) -> Column:
    """Whether two lines have a key in common that is one of the class of either."""
    return F.arrays_overlap(own_a, own_b) | F.arrays_overlap(own_a, probe_b) | F.arrays_overlap(probe_a, own_b)


def _verified(pairs: DataFrame, lines: DataFrame, edits: int, percent: int) -> DataFrame:
    """Links among pairs; those that have a large key in common are left to ``_large_key_links``."""
    none = F.array().cast("array<long>")
    of = lambda probe: F.coalesce(_keys(F.col("keys"), probe), none)
    side = lambda c: lines.select(F.col("id").alias(c), F.col("at").alias(f"at_{c}"), F.col("text").alias(f"t_{c}"), F.col("chars").alias(f"n_{c}"), of(0).alias(f"own_{c}"), of(1).alias(f"probe_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("limit", _limit("n_a", "n_b", edits, percent)).where(F.abs(F.col("n_a") - F.col("n_b")) <= F.col("limit"))
    near = near.where(~_meet(*[F.col(f"{x}_{c}") for c in "ab" for x in ("own", "probe")])).drop("own_a", "own_b", "probe_a", "probe_b")
    near = _without_common_ends(near)
    return near.where(F.levenshtein("t_a", "t_b", edits).between(0, F.col("limit"))).select("a", "b", "at_a", "at_b")


def _common_end(x: Column, y: Column, tail: bool) -> Column:
    """Characters that two lines begin with in common, or end with behind the ``head`` of y, found bit by bit; ``LONGEST_END`` at most."""
    part = lambda z, got, step: F.substring(z["text"], (z["chars"] - got - step if tail else got) + 1, step)
    most = F.least(x["chars"], y["chars"]) - (y["head"] if tail else 0)
    steps = F.filter(F.array(*[F.lit(1 << i) for i in reversed(range(LONGEST_END.bit_length() - 1))]), lambda step: step <= most)
    more = lambda got, step: (got + step <= most) & (part(x, got, step) == part(y, got, step))
    return F.aggregate(steps, F.lit(0), lambda got, step: got + F.when(more(got, step), step).otherwise(0))


def _large_key_links(lines: DataFrame, edits: int, percent: int) -> DataFrame:
    """id, other (first place of a linked line) and links of the lines that large keys link, in several rows each.

    The lines of a key are dealt into parts and the pairs of two parts are compared within one row, each pair under the
    first large key that it shares.
    """
    e = lines.where(F.col("keys").isNotNull()).select("id", "at", "text", *SIGNED, "keys", F.posexplode("keys").alias("nth", "k"))
    before = F.slice("keys", 1, F.col("nth"))
    line = F.struct("id", F.col("k.probe").alias("probe"), "at", "text", *SIGNED, _limit("chars", "chars", edits, percent).alias("limit"), _keys(before, 0).alias("own_before"), _keys(before, 1).alias("probe_before"))
    dealt = e.select(F.col("k.key").alias("key"), F.col("k.parts").alias("parts"), F.pmod(F.xxhash64("id"), F.col("k.parts")).alias("part"), line.alias("line"))
    dealt = stored(dealt.groupBy("key", "parts", "part").agg(F.collect_list("line").alias("lines")))
    first = dealt.select("key", F.col("part").alias("first"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("part"), F.col("lines").alias("a"))
    met = first.join(dealt.select("key", "part", F.col("lines").alias("b")), ["key", "part"]).select((F.col("first") == F.col("part")).alias("same"), "a", "b")

    def linked(x: Column) -> Column:
        """The lines of the other part that ``x`` is linked with."""

        def allowed(y: Column) -> Column:
            apart, limit = F.abs(x["chars"] - y["chars"]), F.least(x["limit"], y["limit"])
            bits = sum((F.bit_count(x[f"s{w}"].bitwiseXOR(y[f"s{w}"])) for w in range(WORDS)), F.lit(0))
            wanted = (~F.col("same") | (x["id"] < y["id"])) & ((x["probe"] == 0) | (y["probe"] == 0)) & (apart <= limit) & (bits + apart <= 2 * limit)
            return wanted & ~_meet(x["own_before"], x["probe_before"], y["own_before"], y["probe_before"])

        def near(y: Column) -> Column:
            rest = lambda z: F.substring(z["text"], y["head"] + 1, z["chars"] - y["head"] - y["tail"])
            # -1, too many, becomes edits + 1
            return F.pmod(F.levenshtein(rest(x), rest(y), edits), F.lit(edits + 2)) <= F.least(x["limit"], y["limit"])

        found, kept = F.filter("b", allowed), ["id", "at", "text", "chars", "limit"]
        for end in ("head", "tail"):
            found = F.transform(found, lambda y: F.struct(*[y[c].alias(c) for c in kept], _common_end(x, y, end == "tail").alias(end)))  # noqa: B023
            kept.append(end)
        return F.transform(F.filter(found, near), lambda y: F.struct(y["id"].alias("id"), y["at"].alias("at")))

    met = met.select(once(F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["at"].alias("at"), linked(x).alias("to")))).alias("a"))
    back = lambda x: F.transform(x["to"], lambda y: F.struct(y["id"].alias("id"), x["at"].alias("at")))
    met = met.select("a", once(F.flatten(F.transform("a", back))).alias("b")).where(F.size("b") > 0)
    told = lambda i, found: F.struct(i.alias("id"), F.array_min(F.transform(found, lambda y: y["at"])).alias("other"), F.size(found).cast("long").alias("links"))
    ids = F.array_distinct(F.transform("b", lambda y: y["id"]))
    both = F.concat(
        F.transform(F.filter("a", lambda x: F.size(x["to"]) > 0), lambda x: told(x["id"], x["to"])),
        F.transform(ids, lambda i: told(i, F.filter("b", lambda y: y["id"] == i))),
    )
    return met.select(F.inline(both))


def line_links(docs: DataFrame, min_chars: int, edits: int = EDITS, percent: int = 0) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (hashes, chars, first place, copies, text, id) and, for ids with links, the number of lines linked and the first place of these (``other``)."""
    found = classes(min_chars, edits, percent)
    lines = occurrences(docs, min_chars).groupBy(*LINE).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))
    lines = stored(lines.withColumn("id", F.monotonically_increasing_id()))
    plan = _plan(docs.sparkSession, found)
    behind = F.broadcast(plan.select("p", "probe", "side", (F.col("at") + F.col("size")).alias("at"), "room", "edits"))
    entries, many = [], stored(_shared(_entries(lines, plan, found), _entries(_sampled(lines), plan, found)).join(behind, "p").drop("p"))
    play = _in_play(lines, many)
    while True:
        last = (F.col("n") <= max(SMALL_KEY, DENSE_KEY)) | (F.floor(F.col("room") / (F.col("edits") + 1)) < TERMINAL)
        # a line has few keys before they are refined; each of them is told the ones before it
        large = (F.col("n") > SMALL_KEY) & F.lit(not entries)
        entries.append(many.where(last).select("key", "id", "probe", large.alias("large")))
        many = many.where(~last)
        if many.isEmpty():
            break
        refined = _refined(many.select(*ENTRY), play, edits)
        many = stored(_shared(refined, _sampled(refined)))
    signed = stored(reduce(DataFrame.union, entries).join(play.select("id", *SIGNED), "id"))
    play = _with_large_keys(play, signed)
    pairs = stored(_near_pairs(signed.where("not large"), edits, percent))
    links = stored(_verified(pairs, play, edits, percent))
    near = links.select(F.col("a").alias("id"), F.col("at_b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("at_a").alias("other")))
    near = near.withColumn("links", F.lit(1).cast("long")).union(_large_key_links(play, edits, percent))
    return lines, stored(near.groupBy("id").agg(F.min("other").alias("other"), F.sum("links").alias("links")))


def removed_lines(docs: DataFrame, min_chars: int = 24, edits: int = EDITS, percent: int = 0) -> DataFrame:
    """doc_id and tid (of the text) with removed, n_fuzzy (removed without an equal earlier line) and n_links of the lines it first has."""
    lines, near = line_links(docs, min_chars, edits, percent)
    state = lines.select("id", *LINE, "at", "copies").join(small(near, near.count()), "id", "left").where("copies > 1 or links > 0").drop("id")
    occ = occurrences(docs, min_chars).select(*LINE, F.col("at").alias("here"))
    got = occ.join(state, LINE).select("here", (F.col("here") == F.col("at")).alias("is_first"), F.coalesce(F.col("other") < F.col("at"), F.lit(False)).alias("near"), "links")
    got = got.distinct()  # rows of equal id and text
    return got.groupBy(F.col("here.d").alias("doc_id"), F.col("here.tid").alias("tid")).agg(
        F.collect_set(F.when(~F.col("is_first") | F.col("near"), F.col("here.l"))).alias("removed"),
        F.count_if(F.col("is_first") & F.col("near")).alias("n_fuzzy"),
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("links"))), F.lit(0)).alias("n_links"),
    )


def _with_decisions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, edits: int, percent: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the decisions and the text that stays, and the names of these two columns."""
    doc, tid, mark, rest = (unused(c, docs.columns) for c in ("_doc", "_tid", "_gone", "_text"))
    view = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = stored(removed_lines(view, min_chars, edits, percent)).select(F.col("doc_id").alias(doc), F.col("tid").alias(tid), F.struct("removed", "n_fuzzy", "n_links").alias(mark))
    # decisions grow with the documents, so both sides are shuffled at every size; hot keys can't occur among ids
    out = docs.join(gone.hint("merge"), docs[id_col].eqNullSafe(gone[doc]) & (text_id(F.col(text_col)) == gone[tid]), "left").drop(doc, tid)
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.coalesce(F.array_contains(f"{mark}.removed", i), F.lit(False)))
    return out.withColumn(rest, F.array_join(kept, "\n")), mark, rest


def line_dedup(docs: DataFrame, min_chars: int = 24, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, percent: int = 0) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_fuzzy, n_links, kept_sha256, kept_text.

    ``n_links`` counts the links within the threshold that lines first seen in the document have to other line texts.
    """
    x, mark, rest = _with_decisions(docs.select(id_col, text_col), id_col, text_col, min_chars, edits, percent)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return x.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n"))).cast("long").alias("n_lines"),
        number(F.when(F.col(mark).isNotNull(), F.size(f"{mark}.removed"))).alias("n_removed"),
        number(F.col(f"{mark}.n_fuzzy")).alias("n_fuzzy"),
        number(F.col(f"{mark}.n_links")).alias("n_links"),
        F.sha2(F.coalesce(rest, F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        F.col(rest).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 24, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, percent: int = 0) -> DataFrame:
    """``docs`` without the removed lines; documents of which no line is left go. Other columns stay as they are."""
    x, mark, rest = _with_decisions(docs, id_col, text_col, min_chars, edits, percent)
    emptied = F.col(mark).isNotNull() & (F.size(f"{mark}.removed") > 0) & (F.trim(rest) == "")
    return x.where(~F.coalesce(emptied, F.lit(False))).select(*[F.col(rest).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
