"""Near-duplicate detection with HyperMinHash sketches, banding and verification on full shingle sets.

A document's set holds its distinct five-word shingles. Rows are told apart by their texts (MD5), equal sets are
collapsed first and numbered, and all later steps work on numbered sets, so copies cost one row and ids order the
result only. A sketch has about 180 registers; each keeps the leading-zero count and ten mantissa bits of the
smallest hash in its bucket. Small sets throw every shingle several times (a power of two that depends on the set's
size), so registers are filled at any size; a set near a change of that power is sketched for both, so that both
sides of any possible link share one. Bands of six registers give candidates, so many bands that a pair at the
threshold is missed with a chance of one in a million.

In buckets of more than ``SMALL_BUCKET`` sets the set with the most company (the original of a group of copies) is the
hub; each set is compared with one hub a round, while rounds help. No pair within a component is needed to know the
component, so buckets that still span components are all that is left. Sets that meet in such buckets under one hub are
a family, and get together once, with their texts: pairs of different components pass the length bound and, in families
of some size, the collision-corrected estimate of sketches of 1024 registers (six standard errors below the threshold);
the rest are decided by the exact intersection of the full sets, and only links that join components become rows.
Families of many sets or bytes meet block by block. Sets of buckets of more than ``DENSE`` sets are first parted by
longer bands (and more of them, for the same risk). No pair is left out.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer words than five form
one shingle; a component's id is its smallest doc_id, null if no row of it has one; every row, repeated or without an
id, has the figures of its own text; a row is kept if its doc_id is the component's id, and in a component without ids
if its text is the component's representative; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import chunks, mix64, prefix_hash, small, span_hash, stored, text_bytes, text_id, unused, words
from quernlake.llm.components import components

MANTISSA, SMALL_BUCKET, ROUNDS = 10, 16, 3
#: Sets, and bytes of their texts, of one block of a family; members of a bucket from which longer bands part it first.
BLOCK, BLOCK_BYTES, DENSE = 512, 8 << 20, 4096
#: Families up to which all pairs are compared without sketches.
FEW = 16
#: Documents, and bytes of their sketches or texts, up to which one side of the pairs is broadcast.
MOST_HEADS, HEAD_BYTES = 20_000, 8 << 20
EMPTY, WIDE = np.uint16(0xFFFF), 1024
_rng = np.random.default_rng(77)
_ODD = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Bands:
    """Registers in ``bands`` of ``rows``. Each register gets about four throws."""

    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def throws(self, n: int) -> int:
        """How often each of n shingles is thrown: the least power of two that makes enough throws."""
        return 1 << max(0, (-(-4 * self.registers // n) - 1).bit_length())

    def both(self, n: int, percent: int) -> set[int]:
        """The numbers of throws under which a set of n shingles is sketched."""
        return {self.throws(max(1, -(-n * percent // 100))), self.throws(n * 100 // percent)}

    def sketch(self, shingles: np.ndarray, t: int) -> np.ndarray:
        balls = mix64((shingles[None, :] + (np.arange(1, t + 1, dtype=np.uint64) * _ODD[20])[:, None]).ravel())
        least = np.full(self.registers, np.uint64((1 << 64) - 1))
        np.minimum.at(least, (((balls >> np.uint64(32)) * np.uint64(self.registers)) >> np.uint64(32)).astype(np.int64), mix64(balls) >> np.uint64(11))
        frac, exp = np.frexp(np.minimum(least, np.uint64((1 << 53) - 1)).astype(np.float64))
        regs = (((53 - exp) << MANTISSA) | np.maximum(0, (frac * 2 - 1) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)
        return np.where(least == np.uint64((1 << 64) - 1), EMPTY, regs)

    def keys(self, regs: np.ndarray, t: int) -> np.ndarray:
        total = (regs.reshape(self.bands, self.rows).astype(np.uint64) * _ODD[30 : 30 + self.rows]).sum(axis=1, dtype=np.uint64)
        return mix64(total + np.arange(self.bands, dtype=np.uint64) * _ODD[50] + np.full(self.bands, t, np.uint64) * _ODD[51]).view(np.int64)


def levels(percent: int) -> list[Bands]:
    """Bands of growing length, so many that each level misses a pair at the threshold with a chance of one in a million."""
    return [Bands(math.ceil(math.log(1e-6) / math.log1p(-((percent / 100) ** rows))), rows) for rows in (6, 12, 20)]


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles."""
    for lo, hi in chunks(texts):
        buf, s, e, first = words(texts[lo:hi])
        w = span_hash(prefix_hash(buf), s, e)
        n = len(w)
        total = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            total += w[j : n - k + 1 + j] * _ODD[j] if len(total) else total
        total = mix64(total)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(total[a : b - k + 1])
            elif b > a:
                yield mix64((w[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _ODD[k + b - a : k + b - a + 1])
            else:
                yield np.zeros(0, np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (rows), corrected for registers that agree by chance."""
    chance = 0.6 / (1 << MANTISSA)
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def sketched(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, tid, the size and two sums of each set, and the keys of its bands."""
    bands = levels(percent)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sums, keys = [], ([], []), []
            for s in shingle_sets(text_bytes(b.column("text").to_pylist())):
                n.append(len(s))
                keys.append(np.concatenate([bands.keys(bands.sketch(s, t), t) for t in bands.both(len(s), percent)]) if len(s) else np.zeros(0, np.int64))
                for out, x in zip(sums, _ODD[52:54], strict=True):
                    out.append(mix64(s * x).sum(dtype=np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()))
            figures = [pa.array(np.array(x, np.int64), pa.int64()) for x in (n, *sums)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), *figures, lists], names=["doc_id", "tid", "n_shingles", "set_a", "set_b", "keys"])

    return docs.mapInArrow(run, "doc_id long, tid binary, n_shingles long, set_a long, set_b long, keys array<long>")


def banded(sets: DataFrame, percent: int, bands: Bands) -> DataFrame:
    """key and sid of each set's bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, s in zip(b["sid"], shingle_sets(text_bytes(b["text"])), strict=True):
                rows.append((sid, np.concatenate([bands.keys(bands.sketch(s, t), t) for t in bands.both(len(s), percent)])))
            yield pd.DataFrame(rows, columns=["sid", "keys"])

    return sets.mapInPandas(run, "sid long, keys array<long>").select("sid", F.explode("keys").alias("key"))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, more: DataFrame | None) -> DataFrame:
    """The pairs (a hub, b) whose full sets reach the threshold, and the links ``more``."""

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep, heads = [], {}
            for a, i, j in zip(x["a"], x["text_a"], shingle_sets(text_bytes(x["text_b"])), strict=True):
                if a not in heads:  # hubs come again and again
                    heads[a] = next(shingle_sets(text_bytes([i])))
                i = heads[a]
                both = len(np.intersect1d(i, j, assume_unique=True))
                keep.append(100 * both >= percent * (len(i) + len(j) - both))
            yield x.loc[np.array(keep, bool), ["a", "b"]]

    side = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}"))
    pairs = stored(pairs)
    hubs = side("a")
    if pairs.select("a").distinct().limit(MOST_HEADS + 1).count() <= MOST_HEADS:
        hubs = stored(hubs.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi"))
        size = hubs.agg(F.sum(F.octet_length("text_a"))).first()[0] or 0
        hubs = F.broadcast(hubs) if size <= HEAD_BYTES else hubs
    found = pairs.join(side("b"), "b").join(hubs, "a").mapInPandas(exact, "a long, b long")
    return stored(found.union(more) if more is not None else found)


def _held(entries: DataFrame) -> DataFrame:
    """sid, company (members of all its buckets) and keys (key, size) of the sets that share a bucket (key, sid)."""
    size = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = entries.join(size, "key").groupBy("sid")  # as many keys as bands
    return stored(rows.agg(F.sum("size").alias("company"), F.collect_list(F.struct("key", "size")).alias("keys")))


def _spanning(held: DataFrame, links: DataFrame | None, wanted: str) -> DataFrame:
    """key, size, sid, label, hub and the hub's label in the buckets (``wanted`` of them) that span components."""
    labelled = held.withColumn("label", F.col("sid"))
    if links is not None:
        labelled = held.join(components(links), F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "sid"))
    rows = labelled.select("sid", "label", "company", F.explode("keys").alias("k")).select("sid", "label", "company", "k.*").where(wanted)
    spans = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("company", F.col("sid").alias("a"), F.col("label").alias("la"))).alias("hub"))
    return stored(rows.drop("company").join(spans.where("lo <> hi").select("key", "hub"), "key"))


def _by_hubs(held: DataFrame, links: DataFrame | None, texts: DataFrame, percent: int) -> DataFrame | None:
    """Links after rounds of hubs in large buckets; the hubs of later rounds are other ones."""
    left, wanted = 0, f"size > {SMALL_BUCKET}"
    for r in range(ROUNDS):
        order = held if not r else held.withColumn("company", F.xxhash64("sid", F.lit(r)))
        rows = _spanning(order, links, wanted)
        count = rows.count()
        if not count or (r and count > 0.7 * left):
            break
        # one hub for each set in a round; its other buckets wait for the next
        pairs = rows.where("label <> hub.la").groupBy(F.col("sid").alias("b")).agg(F.max("hub").alias("hub")).select("hub.a", "b")
        links, left = _confirmed(pairs, texts, percent, links), count
    return links


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut between groups (hub, i, j), of which each lies in one run of rows."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        at = b[["hub", "i", "j"]].to_numpy()
        cut = np.flatnonzero((at != at[-1]).any(axis=1))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if rest and (rest[0][["hub", "i", "j"]].iloc[-1].to_numpy() == at[-1]).all() and not cut:
            rest.append(b)
            continue
        yield pd.concat([*rest, b.iloc[:cut]], ignore_index=True)
        rest = [b.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _hopeful(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set's place and the later ones that the estimate of sketches of equal throws allows."""
    wide = Bands(1, WIDE)
    p = percent / 100
    least = p - 6 * (p * (1 - p) / WIDE) ** 0.5
    throws: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for t in wide.both(len(s), percent):
            throws.setdefault(t, []).append(i)
    for t, at in throws.items():
        regs, at = np.stack([wide.sketch(sets[i], t) for i in at]), np.array(at)
        for k in range(len(at) - 1):
            yield int(at[k]), at[k + 1 :][estimate(regs[k], regs[k + 1 :]) >= least]


def _forest(sets: list[np.ndarray], sid: list, label: list, side: list, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the components (labels) of one group; with two sides only pairs across them are looked at."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    n, full = [len(s) for s in sets], {}
    two = len(set(side)) > 1
    few = ((i, range(i + 1, len(sets))) for i in range(len(sets)))
    for i, others in few if len(sets) <= FEW else _hopeful(sets, percent):
        for j in others:
            if two and side[i] == side[j] or 100 * min(n[i], n[j]) < percent * max(n[i], n[j]):
                continue
            x, y = root(label[i]), root(label[j])
            if x == y:
                continue
            for k in (i, j):
                if k not in full:
                    full[k] = frozenset(sets[k].tolist())
            both = len(full[i] & full[j])
            if 100 * both >= percent * (n[i] + n[j] - both):
                up[max(x, y)] = min(x, y)
                yield sid[i], sid[j]


def _linked(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _together(batches):
            at = b[["hub", "i", "j"]].to_numpy()
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1))).tolist()
            sid, label, side = b["sid"].tolist(), b["label"].tolist(), b["side"].tolist()
            sets, found = shingle_sets(text_bytes(b["text"])), []
            for lo, hi in zip(first, [*first[1:], len(b)], strict=True):
                found += _forest([next(sets) for _ in range(lo, hi)], sid[lo:hi], label[lo:hi], side[lo:hi], percent)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _by_families(rows: DataFrame, texts: DataFrame, percent: int, more: DataFrame | None) -> DataFrame:
    """The links that join components within families (sets that meet under one hub), and the links ``more``."""
    families = stored(rows.select("hub.a", "sid", "label").distinct().withColumnRenamed("a", "hub"))
    members = families.join(texts, "sid")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int")
    blocks = stored(members.groupBy("hub").agg(blocks.alias("blocks")).where("blocks > 1"))
    members = members.join(blocks, "hub", "left").withColumn("side", F.pmod(F.xxhash64("sid"), F.coalesce("blocks", F.lit(1))).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.struct(F.least("side", x).alias("i"), F.greatest("side", x).alias("j")))
    members = members.select("hub", "sid", "label", "side", "text", F.inline(meets)).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    found = members.mapInPandas(_linked(percent), "a long, b long")
    return stored(found.union(more) if more is not None else found)


def near_links(texts: DataFrame, entries: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between sets whose components are those of all pairs at the threshold; None without any candidate.

    ``texts`` holds tid and sid of each set's representative and its text once or more, ``entries`` key and sid.
    """
    held = _held(entries)
    n = held.count()
    if not n:
        return None
    texts = stored(texts.join(small(held.select("sid"), n), "sid", "left_semi").dropDuplicates(["sid"]).select("sid", "text"))
    links, found = None, levels(percent)
    for k, bands in enumerate(found):
        if k:
            held = _held(banded(texts, percent, bands))
        links = _by_hubs(held, links, texts, percent)
        here = _spanning(held, links, f"size <= {DENSE}" if bands is not found[-1] else "true")
        links = _by_families(here, texts, percent, links)
        if bands is not found[-1]:
            dense = stored(_spanning(held, links, f"size > {DENSE}").select("sid").distinct())
            n = dense.count()
            if not n:
                break
            texts = texts.join(small(dense, n), "sid", "left_semi")
    return links


def near_rows(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, tid, n_shingles, component_id, first (the tid of the representative's text)."""
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_id(text).alias("tid"), text.alias("text"))
    table = stored(sketched(docs, percent))
    key = ["n_shingles", "set_a", "set_b"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("least")
    sets = table.where("n_shingles > 0").groupBy(*key).agg(least, F.first("keys").alias("keys"))
    sets = stored(sets.withColumn("sid", F.monotonically_increasing_id()))
    texts = docs.select("tid", "text").join(sets.select(F.col("least.tid").alias("tid"), "sid"), "tid")
    links = near_links(texts, sets.select("sid", F.explode("keys").alias("key")), percent)
    groups = sets.select(*key, "least", "sid")
    if links is not None:
        groups = groups.join(components(links), F.col("sid") == F.col("node"), "left").withColumn("sid", F.coalesce("root", "sid"))
        groups = groups.join(groups.groupBy("sid").agg(F.min("least").alias("group")), "sid")
    else:
        groups = groups.withColumn("group", F.col("least"))
    out = table.select("doc_id", "tid", *key).join(groups.select(*key, "group"), key, "left")
    return out.select("doc_id", "tid", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("group.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("group.tid").alias("first"))


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest document reachable), kept."""
    nobody = F.col("component_id").isNull() & (F.col("first").isNull() | (F.col("tid") == F.col("first")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), nobody)
    return near_rows(docs, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and among its texts the representative.

    Rows without words and rows of equal id and text are all kept; of rows without an id one is. Columns stay as they are.
    """
    doc, tid, n = (unused(c, docs.columns) for c in ("_doc", "_tid", "_copies"))
    rows = near_rows(docs, percent, id_col, text_col)
    count = F.when((F.max("n_shingles") == 0) | F.col("doc_id").isNotNull(), 1).otherwise(F.count(F.lit(1)))
    stays = rows.where("n_shingles = 0 or (doc_id <=> component_id and tid = first)").groupBy("doc_id", "tid").agg(count.alias(n))
    stays = stored(stays.select(F.col("doc_id").alias(doc), F.col("tid").alias(tid), n))
    kept = docs.join(stays.hint("merge"), docs[id_col].cast("long").eqNullSafe(stays[doc]) & (text_id(F.col(text_col)) == stays[tid]))
    out = kept.where(F.col(n) == 1)
    if stays.where(F.col(n) > 1).limit(1).count():  # one text several times without an id
        out = out.union(kept.where(F.col(n) > 1).dropDuplicates([doc, tid]))
    return out.select(*docs.columns)
