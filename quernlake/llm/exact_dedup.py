"""Exact deduplication with a log-structured merge index of content digests, in DataFrame operations only.

The digests of all rows are written to a log once, each scan task to one of ``MEMTABLES`` memtables. ``insert`` flushes a
memtable as a run, one entry (digest, best identifier, number of rows) for each digest, sorted by digest and combined
before its shuffle, with a filter: bitmaps of 32768 bits, one for each block of digests, at ``BITS`` bits an entry. A new
run probes the filters of all runs that are live, and what passes is looked up in the run itself; digests found there
are hits. ``FANOUT`` runs of one level are merged into one of the next, whose entries keep the smallest identifier in the
index's order (``keep="max"`` reverses that order). Hits and entries of several rows are all that is looked up at the
end, and the texts behind them are compared byte for byte.

Defined results: a null text counts as empty, so nulls and empty texts form one group; repeated ids are rows
of their own in a group's size; a row without an id stays only if no row of its group has one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm.common import shared_dir, small, stored

#: Memtables of a table, runs of a level that are merged, and filter bits of an entry.
MEMTABLES, FANOUT, BITS = 4, 3, 16
#: Bits of a block of a filter (the size that ``bitmap_construct_agg`` has), and blocks of 4 KB that may be broadcast.
BLOCK_BITS, BROADCAST_BLOCKS = 32768, 4096
#: Digests, or classes with two of them, that may be broadcast.
BROADCAST_HITS = 100_000


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Run:
    entries: DataFrame
    bits: DataFrame
    blocks: int


class DigestIndex:
    """Runs of (digest, keep_id, n) in a shared folder, by level. ``insert`` adds a run, ``hits`` has the digests of several rows."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min", digest=_sha):
        if keep not in ("min", "max"):
            raise ValueError(f"keep is 'min' or 'max', not {keep!r}")
        self.spark, self.path, self.digest = spark, path or shared_dir(spark), digest
        self.best = F.min if keep == "min" else F.max
        self.levels: list[list[Run]] = []
        self.found: list[DataFrame] = []
        self.written = 0

    def keyed(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", self.digest(F.col("text")).alias("digest"), _sha(F.col("text")).alias("sha"))

    def log(self, keyed: DataFrame) -> DataFrame:
        """All rows (digest, sha, doc_id), each with the memtable that takes it."""
        rows = keyed.select("digest", "sha", "doc_id", F.pmod(F.spark_partition_id(), F.lit(MEMTABLES)).alias("memtable"))
        rows.write.partitionBy("memtable").parquet(f"{self.path}/log")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/log")

    @staticmethod
    def _place(blocks: int) -> tuple[Column, Column]:
        """Block and bit of a digest in a filter of so many blocks."""
        h = F.xxhash64("digest")
        return F.pmod(F.shiftright(h, 15), F.lit(blocks)).alias("block"), F.pmod(h, F.lit(BLOCK_BITS)).alias("bit")

    def _flush(self, entries: DataFrame) -> Run:
        at = f"{self.path}/run{self.written}"
        self.written += 1
        kept = stored(entries.sortWithinPartitions("digest"), at)
        blocks = max(1, -(-kept.count() * BITS // BLOCK_BITS))
        # entries are distinct, so blocks are even; they are dealt by block, as bitmaps of all blocks in each task would be larger
        bits = kept.select(*self._place(blocks)).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        return Run(kept, stored(bits, f"{at}_filter"), blocks)

    def maybe(self, entries: DataFrame, run: Run) -> DataFrame:
        """Digests of ``entries`` that pass the filter of ``run``: all that it holds, and few others."""
        block, bit = self._place(run.blocks)
        is_set = F.expr("getbit(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(bit % 8 as int)) = 1")
        return entries.select("digest", block, bit).join(small(run.bits, run.blocks, BROADCAST_BLOCKS), "block").where(is_set).select("digest")

    def live(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def insert(self, rows: DataFrame) -> None:
        """Flush a memtable (digest, doc_id), probe the live runs for its digests, and merge levels that are full."""
        run = self._flush(rows.groupBy("digest").agg(self.best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        for i, old in enumerate(self.live()):
            hits = self.maybe(run.entries, old).join(old.entries.select("digest"), "digest", "left_semi")
            self.found.append(stored(hits, f"{self.path}/hits{self.written}_{i}"))
        self._push(run, 0)

    def _push(self, run: Run, level: int) -> None:
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self._push(self._flush(merged), level + 1)

    def _merged(self, runs: list[Run]) -> DataFrame:
        entries = reduce(DataFrame.unionByName, [r.entries for r in runs])
        return entries.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def hits(self) -> DataFrame:
        """Digests of several rows, each once: entries of several rows and what probes have found."""
        several = [r.entries.where("n > 1").select("digest") for r in self.live()]
        return stored(reduce(DataFrame.unionByName, several + self.found).distinct(), f"{self.path}/hits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=_sha) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text's UTF-8 bytes).

    ``digest`` may be any column function; equal digests of different texts are told apart by their bytes.
    """
    index = DigestIndex(docs.sparkSession, keep=keep, digest=digest)
    keyed = index.keyed(docs, id_col, text_col)
    rows = index.log(keyed)
    for m in range(MEMTABLES):
        index.insert(rows.where(F.col("memtable") == m))
    hits = index.hits()
    found = small(hits, hits.count(), BROADCAST_HITS)
    # the bytes themselves are the grouping key, so a group is equal texts, not equal digests
    classes = keyed.join(found, "digest", "left_semi").groupBy("digest", "text").agg(index.best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("digest", _sha(F.col("text")).alias("sha"), "keep_id", "group_size")
    verified = stored(classes.where("group_size > 1"), f"{index.path}/verified")
    # a weak digest may join different texts; the verified class is found by digest and SHA-256 together
    out = rows.drop("memtable").join(small(verified, verified.count(), BROADCAST_HITS), ["digest", "sha"], "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
