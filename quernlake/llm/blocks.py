"""Documents packed into blocks, and sums of 64-bit keys over all blocks.

A block holds a few megabytes of documents in one row of a stored table that is bucketed by block, so that later
steps read it without a shuffle. What a step needs from the whole corpus it asks for by key: each block sends its
distinct keys (combined, sorted and delta-coded) to ranges of the key space, one task per range adds them up over
all blocks, and the totals come back in the order in which the block asked. A key that every document shares costs
one entry for each block, and neither keys nor totals ever meet on the driver.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm.common import shared_dir, shuffles_removed, text_bytes

#: Text that a bucket of the block table and a range of the key space stand for; Spark allows 100,000 buckets.
BUCKET_BYTES, RANGE_BYTES, MOST_BUCKETS = 64 << 20, 8 << 20, 100_000
#: Documents that reach Python at once while blocks are made.
BATCH_ROWS = 500
REQUEST = "part int, block long, keys binary, counts binary"
REPLY = "block long, kind int, part int, data binary, total long, distinct long"


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array's numbers, all lowest ones first: rows of zeros compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(data, dtype), dtype=dtype)


def pack_counts(a: np.ndarray) -> bytes:
    """Numbers from 0 on, most of them small: a byte each, and those of 255 or more again in full."""
    large = a[a >= 255].astype(np.int64)
    return np.int64(len(a)).tobytes() + np.minimum(a, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, 8 + n)
    return out


def released(frame: pd.DataFrame) -> pd.DataFrame:
    """``frame``, after the allocators gave back what this step freed: waiting workers then hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
    return frame


def text_size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def key_ranges(size: int) -> int:
    """Ranges of the key space for a corpus of so many bytes."""
    return max(8, -(-size // RANGE_BYTES))


def bucket_count(spark: SparkSession, size: int) -> int:
    return min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))


class Replies:
    """Replies of all rounds in one table that is bucketed like the blocks: each is dealt by block once, when it is added.

    The shuffle files of a round go when it is added.
    """

    def __init__(self, spark: SparkSession, size: int):
        self.spark, self.buckets = spark, bucket_count(spark, size)
        self.name, self.path = f"replies_{uuid.uuid4().hex}", shared_dir(spark)

    def add(self, replies: DataFrame) -> None:
        dealt = replies.repartition(self.buckets, "block")
        with shuffles_removed(self.spark):
            dealt.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.buckets, "block").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def block_table(docs: DataFrame, size: int, block_bytes: int, encode: Callable[[pd.DataFrame, list[bytes]], tuple], schema: str) -> DataFrame:
    """``encode`` (rows in order of doc_id, their texts) gives the columns of one block after its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n = TaskContext.get().partitionId() << 24, 0
        rows: list[pd.DataFrame] = []
        names = [c.split()[0] for c in schema.split(", ")]
        held = 0

        def flush() -> pd.DataFrame:
            b = pd.concat(rows, ignore_index=True).sort_values("doc_id", kind="stable", ignore_index=True)
            rows.clear()
            return released(pd.DataFrame([(first + n, *encode(b, text_bytes(b["text"])))], columns=["block", *names]))

        for batch in batches:
            sizes = batch["text"].map(lambda t: len(t) if t else 0).to_numpy()
            lo = 0
            for i, s in enumerate(sizes.tolist()):
                held += s + 8
                if held >= block_bytes:
                    rows.append(batch.iloc[lo : i + 1])
                    yield flush()
                    held, lo, n = 0, i + 1, n + 1
            if lo < len(batch):
                rows.append(batch.iloc[lo:])
        if rows:
            yield flush()

    name, spark = f"blocks_{uuid.uuid4().hex}", docs.sparkSession
    buckets = bucket_count(spark, size)
    made = docs.withColumn("text", F.col("text").cast("binary")).mapInPandas(run, f"block long, {schema}")
    # small batches: Python holds a block and little more
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        made.write.format("parquet").option("path", shared_dir(spark)).bucketBy(buckets, "block").saveAsTable(name)
    finally:
        spark.conf.set(key, before)
    return spark.table(name)


def over_blocks(blocks: DataFrame, replies: DataFrame | None, step: Callable, schema: str) -> DataFrame:
    """``step`` (block row, its replies by kind: (part, data) in order) gives a pandas frame for each block."""

    def alone(b: pd.DataFrame) -> pd.DataFrame:
        return released(step(b.iloc[0], {}))

    def answered(b: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list] = {}
        for kind, part, data in sorted(zip(r["kind"], r["part"], r["data"], strict=True), key=lambda x: x[:2]):
            found.setdefault(int(kind), []).append((int(part), data))
        return released(step(b.iloc[0], found))

    grouped = blocks.groupBy("block")
    if replies is None:
        return grouped.applyInPandas(alone, schema)
    return grouped.cogroup(replies.select("block", "kind", "part", "data").groupBy("block")).applyInPandas(answered, schema)


def ask(block: int, keys: np.ndarray, amounts: np.ndarray, ranges: int, first: int = 0) -> Iterator[tuple]:
    """Requests for the totals of sorted distinct keys, one for each range that they touch; amounts are counts or 32-bit floats.

    Parts are numbered from ``first``: requests of several kinds in one go have ``ranges`` parts each.
    """
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
    pack = planes if amounts.dtype.kind == "f" else pack_counts
    for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            yield first + part, int(block), pack_sorted(keys[a:b]), pack(amounts[a:b])


def totals(requests: DataFrame, ranges: int, kinds: list[tuple[int, float | None]]) -> DataFrame:
    """A reply for each request, with the totals of its keys over all blocks; each range also tells its sum and the keys above 0.

    ``kinds`` has, for each kind asked in turn, its number and what its totals must exceed: such amounts are 32-bit floats
    and the reply is a bit for each key. Without a bound they are counts, and so is the reply.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind, bound = kinds[int(rows["part"].iloc[0]) // ranges]
        keys = [unpack_sorted(k, np.uint64) for k in rows["keys"]]
        amounts = [unpack_counts(c) if bound is None else from_planes(c, np.float32) for c in rows["counts"]]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64 if bound is None else np.float64)
        np.add.at(total, inverse, np.concatenate(amounts))
        reply = pack_counts if bound is None else lambda x: np.packbits(x > bound).tobytes()
        sizes = [len(k) for k in keys]
        told = np.split(total[inverse], np.cumsum(sizes)[:-1])
        out = pd.DataFrame({"block": rows["block"], "kind": kind, "part": rows["part"] % ranges, "data": [np.int64(n).tobytes() * (bound is not None) + reply(x) for n, x in zip(sizes, told, strict=True)]})
        out["total"] = np.concatenate(([int(total.sum())], np.zeros(len(out) - 1, np.int64)))
        out["distinct"] = np.concatenate(([int((total > 0).sum())], np.zeros(len(out) - 1, np.int64)))
        del keys, amounts, distinct, inverse, total, told
        return released(out)

    return requests.groupBy("part").applyInPandas(run, REPLY)


def answer(replies: dict[int, list], kind: int) -> np.ndarray:
    """The totals of one kind, in the order of the keys asked for."""
    got = [unpack_counts(data) for _, data in replies.get(kind, [])]
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def answer_bits(replies: dict[int, list], kind: int) -> np.ndarray:
    """Whether the totals of one kind exceed its bound, in the order of the keys asked for."""
    got = [np.unpackbits(np.frombuffer(data, np.uint8, -1, 8), count=int(np.frombuffer(data, np.int64, 1)[0])).astype(bool) for _, data in replies.get(kind, [])]
    return np.concatenate(got) if got else np.zeros(0, bool)
