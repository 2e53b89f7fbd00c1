"""Helpers shared by the training-data operators: shared storage, text rules and vectorised hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which an id or digest list may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 500_000
#: Stands for a missing document id: behind all others.
NO_ID = (1 << 63) - 1
#: Spark's setting under which a finished execution removes the files of its shuffles.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that the numpy kernels handle at once.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the cluster's checkpoint folder; a temporary one only where none is set (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        conf = jdir.get() if jdir.isDefined() else "file://" + tempfile.mkdtemp(prefix="quernlake-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return f"{conf.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write in here go when it ends; else they stay until the driver's heap happens to be collected."""
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def stored(df: DataFrame, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only if its counted ``rows`` are few; else Spark shuffles the join."""
    return F.broadcast(df) if rows <= most else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the fast built-in path."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, up, low))


def once(c: Column) -> Column:
    """``c``, worked out for its row at once: generated code else puts it off into the loop of a join or an explode above it.

    Filters are not pushed through it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def known_id(c: Column) -> Column:
    """A long id for Python code; a missing one becomes NO_ID, so that pandas keeps whole numbers."""
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def text_id(text: Column) -> Column:
    """What tells rows of different texts apart, whatever their ids: MD5 of the text's bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def id_or_null(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer where a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- vectorised hashing -------------------------------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _B), ("down", _BINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] the positional hash of buf[i:j], up to the factor that ``span_hash`` removes."""
    _, down = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * down[:-1], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the buffer under ``prefix``."""
    up, _ = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64))


def text_bytes(values) -> list[bytes]:
    """UTF-8 bytes of the texts; null counts as empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") if isinstance(v, str) else bytes(v) for v in values]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes together."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased buffer, starts and ends of the words between ASCII white space, and the first word of each text."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    gap = SPACE[buf]
    edge = np.diff(np.concatenate(([True], gap)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return buf, starts, ends, np.searchsorted(starts, begins)
