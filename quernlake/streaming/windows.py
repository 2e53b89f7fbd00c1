"""Windowed aggregates over streams. The watermark bounds the state: windows close once it passes their end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernlake.functions import aggregates
from quernlake.functions.types import duration_micros


def _span(duration: str) -> str:
    return f"{duration_micros(duration)} microseconds"


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    # watermarks need a time with a zone; the session's is UTC
    return df.withColumn(time, F.col(time).cast(T.TimestampType())).withWatermark(time, _span(late))


def tumbling(df: DataFrame, duration: str, time: str, aggs: Sequence[Column], by: Sequence[str] = (), late: str = "10m", slide: str | None = None) -> DataFrame:
    """``bucket``, ``by`` and the aggregates of each window; with ``slide``, of overlapping windows."""
    window = F.window(time, _span(duration), _span(slide)) if slide else F.window(time, _span(duration))
    out = _timed(df, time, late).groupBy(*by, window).agg(*aggs)
    return out.select(F.col("window.start").cast(T.TimestampNTZType()).alias("bucket"), *[c for c in out.columns if c != "window"])


def candles(df: DataFrame, duration: str, time: str, value: str, by: Sequence[str] = (), late: str = "10m", tie: str | None = None) -> DataFrame:
    aggs = [aggregates.first(value, time, tie=tie).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), aggregates.last(value, time, tie=tie).alias("close"), F.count(F.lit(1)).alias("n")]
    return tumbling(df, duration, time, aggs, by, late)


def sessions(df: DataFrame, gap: str, time: str, aggs: Sequence[Column], by: Sequence[str], late: str = "10m") -> DataFrame:
    """``start``, ``end``, ``by`` and the aggregates of each run of events no further apart than ``gap``."""
    out = _timed(df, time, late).groupBy(*by, F.session_window(time, _span(gap)).alias("_s")).agg(*aggs)
    return out.select(F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), *[c for c in out.columns if c != "_s"])


def distinct_events(df: DataFrame, keys: Sequence[str], time: str, late: str = "10m") -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark passes."""
    return _timed(df, time, late).dropDuplicatesWithinWatermark(list(keys))


def into_table(df: DataFrame, engine, table: str, checkpoint: str, key: str | None = None):
    """Write each micro-batch to a versioned table as one commit; with ``key``, rows of known keys are replaced."""

    def commit(batch: DataFrame, _: int) -> None:
        from quernlake.sources.versioned import Transaction

        t = Transaction(engine.store, "SNAPSHOT")
        names = t.manifest().table(table).names
        replace = {c: F.col(f"new.{c}") for c in names if c != key} if key else None
        t.insert(table, batch.select(*[c for c in batch.columns if c in names]), replace)
        t.commit()

    return df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
