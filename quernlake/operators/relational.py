"""Relational operators where Spark's own need a definite form: null order, null-safe keys, range joins, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlake.functions import aggregates, scalar


def where_true(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is TRUE."""
    return df.where(condition)


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """``"name"`` or ``"name DESC"``: NULLs last ascending, first descending."""
    out = []
    for k in keys:
        name, _, way = k.partition(" ")
        out.append(F.col(name).desc_nulls_first() if way.strip().upper() == "DESC" else F.col(name).asc_nulls_last())
    return df.orderBy(*out)


def top_k(df: DataFrame, k: int, *keys: str, offset: int = 0) -> DataFrame:
    """The first rows in an order; Spark keeps k rows a task and never sorts everything."""
    out = order_by(df, *keys)
    return (out.offset(offset) if offset else out).limit(k)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join whose NULL keys match each other."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rest = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    key = lambda k: F.coalesce(f"l.{k}", f"r.{k}").alias(k)
    return l.join(r, on, how).select(*[key(k) for k in keys], *[F.col(f"l.{c}") for c in left.columns if c not in keys], *rest)


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points joined with the half-open spans [start, end) that hold them, on buckets of ``width`` instead of all pairs.

    Each span is listed under every bucket that it touches, so ``width`` should be about a usual span. A point has
    one bucket, so no pair is met twice, and a span that crosses many buckets spreads over as many tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    p = points.withColumn("_bucket", bucket(at))
    s = spans.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    on = (p["_bucket"] == s["_bucket"]) & (p[at] >= s[start]) & (p[at] < s[end])
    return p.join(s, on, how).drop("_bucket")


def group_by(df: DataFrame, keys: Sequence[Column | str], aggregates_: Sequence[Column], having: Column | None = None) -> DataFrame:
    """GROUP BY with HAVING; keys may be expressions with aliases."""
    out = df.groupBy(*keys).agg(*aggregates_)
    return out if having is None else out.where(having)


def numbered(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "row_number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def candles(df: DataFrame, duration: str, time: str, value: str, volume: str | None = None, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """open, high, low, close, n and volume of each time bucket. One shuffle, combined before it; no sort of the rows."""
    bucket = scalar.time_trunc(duration, time).alias("bucket")
    aggs = [
        aggregates.first(value, time, tie=tie).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        aggregates.last(value, time, tie=tie).alias("close"),
        F.count(F.lit(1)).alias("n"),
    ]
    if volume:
        aggs.append(F.sum(volume).alias("volume"))
    return df.groupBy(*by, bucket).agg(*aggs)
