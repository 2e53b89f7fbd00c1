"""Changes of tables as DataFrame transformations: each takes the rows before and gives the rows after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated(df: DataFrame, assignments: Mapping[str, Column], condition: Column | None = None) -> DataFrame:
    """Rows that meet the condition get new values, computed from the row as it was."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    kinds = dict(df.dtypes)
    return df.select(*[F.when(hit, assignments[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in df.columns])


def deleted(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows that don't meet the condition; NULL doesn't meet it."""
    return df.where(F.lit(False)) if condition is None else df.where(~F.coalesce(condition, F.lit(False)))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without NULLs that several rows share."""
    whole = df.dropna(subset=list(keys)) if keys else df
    return whole.groupBy(*keys).count().where("count > 1").drop("count")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], on_match: Mapping[str, Column] | None = None) -> DataFrame:
    """Source rows are inserted, or update the row of their key.

    ``on_match`` computes new values from ``t.`` and ``s.`` columns; without it, the source's values are taken.
    Keys of the source must be unique.
    """
    return merge(target, source, keys, on_match if on_match is not None else {c: F.col(f"s.{c}") for c in target.columns if c not in keys}, insert=True)


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Mapping[str, Column] | None = None, delete: Column | None = None, insert: bool | Column = True, update_if: Column | None = None) -> DataFrame:
    """MERGE by a single full outer join on the keys.

    Matched rows go where ``delete`` holds, else take ``update`` where ``update_if`` holds; unmatched source rows come
    in where ``insert`` holds. Expressions name columns as ``t.x`` and ``s.x``. Keys of the source must be unique.
    """
    t, s = target.withColumn("_in_t", F.lit(True)).alias("t"), source.withColumn("_in_s", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    matched = F.col("t._in_t").isNotNull() & F.col("s._in_s").isNotNull()
    only_s = F.col("t._in_t").isNull()
    stays = F.lit(True)
    if delete is not None:
        stays = stays & ~F.coalesce(matched & delete, F.lit(False))
    come = F.lit(insert) if isinstance(insert, bool) else F.coalesce(insert, F.lit(False))
    stays = stays & (~only_s | come)
    change = matched if update_if is None else matched & F.coalesce(update_if, F.lit(False))
    out = []
    for name, kind in target.dtypes:
        mine = F.col(f"t.{name}")
        new = update.get(name, mine) if update else mine
        inserted = F.col(f"s.{name}") if name in source.columns else F.lit(None)
        out.append(F.when(only_s, inserted).when(change, new).otherwise(mine).cast(kind).alias(name))
    return both.where(stays).select(*out)
