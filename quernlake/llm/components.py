"""Connected components of a link table.

Up to ``FEW_LINKS`` distinct links are joined up by one task in a few megabytes; more by alternating large-star and
small-star steps, without gathering links anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import stored

FEW_LINKS = 200_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "root": [root(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links`` (a, b, longs) that isn't itself a root."""
    e = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.count() <= few:
        return e.coalesce(1).mapInPandas(_joined, "node long, root long")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen or not state["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
        e = stored(_small_star(_large_star(e)))
