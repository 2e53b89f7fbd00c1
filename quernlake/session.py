"""Spark sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What queries of the dialect need: UTC, and errors of single values as NULL (division by zero, bad casts).
DIALECT = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.caseSensitive": "false",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}
#: Plans that adapt to the sizes met at run time.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for programs of their own; on a cluster, submit settings win where nothing is given."""
    b = SparkSession.builder.appName("quernlake")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {**ADAPTIVE, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": os.environ.get("SPARK_UI", "false"), **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def dialect(spark: SparkSession) -> SparkSession:
    """A session of the same application under the dialect's settings; the caller's session keeps its own."""
    own = spark.newSession()
    for k, v in DIALECT.items():
        own.conf.set(k, v)
    return own
