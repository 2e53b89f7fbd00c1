"""Readers and writers of plain files. Schemas are given or read from the files' own metadata, never by a data pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Formats whose files hold their schema.
SELF_DESCRIBING = ("parquet", "orc")


def read(spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A lazy scan; CSV and JSON need a schema, so that reading them never scans the data twice."""
    if fmt not in SELF_DESCRIBING and schema is None:
        raise ValueError(f"{fmt} files need a schema")
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Iterable[str] = (), cluster_by: Iterable[str] = (), **options: str) -> None:
    """``cluster_by`` sorts the rows of each file, so that row-group bounds let later scans skip."""
    cluster = list(cluster_by)
    out = df.sortWithinPartitions(*cluster) if cluster else df
    w = out.write.format(fmt).mode(mode).options(**options)
    parts = list(partition_by)
    (w.partitionBy(*parts) if parts else w).save(path)


def register(spark: SparkSession, directory: str, names: Iterable[str], fmt: str = "parquet") -> None:
    """Temporary views of ``directory/name.fmt``."""
    for name in names:
        read(spark, f"{directory}/{name}.{fmt}", fmt).createOrReplaceTempView(name)
