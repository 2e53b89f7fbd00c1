"""Reads of row histories as of a transaction or a time.

A history has one row per version: row id, transaction, time of creation, a deletion mark, data. The newest version of
each row is found by an aggregation that combines before its only shuffle, not by sorting windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(history: DataFrame, row_id: str, order: Sequence[str], deleted: str | Column | None = None, upto: Column | None = None) -> DataFrame:
    """The newest version of each row among those that ``upto`` admits; rows whose newest version is deleted go."""
    seen = history if upto is None else history.where(upto)
    rest = [c for c in history.columns if c != row_id]
    picked = seen.groupBy(row_id).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(row_id, "_v.*")
    if deleted is None:
        return picked
    gone = F.col(deleted) if isinstance(deleted, str) else deleted
    return picked.where(~F.coalesce(gone, F.lit(False)))


def as_of_transaction(history: DataFrame, n: int, row_id: str = "_row_id", txn: str = "_txn_id", deleted: str | Column | None = "_deleted") -> DataFrame:
    return newest(history, row_id, [txn], deleted, F.col(txn) <= n)


def as_of_timestamp(history: DataFrame, at: Column, row_id: str = "_row_id", txn: str = "_txn_id", time: str = "_create_time", deleted: str | Column | None = "_deleted") -> DataFrame:
    return newest(history, row_id, [time, txn], deleted, F.col(time) <= at)
