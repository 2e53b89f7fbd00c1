"""Aggregates with the dialect's semantics; all combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernlake.functions.scalar import _col, blank_to_null


def first(value: Column | str, order: Column | str | None = None, descending: bool = False, tie: Column | str | None = None) -> Column:
    """The first value that is neither NULL nor ''; by ``order``, rows without an order key are skipped.

    Without ``order`` the row is any of the group's. ``tie`` makes equal order keys definite.
    """
    v = blank_to_null(value)
    if order is None:
        return F.first(v, ignorenulls=True)
    o = _col(order)
    key = F.when(v.isNotNull() & o.isNotNull(), o if tie is None else F.struct(o, _col(tie)))
    return (F.max_by if descending else F.min_by)(v, key)


def last(value: Column | str, order: Column | str | None = None, descending: bool = False, tie: Column | str | None = None) -> Column:
    """The last such value."""
    if order is None:
        return F.last(blank_to_null(value), ignorenulls=True)
    return first(value, order, not descending, tie)
