"""Scalar functions with the dialect's semantics. All are built-in expressions, so plans stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernlake.functions.types import duration_micros, kind_of, parse_timestamp, spark_type

VERSION = "0.1.0"
#: Units that DATE_TRUNC takes.
DATE_UNITS = ("year", "month", "day", "hour", "minute", "second")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def abs_(c: Column | str) -> Column:
    return F.abs(_col(c).cast("double"))


def ceiling(c: Column | str) -> Column:
    return F.ceil(_col(c).cast("double")).cast("double")


def floor(c: Column | str) -> Column:
    return F.floor(_col(c).cast("double")).cast("double")


def round_(c: Column | str, digits: int = 0) -> Column:
    """Half away from zero, as double."""
    return F.round(_col(c).cast("double"), digits)


def length(c: Column | str) -> Column:
    """Bytes of the UTF-8 text."""
    return F.octet_length(_col(c).cast("string")).cast("long")


def substring(c: Column | str, start: int, size: int | None = None) -> Column:
    """Characters from ``start`` (from 1, smaller ones count as 1); a size of 0 or less gives an empty text."""
    text = _col(c).cast("string")
    return F.substring(text, max(1, start), (1 << 31) - 1 if size is None else max(0, size))


def concat(*cols: Column | str) -> Column:
    """Texts joined; NULLs are skipped."""
    return F.concat_ws("", *[_col(c).cast("string") for c in cols])


def blank_to_null(c: Column | str) -> Column:
    """NULL for an empty text, whatever the type."""
    c = _col(c)
    return F.when(c.cast("string") != "", c)


def coalesce(*cols: Column | str) -> Column:
    """The first value that is neither NULL nor an empty text."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def collate(c: Column | str, name: str) -> Column:
    """The text under which values compare equal in a collation."""
    c, name = _col(c), name.upper()
    if name in ("BINARY", "NUMERIC"):
        return c
    if name in ("NOCASE", "CASE_INSENSITIVE"):
        return F.lower(c)
    if name in ("NOACCENT", "ACCENT_INSENSITIVE"):
        return F.translate(c, ACCENTED, PLAIN)
    raise ValueError(f"unknown collation: {name}")


#: Latin-1 letters with marks, and the letters without them.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


def date_trunc(unit: str, c: Column | str) -> Column:
    if unit.lower() not in DATE_UNITS:
        raise ValueError(f"unknown unit: {unit}")
    return F.date_trunc(unit.lower(), _col(c)).cast(T.TimestampNTZType())


def time_trunc(duration: str, c: Column | str) -> Column:
    """The start of the bucket of a duration, counted from 1970-01-01."""
    size = duration_micros(duration)
    micros = F.unix_micros(_col(c).cast(T.TimestampType()))
    return F.timestamp_micros(micros - micros % size).cast(T.TimestampNTZType())


def cast(c: Column | str, name: str) -> Column:
    """The dialect's cast: NULL where a value has no such form."""
    c, kind = _col(c), kind_of(name)
    if kind == "TIMESTAMP":
        return parse_timestamp(c)
    if kind == "JSON":
        return F.when(F.try_parse_json(c.cast("string")).isNotNull(), c.cast("string"))
    if kind == "INTEGER":
        return F.coalesce(c.try_cast("bigint"), F.when(F.abs(c.cast("string").try_cast("double")) < 2.0**63, c.cast("string").try_cast("double").cast("bigint")))
    return c.try_cast(spark_type(name))


def now() -> Column:
    return F.current_timestamp().cast(T.TimestampNTZType())


def version() -> Column:
    return F.lit(VERSION)
