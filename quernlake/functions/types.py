"""Type names of the dialect, literals, durations and timestamp texts."""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of the dialect and the kinds that they stand for.
SPELLINGS = {
    "INT": "INTEGER", "INTEGER": "INTEGER", "BIGINT": "INTEGER", "SMALLINT": "INTEGER", "TINYINT": "INTEGER",
    "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "FLOAT",
    "TEXT": "TEXT", "VARCHAR": "TEXT", "CHAR": "TEXT", "STRING": "TEXT",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN",
    "TIMESTAMP": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "DATETIME": "TIMESTAMP", "DATE": "TIMESTAMP", "TIME": "TIMESTAMP",
    "JSON": "JSON",
}
SPARK = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType(), "JSON": T.StringType()}
#: Layouts in which a text may give a time, tried in this order.
LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "HH:mm:ss", "HH:mm", "h:mm:ss a", "h:mm a",
]
#: Microseconds of a duration's units.
MICROS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
#: Seconds of an interval's units; months have 30 days and years 365.
SECONDS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3_600, "DAY": 86_400, "WEEK": 604_800, "MONTH": 2_592_000, "YEAR": 31_536_000}


def kind_of(name: str) -> str:
    """The dialect's kind for a type name; other names are an error."""
    try:
        return SPELLINGS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown type: {name}") from None


def spark_type(name: str) -> T.DataType:
    return SPARK[kind_of(name)]


def duration_micros(text: str) -> int:
    """Microseconds of a duration such as ``15m``, ``1h30m`` or ``300ms``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"not a duration: {text!r}")
    total = round(sum(float(n) * MICROS[u] for n, u in parts))
    if total <= 0:
        raise ValueError(f"a duration must be at least a microsecond: {text!r}")
    return total


def interval_seconds(text: str) -> int:
    """Seconds of an interval text such as ``3 months``."""
    m = re.fullmatch(r"\s*([+-]?\d+)\s*([A-Za-z]+?)s?\s*", text)
    if not m or m[2].upper() not in SECONDS:
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * SECONDS[m[2].upper()]


def parse_timestamp(c: Column) -> Column:
    """A time from a text in any of the known layouts (or from a time); NULL if none fits."""
    text = c.cast("string")
    tries = [F.try_to_timestamp(text, F.lit(layout)).cast(T.TimestampNTZType()) for layout in LAYOUTS]
    return F.coalesce(text.try_cast(T.TimestampNTZType()), *tries)


def literal(value) -> str:
    """SQL text of a parameter's value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value) if abs(value) < 1 << 31 else f"{value}L"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, Decimal):
        return f"CAST('{value}' AS DOUBLE)"
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ'{value.replace(tzinfo=None).isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"TIMESTAMP_NTZ'{value.isoformat()} 00:00:00'"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    raise TypeError(f"no literal for {type(value).__name__}")
