"""Timestamp helpers.  Every timestamp is TIMESTAMP_NTZ, so no result depends on
the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), to_col(c))


def from_micros(c) -> Column:
    """TIMESTAMP_NTZ from microseconds since the epoch."""
    return F.timestamp_add("MICROSECOND", to_col(c), F.expr(_EPOCH))


def month_label(c) -> Column:
    return F.date_format(to_col(c), "yyyy-MM")


def year_label(c) -> Column:
    return F.date_format(to_col(c), "yyyy")
