"""Times as the tables give them: doubles in seconds, null or NaN where missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FARTHEST = 9e12  # seconds beyond which a time counts as missing, infinities included


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, half to even; null for null, NaN and what does not fit."""
    return F.when(F.abs(seconds) <= FARTHEST, F.rint(seconds * 1000).cast("long"))


def timed(start_ms: Column, end_ms: Column) -> Column:
    return F.coalesce(end_ms > start_ms, F.lit(False))
