"""Rows that arrive more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: str, arrived: str, columns: list[str]) -> DataFrame:
    """One row per key: the one that arrived first, a missing arrival last, ties by the values of ``columns``.

    Only ``columns`` (orderable; arrays and structs are) are kept beside the key and the arrival. Rows without a key repeat nothing: each is kept.
    The minimum is taken map-side first, so a key that is delivered very often moves one row per task.
    """
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    row = F.struct(F.col(arrived).isNull().alias("late"), F.col(arrived).alias("at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    first = df.groupBy(F.col(key).alias("key"), own.alias("own")).agg(F.min(row).alias("row"))
    return first.select(F.col("key").alias(key), F.col("row.at").alias(arrived), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])
