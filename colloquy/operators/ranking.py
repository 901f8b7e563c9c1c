"""Choices among candidates: ranks, first ready ones, queues, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_candidates(df: DataFrame, keys: list[str], seen: str, score: Column, tie: str) -> DataFrame:
    """One row for each key, the one seen first, with ``score`` and its ``place`` from 0 by falling score, then by ``tie``. The places are those of a listing,
    within each value of the first key."""
    columns = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), seen).alias("__f")).select(*keys, "__f.*")
    scored = first.withColumn("score", score)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(keys[0]).orderBy(F.desc("score"), tie)) - 1)


def first_ready(df: DataFrame, key: str, value: str, ready: Column, priority: Column) -> DataFrame:
    """key, value of the ready candidate of least priority, ties by value; null where none is ready."""
    return df.groupBy(key).agg(F.min(F.when(ready, F.struct(priority.alias("p"), F.col(value).alias("v")))).alias("b")).select(key, F.col("b.v").alias(value))


def queue_order(df: DataFrame, queue: str, priority: Column, arrival: list[str]) -> DataFrame:
    """The rows with ``turn`` from 0: the highest priority first, first in first out among equals."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(queue).orderBy(priority.desc(), *arrival)) - 1)


def by_alias(names: DataFrame, name: str, entries: DataFrame, entry: str, aliases: str) -> DataFrame:
    """name, entry of each name that is an entry's own or one of its aliases, in any case and with any surrounding space; the least entry of several."""
    known = entries.select(entry, F.explode(F.array_append(F.coalesce(F.col(aliases), F.array().cast("array<string>")), F.col(entry))).alias("a"))
    known = known.groupBy(F.lower(F.trim("a")).alias("a")).agg(F.min(entry).alias(entry))
    return names.select(name, F.lower(F.trim(name)).alias("a")).distinct().join(known, "a").select(name, entry)
