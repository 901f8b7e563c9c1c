"""Continuous periods and gaps of overlapping, nested and broken intervals: a distributed sweep line.

Intervals become plus and minus events, and the prefix sum of the events counts the active intervals: where it leaves zero a period opens, where it comes
back to zero one closes. Entities are cut into time buckets of ``bucket`` units, so that an entity with most of the rows is still
many tasks. An interval is sent once to the bucket of its start, and again to that of its end only if this is another; all that follows reads that one
shuffle. The sums of whole buckets, far fewer than the events, give each bucket the count of active intervals at its beginning, and the count runs on inside
the bucket. A boundary's predecessor lies in its bucket or is the last boundary of an earlier one, handed on in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.scan import bucket_key, earlier, with_totals

BUCKET_MS = 600_000


def boundaries(df: DataFrame, entity: list[str], start: str, end: str, bucket: int = BUCKET_MS) -> DataFrame:
    """Every opening and closing of a period: entity..., kind (open, close), at, before, n.

    before: the instant of the preceding boundary of the entity, null at the first. n: at a close the number of intervals
    of the period. Intervals that are null at either end or do not end after their start are left out; those that overlap or
    touch are of one period. Repeated rows count as intervals of their own. An empty table gives an empty table.
    """
    names = [f"e{i}" for i in range(len(entity))]
    rows = df.filter(F.col(end) > F.col(start)).select(*[F.col(c).alias(n) for c, n in zip(entity, names)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    first, last = (bucket_key(names, F.col(c), bucket) for c in "se")
    part = lambda b, s, e: F.struct(b.alias("b"), s.alias("s"), e.alias("e"))
    none = F.lit(None).cast("long")
    parts = F.when(first == last, F.array(part(first, F.col("s"), F.col("e")))).otherwise(F.array(part(first, F.col("s"), none), part(last, none, F.col("e"))))
    rows = rows.select(F.inline(parts)).repartition("b")

    before = earlier("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("b").agg((F.count("s") - F.count("e")).alias("net"), F.count("s").alias("opened"))
    carried = carried.select("b", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("net0"), F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("opened0"))

    event = lambda t, d: F.struct(F.col(t).alias("t"), F.lit(d).alias("d"))
    events = rows.select("b", F.inline(F.array(event("s", 1), event("e", -1)))).filter("t is not null")
    # at one instant what begins comes before what ends, so that intervals which touch are of one period
    inside = Window.partitionBy("b").orderBy("t", F.desc("d"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    counted = with_totals(events.withColumns({"net": F.sum("d").over(upto), "opened": F.count(F.when(F.col("d") > 0, 1)).over(upto)}), carried, "b")
    counted = counted.select("b", "t", "d", (F.col("net0") + F.col("net")).alias("active"), (F.col("opened0") + F.col("opened")).alias("seen"))
    is_open = (F.col("d") > 0) & (F.col("active") == 1)
    edges = counted.filter(is_open | (F.col("active") == 0)).select("b", "t", "d", (F.col("seen") - F.when(F.col("d") > 0, 1).otherwise(0)).alias("seen"))
    edges = edges.withColumn("prev", F.lag(F.struct("t", "seen")).over(inside))
    handed = edges.groupBy("b").agg(F.max(F.struct("t", "seen")).alias("last")).select("b", F.lag("last").over(earlier("b")).alias("handed"))
    prev = F.coalesce(F.col("prev"), F.col("handed"))
    return with_totals(edges, handed, "b").select(
        *[F.col(f"b.k.{n}").alias(c) for c, n in zip(entity, names)],
        F.when(F.col("d") > 0, "open").otherwise("close").alias("kind"), F.col("t").alias("at"),
        prev["t"].alias("before"), F.when(F.col("d") < 0, F.col("seen") - prev["seen"]).alias("n"),
    )


def periods(df: DataFrame, entity: list[str], start: str, end: str, bucket: int = BUCKET_MS) -> DataFrame:
    """entity..., from_ms, to_ms, n of each continuous period."""
    b = boundaries(df, entity, start, end, bucket).filter("kind = 'close'")
    return b.select(*entity, F.col("before").alias("from_ms"), F.col("at").alias("to_ms"), "n")


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, bucket: int = BUCKET_MS) -> DataFrame:
    """entity..., kind (period, gap), from_ms, to_ms, n (of a period; null for a gap)."""
    b = boundaries(df, entity, start, end, bucket).filter("before is not null")
    kind = F.when(F.col("kind") == "close", "period").otherwise("gap")
    return b.select(*entity, kind.alias("kind"), F.col("before").alias("from_ms"), F.col("at").alias("to_ms"), "n")
