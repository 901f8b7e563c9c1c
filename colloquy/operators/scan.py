"""Running aggregates and neighbours along the time of an entity, in two levels.

A window over an entity puts all its rows into one task. Here an entity is cut into time buckets; a window runs inside each, and what
the earlier buckets add, one row per bucket, is carried in by a small join. Rows of one bucket are ordered by ``order``, whose first
column must grow with ``at``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

BUCKET = 600.0


def cut_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only where none is named, as in a local test, one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="colloquy-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, computed once and read by all that follows."""
    cut_folder(df.sparkSession)
    return df.checkpoint()


def bucket_key(entity: list[str], at: Column, bucket: float) -> Column:
    """The entity and its time bucket as one value. A struct is never null and equal where its fields are, nulls included, so that groups, windows and joins
    by it are all served by one shuffle."""
    return F.struct(F.struct(*entity).alias("k"), F.floor(at / F.lit(bucket)).alias("b"))


def with_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """The rows with the totals of their bucket."""
    return rows.join(totals.withColumnRenamed(key, "__r"), F.col(key) == F.col("__r"), "left").drop("__r")


def earlier(key: str) -> WindowSpec:
    """The earlier buckets of a bucket's entity."""
    return Window.partitionBy(f"{key}.k").orderBy(f"{key}.b")


def _bucketed(df: DataFrame, entity: list[str], at: str, bucket: float) -> DataFrame:
    return df.withColumn("__b", bucket_key(entity, F.col(at), bucket)).repartition("__b")


def running(df: DataFrame, entity: list[str], at: str, order: list[str], totals: dict[str, tuple[str, Column]], inclusive: bool = False, bucket: float = BUCKET) -> DataFrame:
    """Adds each total (max or sum) of the entity's earlier rows, with ``inclusive`` of the row too; null where there are none."""
    rows = _bucketed(df, entity, at, bucket)
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = earlier("__b").rowsBetween(Window.unboundedPreceding, -1)
    fn = {"max": F.max, "sum": F.sum}
    carried = rows.groupBy("__b").agg(*[fn[how](c).alias(f"__c_{n}") for n, (how, c) in totals.items()])
    carried = carried.select("__b", *[fn[how](f"__c_{n}").over(before).alias(f"__c_{n}") for n, (how, _) in totals.items()])
    rows = rows.withColumns({f"__i_{n}": fn[how](c).over(inside) for n, (how, c) in totals.items()})
    rows = with_totals(rows, carried, "__b")
    for n, (how, _) in totals.items():
        a, b = F.col(f"__c_{n}"), F.col(f"__i_{n}")
        rows = rows.withColumn(n, F.greatest(a, b) if how == "max" else F.coalesce(a + b, a, b))
    return rows.drop("__b", *[f"__{x}_{n}" for n in totals for x in "ci"])


def neighbours(df: DataFrame, entity: list[str], at: str, order: list[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None, bucket: float = BUCKET) -> DataFrame:
    """Adds columns of the entity's preceding (``before``: new name -> column) and following row, null where there is none."""
    rows = _bucketed(df, entity, at, bucket)
    inside = Window.partitionBy("__b").orderBy(*order)
    ends, added = [], {}
    for names, near, edge, sign in ((before, F.lag, F.max, "p"), (after, F.lead, F.min, "n")):
        if names:
            what = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
            ends.append((edge(F.struct(F.struct(*order).alias("o"), what.alias("v"))).alias(f"__{sign}"), near(F.col(f"__{sign}.v")).over(earlier("__b")).alias(f"__{sign}e")))
            added[f"__{sign}i"] = near(what).over(inside)
    carried = rows.groupBy("__b").agg(*[e for e, _ in ends]).select("__b", *[x for _, x in ends])
    rows = with_totals(rows.withColumns(added), carried, "__b")
    for names, sign in ((before, "p"), (after, "n")):
        if names:
            value = F.coalesce(f"__{sign}i", f"__{sign}e")
            rows = rows.withColumns({n: value[n] for n in names}).drop(f"__{sign}i", f"__{sign}e")
    return rows.drop("__b")


def islands(df: DataFrame, entity: list[str], start: str, end: str, order: list[str], gap: float, least: float | None = None, name: str = "island") -> DataFrame:
    """Numbers stretches between which nothing reaches over: a row begins one where its start is more than ``gap`` beyond all earlier
    ends and, with ``least``, at least that much of it comes before its end and before the next start.

    Each step shuffles its input once, by bucket, and reads that shuffle for the rows and for what buckets hand on.
    """
    rows = df
    if least is not None:
        rows = neighbours(rows, entity, start, order, after={"__next": start})
    rows = running(rows, entity, start, order, {"__top": ("max", F.col(end))})
    fresh = F.col("__top").isNull() | (F.col(start) > F.col("__top") + F.lit(gap))
    if least is not None:
        fresh &= F.least(F.col(end), F.col("__next")) - F.col(start) >= least
    rows = rows.withColumn("__fresh", fresh.cast("int")).drop("__top", "__next")
    return running(rows, entity, start, order, {name: ("sum", F.col("__fresh"))}, inclusive=True).drop("__fresh")
