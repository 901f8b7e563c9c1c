"""Each point in time paired with the interval nearest to it, within a tolerance, of the same entity.

Points and intervals are hash-partitioned by entity and time bucket, an interval into every bucket from which a point could reach it,
so that a large entity is spread over many partitions. A task streams its rows, sorted by bucket, as Arrow groups: whole buckets
up to ``CHUNK`` rows, a larger bucket in parts, of which each has all intervals of the bucket and some of its points. So the groups follow the
rows, and a task holds a group and the intervals of one bucket. Inside a group DuckDB runs three ASOF joins: backward to the
stretch of time in which one interval is the innermost that holds the point, backward to the last end and forward to the next
start. The nearest candidate within the tolerance is taken; at equal distance the interval that starts latest, then the
smallest key.

An interval of up to ``SPAN`` buckets is copied into each; a longer one only into buckets of its entity in which there are points.

Defined results: points without entity, time or key and intervals without entity, key or a positive length are left out; a
point that repeats (same key, entity and time) comes out once; an empty table on either side gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrow import numbered
from colloquy.functions.cover import places, top_cover

BUCKET_MS = 300_000
SPAN = 16
CHUNK = 100_000
_OUT = pa.schema([("point", pa.int64()), ("interval", pa.int64()), ("distance", pa.int64())])

JOINS = """
with inside as (select w.point, c.interval, 0 distance, c.s from w asof join covered c on w.g = c.g and w.t >= c.at where c.interval is not null),
back as (select w.point, e.interval, w.t - e.e distance, e.s from w asof join (
  select g, e, max(s) s, arg_min(interval, (-s, interval)) interval from intervals group by all) e on w.g = e.g and w.t >= e.e),
ahead as (select w.point, s.interval, s.s - w.t distance, s.s from w asof join (
  select g, s, min(interval) interval from intervals group by all) s on w.g = s.g and w.t <= s.s)
select point, arg_min(interval, (distance, -s, interval)) interval, min(distance) distance
from (select * from inside union all select * from back union all select * from ahead) where distance <= {tolerance} group by point
"""


def innermost(g: np.ndarray, s: np.ndarray, e: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of intervals of groups: group, instant and number of the interval that starts latest (the smallest key of equals) of those that hold each
    instant from this one until the next; -1 where nothing does. Ends belong to their interval."""
    order = np.lexsort((-key, s, g))
    group, at, number = places(np.concatenate([g, g]), np.concatenate([s, e + 1]))
    top = top_cover(len(group), number[: len(g)][order], number[len(g) :][order])
    return group, at, np.where(top >= 0, order[np.maximum(top, 0)], -1)


def _pair(tolerance: int):
    sql = JOINS.format(tolerance=int(tolerance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})

        def joined(rows: pa.Table, g: np.ndarray) -> Iterator[pa.RecordBatch]:
            point = np.asarray(rows["point"])
            s, e, own = (np.asarray(rows[c]) for c in ("s", "e", "id"))
            if not point.any() or point.all():
                return
            iv = ~point
            w = pa.table({"g": g[point], "t": s[point], "point": own[point]})
            intervals = pa.table({"g": g[iv], "s": s[iv], "e": e[iv], "interval": own[iv]})
            grp, at, top = innermost(g[iv], s[iv], e[iv], own[iv])
            held = top >= 0
            covered = pa.table({"g": grp, "at": at, "interval": pa.array(own[iv][top], mask=~held), "s": pa.array(s[iv][top], mask=~held)})
            for name, t in (("w", w), ("intervals", intervals), ("covered", covered)):
                con.register(name, t)
            yield from con.sql(sql).to_arrow_table().cast(_OUT).to_batches()

        held: list[pa.RecordBatch] = []
        n = 0
        try:
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n < CHUNK:
                    continue
                rows, g = numbered(held, ["ent", "b"])
                cut = int(np.searchsorted(g, g[-1]))  # the last bucket may go on
                if cut:
                    yield from joined(rows.slice(0, cut), g[:cut])
                    rows = rows.slice(cut)
                else:
                    yield from joined(rows, g)
                    rows = rows.filter(pc.invert(rows["point"]))
                held, n = rows.to_batches(), rows.num_rows if cut else 0
            if held:
                yield from joined(*numbered(held, ["ent", "b"]))
        finally:
            con.close()

    return run


def nearest_interval(points: DataFrame, intervals: DataFrame, tolerance: int, bucket: int = BUCKET_MS) -> DataFrame:
    """point, interval, distance of each point with an interval within the tolerance.

    points: ent, t, point; intervals: ent, s, e, interval; times, the tolerance and the bucket in whole numbers of one unit.
    """
    b = lambda c: F.floor(c / bucket).cast("long")
    p = points.filter("ent is not null and t is not null and point is not null").select(F.col("ent").cast("string").alias("ent"), b(F.col("t")).alias("b"), F.col("t").cast("long").alias("t"), F.col("point").cast("long").alias("point"))
    v = intervals.filter("ent is not null and interval is not null and e > s").select(
        F.col("ent").cast("string").alias("ent"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("interval").cast("long").alias("interval"),
        b(F.col("s") - tolerance).alias("b0"), b(F.col("e") + tolerance).alias("b1"),
    )
    short = v.filter(F.col("b1") - F.col("b0") < SPAN).select("ent", F.explode(F.sequence("b0", "b1")).alias("b"), "s", "e", "interval")
    held = p.select("ent", "b").distinct()
    long = v.filter(F.col("b1") - F.col("b0") >= SPAN).join(held, "ent").filter("b between b0 and b1").select("ent", "b", "s", "e", "interval")
    row = lambda df, point, s, e, own: df.select("ent", "b", F.lit(point).alias("point"), F.col(s).alias("s"), F.col(e).alias("e"), F.col(own).alias("id"))
    rows = row(short.unionByName(long), False, "s", "e", "interval").unionByName(row(p, True, "t", "t", "point"))
    # the first rows of a bucket are its intervals
    return rows.repartition("ent", "b").sortWithinPartitions("ent", "b", "point").mapInArrow(_pair(tolerance), "point long, interval long, distance long")
