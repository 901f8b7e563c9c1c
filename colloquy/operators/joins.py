"""Joins by time and by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 60.0
CELLS = 1200
SPAN = 64


def _in_buckets(df: DataFrame, start: str, end: str, entity: str, bucket: float, starts: DataFrame) -> DataFrame:
    """The rows in every bucket that they touch as ``__b``; an interval over ``SPAN`` buckets only in the one where it begins and in those where one of the other side does."""
    at = lambda c: F.floor(F.col(c) / bucket).cast("long")
    rows = df.withColumns({"__b0": at(start), "__b1": at(end)}).filter("__b1 >= __b0")
    is_long = F.col("__b1") - F.col("__b0") >= SPAN
    short = rows.filter(~is_long).withColumn("__b", F.explode(F.sequence("__b0", "__b1")))
    long = rows.filter(is_long)
    others = long.join(starts, entity).filter((F.col("__b") > F.col("__b0")) & (F.col("__b") <= F.col("__b1")))
    return short.unionByName(long.withColumn("__b", F.col("__b0"))).unionByName(others.select(*short.columns)).drop("__b0", "__b1")


def overlapping(a: DataFrame, b: DataFrame, entity: str, bucket: float = BUCKET) -> DataFrame:
    """Pairs of intervals (a.start, a.end, b.s, b.e) of one entity that overlap, each once: both are sent to the time buckets they touch and
    meet by equality; the pair belongs to the bucket in which the later of the two begins."""
    begins = lambda df, c: df.select(entity, F.floor(F.col(c) / bucket).cast("long").alias("__b")).distinct()
    x = _in_buckets(a, "start", "end", entity, bucket, begins(b, "s"))
    y = _in_buckets(b, "s", "e", entity, bucket, begins(a, "start"))
    pairs = x.join(y, [entity, "__b"]).filter((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    return pairs.filter(F.floor(F.greatest("start", "s") / bucket) == F.col("__b")).drop("__b")


def speaker_by_overlap(segments: DataFrame, turns: DataFrame, key: list[str], coverage: float, margin: float) -> DataFrame:
    """key..., speaker with the most overlap, where it covers ``coverage`` of the segment and leads the next by ``margin`` of it."""
    t = turns.select("rec_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("speaker").alias("who"))
    p = overlapping(segments.select("rec_id", *key, "start", "end"), t, "rec_id")
    o = p.groupBy(*key, "who").agg(F.first(F.col("end") - F.col("start")).alias("dur"), F.sum(F.least("end", "e") - F.greatest("start", "s")).alias("ov"))
    ranked = o.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("ov", 6)).alias("o"), "who", "ov", "dur"))), 1, 2).alias("r"))
    best, second = F.element_at("r", 1), F.try_element_at("r", F.lit(2))
    lead = best["ov"] - F.coalesce(-second["o"], F.lit(0.0))
    ok = (F.round(best["ov"] / best["dur"], 6) >= coverage) & (F.round(lead / best["dur"], 6) >= margin)
    return ranked.filter(ok).select(*key, best["who"].alias("speaker"))


def nearest_label(points: DataFrame, spans: DataFrame, step: float, before: int, after: int) -> DataFrame:
    """rec_id, word_id, speaker of the span (rec_id, from, to, speaker) nearest to the cell of a point's start, from ``before`` cells before it to one short of
    ``after`` after it, the earlier of equals; -1 without any."""
    at = (F.col("start") / step).cast("long")
    p = points.select("rec_id", "word_id", at.alias("at"), (at - before).alias("start"), (at + after).alias("end"))
    met = overlapping(p, spans.select("rec_id", F.col("from").alias("s"), F.col("to").alias("e"), "speaker"), "rec_id", CELLS)
    cell = F.greatest("s", F.least("at", F.col("e") - 1))
    near = met.groupBy("rec_id", "word_id").agg(F.min_by("speaker", F.struct(F.abs(cell - F.col("at")), cell)).alias("near"))
    return points.select("rec_id", "word_id").join(near, ["rec_id", "word_id"], "left").select("rec_id", "word_id", F.coalesce("near", F.lit(-1)).alias("speaker"))


def label_at(points: DataFrame, spans: DataFrame, step: float) -> DataFrame:
    """As nearest_label, of the span that holds the cell itself."""
    return nearest_label(points, spans, step, 0, 1)


def intersection_over_union(a: Column, b: Column) -> Column:
    """Of rectangles with x, y, width, height; 0 where nothing is covered."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlapping_boxes(df: DataFrame, group: str, key: str, box: str, least: float, cell: float = 128.0) -> DataFrame:
    """group, left, right of pairs of boxes of a group whose intersection over union is at least ``least``: boxes meet in the cells of a grid
    that they touch, and a pair is kept in the cell that holds the first corner of their intersection."""
    b = F.col(box)
    cells = lambda at, size: F.sequence(F.floor(at / cell), F.floor((at + size) / cell))
    rows = df.filter(b.isNotNull()).select(group, key, b.alias("box"), F.explode(cells(b["x"], b["width"])).alias("cx")).withColumn("cy", F.explode(cells(F.col("box.y"), F.col("box.height"))))
    a, c = rows.alias("a"), rows.alias("b")
    met = a.join(c, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    own = (F.floor(F.greatest(F.col("a.box.x"), F.col("b.box.x")) / cell) == F.col("a.cx")) & (F.floor(F.greatest(F.col("a.box.y"), F.col("b.box.y")) / cell) == F.col("a.cy"))
    close = intersection_over_union(F.col("a.box"), F.col("b.box")) >= least
    return met.filter(own & close).select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("left"), F.col(f"b.{key}").alias("right"))
