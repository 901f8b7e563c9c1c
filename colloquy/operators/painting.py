"""Labelled intervals painted over each other along whole-numbered time.

What a raster holds cell by cell is held as spans: the rows grow with the intervals, not with the time that they cover. Entities are cut into buckets of time, so
that a large entity is many tasks; a task paints whole buckets of any entities at a time, on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import whole_groups
from colloquy.functions.cover import places, top_cover

BUCKET = 6000
SPAN = 16  # an interval over so many buckets goes only into those in which others begin or end
CHUNK = 100_000


def _in_buckets(rows: DataFrame, bucket: int) -> DataFrame:
    """The rows cut at the borders of buckets; a part of a long interval reaches to the next bucket that holds anything of its entity."""
    rows = rows.withColumns({"k0": F.floor(F.col("a") / bucket).cast("long"), "k1": F.floor((F.col("b") - 1) / bucket).cast("long")})
    is_long = F.col("k1") - F.col("k0") >= SPAN
    keep = ["rec_id", "k", "layer", "a", "b", "rank", "label"]
    short = rows.filter(~is_long).withColumn("k", F.explode(F.sequence("k0", "k1")))
    short = short.withColumns({"a": F.greatest("a", F.col("k") * bucket), "b": F.least("b", (F.col("k") + 1) * bucket)}).select(*keep)
    long = rows.filter(is_long)
    used = short.select("rec_id", "k").unionByName(long.select("rec_id", F.explode(F.array("k0", "k1")).alias("k"))).distinct()
    used = used.join(long.select("rec_id").distinct(), "rec_id", "left_semi")
    used = used.withColumn("next", F.lead("k").over(Window.partitionBy("rec_id").orderBy("k")))
    parts = long.join(used, "rec_id").filter("k between k0 and k1")
    parts = parts.withColumns({"a": F.greatest("a", F.col("k") * bucket), "b": F.least("b", F.col("next") * bucket)})
    return short.unionByName(parts.select(*keep))


def painted(layers: dict[str, DataFrame], bucket: int = BUCKET) -> DataFrame:
    """rec_id, from, to and, by the name of each layer, the label on top of it in that span; -1 where the layer is bare. Spans that are bare on all layers
    are left out, and one that crosses a bucket's border comes in parts.

    layers: rec_id, a, b (exclusive), rank and label; in a layer the interval of the greatest rank lies on top. Intervals without recording or length are left out.
    """
    names = list(layers)
    rows = reduce(DataFrame.unionByName, [
        df.filter("rec_id is not null and b > a and label is not null").select("rec_id", F.lit(i).alias("layer"), F.col("a").cast("long"), F.col("b").cast("long"), F.col("rank").cast("long"), F.col("label").cast("int"))
        for i, df in enumerate(layers.values())
    ])
    schema = pa.schema([("rec_id", pa.string()), ("from", pa.int64()), ("to", pa.int64())] + [(n, pa.int32()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, g in whole_groups(batches, ["rec_id", "k"], CHUNK):
            layer, a, b, rank, label = (np.asarray(rows[c]) for c in ("layer", "a", "b", "rank", "label"))
            group, at, number = places(np.concatenate([g, g]), np.concatenate([a, b]))
            order, m, n = np.lexsort((rank, layer, g)), len(g), len(group)
            base = layer[order].astype(np.int64) * n
            top = top_cover(n * len(names), base + number[:m][order], base + number[m:][order]).reshape(len(names), n)
            seen = np.where(top >= 0, label[order][np.maximum(top, 0)], -1)
            on = (top >= 0).any(axis=0)  # never at the last instant of a group
            same = np.zeros(n, bool)
            same[1:] = (group[1:] == group[:-1]) & on[1:] & on[:-1] & ((seen[:, 1:] == seen[:, :-1]) & ((top[:, 1:] >= 0) == (top[:, :-1] >= 0))).all(axis=0)
            first = np.flatnonzero(on & ~same)
            if not len(first):
                continue
            stop = np.append(np.flatnonzero(~same[1:]) + 1, n)  # where a span may end
            last = stop[np.searchsorted(stop, first, side="right")]
            row = np.searchsorted(g, group[first])
            yield pa.RecordBatch.from_arrays([rows["rec_id"].combine_chunks().take(pa.array(row)), pa.array(at[first]), pa.array(at[last]), *[pa.array(s[first].astype(np.int32)) for s in seen]], schema=schema)

    cut = _in_buckets(rows, bucket).repartition("rec_id", "k").sortWithinPartitions("rec_id", "k")
    return cut.mapInArrow(run, ", ".join(["rec_id string", "`from` long", "`to` long"] + [f"`{n}` int" for n in names]))
