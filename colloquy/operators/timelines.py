"""Speaker timelines: merging, splitting, absorbing, renumbering and rasters.

A timeline has the columns rec_id, idx (unique within a recording), start, end (seconds) and speaker. Turns with a missing time or an
end before their start must have been left out. Order is by start, end, idx.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.painting import painted
from colloquy.operators.scan import islands, neighbours

REC, ORDER = ["rec_id"], ["start", "end", "idx"]


PART = ["rec_id", "island"]


def stretches(t: DataFrame, gap: float, least: float | None = None) -> DataFrame:
    """The turns with ``island``, numbering stretches of a recording that no rule with gaps up to ``gap`` reaches across; with ``least`` no
    rule that absorbs turns shorter than that either, since a stretch then begins with a turn that stays longer."""
    return islands(t, REC, "start", "end", ORDER, gap, least)


def merge_same_speaker(t: DataFrame, gap: float) -> DataFrame:
    """Consecutive turns of one speaker become one where each starts no later than ``gap`` after what came before ends. t: with islands."""
    w = Window.partitionBy(*PART).orderBy(*ORDER)
    t = t.withColumn("run", F.sum(F.when(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(*PART, "run").orderBy(*ORDER)
    top = F.max("end").over(r.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("fresh", F.coalesce((F.col("start") > top + gap).cast("int"), F.lit(1)))
    t = t.withColumn("part", F.sum("fresh").over(r.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.groupBy(*PART, "run", "part").agg(F.min(F.struct(*ORDER)).alias("f"), F.max("end").alias("end"), F.first("speaker").alias("speaker"))
    return t.select(*PART, F.col("f.idx").alias("idx"), F.col("f.start").alias("start"), "end", "speaker")


_KIND = pa.schema([("rec_id", pa.string()), ("island", pa.int64()), ("idx", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("speaker", pa.int32())])
_SHAPE = "rec_id string, island long, idx long, start double, end double, speaker int"
Step = Callable[[list | None, list], bool]


def _fold(t: DataFrame, step: Step) -> DataFrame:
    """Walks each stretch in order. step(last, turn) may change the last kept turn and the turn (lists of idx, start, end, speaker) and says
    whether the turn is kept. One turn is held at a time; the rows of a stretch stream by, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            out = []
            for rec, part, *x in zip(*(c.to_pylist() for c in batch.columns)):
                if (rec, part) != key:
                    if last is not None:
                        out.append((*key, *last))
                    key, last = (rec, part), None
                if step(last, x):
                    if last is not None:
                        out.append((*key, *last))
                    last = x
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), _KIND.types)], schema=_KIND)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=k) for c, k in zip((*key, *last), _KIND.types)], schema=_KIND)

    rows = t.select("rec_id", F.col("island").cast("long"), F.col("idx").cast("long"), F.col("start").cast("double"), F.col("end").cast("double"), F.col("speaker").cast("int"))
    return rows.repartition(*PART).sortWithinPartitions(*PART, *ORDER).mapInArrow(run, _SHAPE)


def split_overlaps(t: DataFrame, min_len: float) -> DataFrame:
    """Overlaps of two speakers are cut at their midpoint, those of one are joined; what remains of the later turn is dropped when shorter
    than ``min_len``, and the earlier one stays cut. t: with islands."""

    def step(last: list | None, x: list) -> bool:
        if last is None or x[1] >= last[2]:
            return True
        if last[3] == x[3]:
            last[2] = max(last[2], x[2])
            return False
        last[2] = x[1] = (x[1] + last[2]) * 0.5
        return x[2] - x[1] >= min_len

    return _fold(t, step)


def absorb_short(t: DataFrame, min_len: float, gap: float) -> DataFrame:
    """Turns shorter than ``min_len`` go into the turn before, whoever speaks, or nowhere if there is none; then gaps of one speaker up to
    ``gap`` are closed. t: with islands made with ``least``."""

    def step(last: list | None, x: list) -> bool:
        short = x[2] - x[1] < min_len
        if last is not None and (short or last[3] == x[3] and x[1] <= last[2] + gap):
            last[2] = max(last[2], x[2])
            return False
        return not short

    return _fold(t, step)


def split_and_fill(t: DataFrame, gap: float, min_len: float) -> DataFrame:
    """Overlaps of two speakers cut at their midpoint, then gaps of one speaker up to ``gap`` closed; turns under ``min_len`` left out. t: with islands."""

    def step(last: list | None, x: list) -> bool:
        if last is not None and last[3] != x[3] and x[1] < last[2]:
            last[2] = x[1] = (x[1] + last[2]) * 0.5
        elif last is not None and last[3] == x[3] and x[1] <= last[2] + gap:
            last[2] = max(last[2], x[2])
            return False
        return x[2] - x[1] >= min_len

    return _fold(t, step)


def split_then_join(t: DataFrame, tight: float, gap: float) -> DataFrame:
    """The other merge rule: joined at ``tight``, overlaps of two speakers cut at their midpoint, one speaker joined at ``gap``."""
    return split_and_fill(merge_same_speaker(stretches(t, gap), tight), gap, float("-inf"))


def postprocess(t: DataFrame, gap: float = 3.0, min_len: float = 0.2) -> DataFrame:
    """The whole merge: tight joins, midpoints, short turns absorbed, a final round, speakers renumbered by talk time."""
    t = merge_same_speaker(stretches(t, gap, min_len), 0.05)
    return renumber(split_and_fill(absorb_short(split_overlaps(t, min_len), min_len, gap), gap, 0.15))


def talk_seconds(t: DataFrame) -> DataFrame:
    return t.groupBy("rec_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("talk_sec"))


def renumber(t: DataFrame) -> DataFrame:
    """Speakers numbered from 0 by falling talk time (to the millisecond), the first to speak first at equal times."""
    talk = t.groupBy("rec_id", "speaker").agg(F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long")).alias("ms"), F.min(F.struct(*ORDER)).alias("f"))
    rank = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.desc("ms"), "f")) - 1
    return t.join(talk.select("rec_id", "speaker", rank.alias("rank")), ["rec_id", "speaker"]).select("rec_id", "idx", "start", "end", F.col("rank").alias("speaker"))


def prepad(t: DataFrame, pad: float) -> DataFrame:
    """Starts moved back by up to ``pad``, never into the turn before or below zero."""
    t = neighbours(t, REC, "start", ORDER, before={"__end": "end"})
    floor = F.coalesce("__end", F.lit(0.0))
    moved = F.when(F.col("start") > floor, F.greatest(F.col("start") - pad, floor, F.lit(0.0))).otherwise(F.col("start"))
    return t.withColumn("start", moved).drop("__end")


def change_points(t: DataFrame) -> DataFrame:
    """rec_id, at: the start of each turn whose speaker is not that of the turn before."""
    t = neighbours(t, REC, "start", ["start", "idx"], before={"__who": "speaker"})
    return t.filter(F.col("__who") != F.col("speaker")).select("rec_id", "idx", F.col("start").alias("at"))


def ends_from_starts(t: DataFrame, last: Column) -> DataFrame:
    """Each turn ends where the next starts, 0.3 s later if that is no later; the last at ``last``, at least 1 s after its start."""
    t = neighbours(t, REC, "start", ["start", "idx"], after={"__next": "start"})
    end = F.coalesce("__next", F.greatest(last, F.col("start") + 1.0))
    return t.withColumn("end", F.when(end <= F.col("start"), F.col("start") + 0.3).otherwise(end)).drop("__next")


def layer(t: DataFrame, step: float, at_least_one: bool = True) -> DataFrame:
    """The turns as intervals of cells of ``step`` seconds to be painted, later turns (by idx) over earlier ones."""
    a = (F.col("start") / step).cast("long")
    b = F.ceil(F.col("end") / step)
    return t.select("rec_id", a.alias("a"), (F.greatest(a + 1, b) if at_least_one else b).alias("b"), F.col("idx").alias("rank"), F.col("speaker").alias("label"))


def raster_spans(t: DataFrame, step: float, at_least_one: bool = True) -> DataFrame:
    """rec_id, from, to (exclusive), speaker: the cells that turns cover, in spans of one speaker."""
    return painted({"speaker": layer(t, step, at_least_one)})


def raster(t: DataFrame, step: float, at_least_one: bool = True) -> DataFrame:
    """rec_id, cell, speaker of every cell; what is made of spans needs no cells."""
    return raster_spans(t, step, at_least_one).select("rec_id", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("cell"), "speaker")
