"""Chunks of a recording, cut in silence where possible, and the stretches of speech in samples."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.intervals import periods


def bounds(cells: list[tuple[int, int]], n: int, step: float, limit: float, look: float, least: float) -> list[float]:
    """Cut points from 0 to the end of n cells: each the last silent cell within ``look`` of the limit, the limit if there is none, at least
    ``least`` after the cut before. cells: the sorted, disjoint stretches with speech (end exclusive)."""
    ends = [b for _, b in cells]
    out, dur = [0.0], n * step
    while out[-1] + limit < dur:
        hard = out[-1] + limit
        low, at = int((hard - look) / step), int(hard / step) - 1
        k = bisect_left(ends, at + 1)
        if k < len(cells) and cells[k][0] <= at:
            at = cells[k][0] - 1
            if k and ends[k - 1] > at:
                at = cells[k - 1][0] - 1
        out.append(max(at * step if at >= low else hard, out[-1] + least))
    return [*out, dur]


def chunk_bounds(t: DataFrame, step: float = 0.01, limit: float = 28.0, look: float = 6.0, least: float = 5.0) -> DataFrame:
    """rec_id, chunk_no, from_sec, to_sec. What is held at once is a recording's periods of speech, not its cells.

    t: timeline. A recording without speech has no chunks.
    """
    cells = t.select("rec_id", F.floor(F.round(F.col("start") / step, 6)).cast("long").alias("a"), F.ceil(F.round(F.col("end") / step, 6)).cast("long").alias("b"))
    p = periods(cells, ["rec_id"], "a", "b", 60_000).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.array("from_ms", "to_ms"))).alias("p"))
    schema = pa.schema([("rec_id", pa.string()), ("chunk_no", pa.int32()), ("from_sec", pa.float64()), ("to_sec", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cut = bounds([tuple(c) for c in cells], cells[-1][1], step, limit, look, least)
                out += [(rec, i, a, b) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), schema.types)], schema=schema)

    return p.mapInArrow(run, "rec_id string, chunk_no int, from_sec double, to_sec double")


def speech_ranges(t: DataFrame, rate: int, pad: float = 0.0) -> DataFrame:
    """rec_id, from_sample, to_sample of the stretches in which anyone speaks, as ranges, not as a mask."""
    s = t.select("rec_id", F.greatest(F.floor((F.col("start") - pad) * rate), F.lit(0)).cast("long").alias("a"), F.ceil((F.col("end") + pad) * rate).cast("long").alias("b"))
    return periods(s, ["rec_id"], "a", "b", 600 * rate).select("rec_id", F.col("from_ms").alias("from_sample"), F.col("to_ms").alias("to_sample"))


def beam(logits: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """key, rank, ids, total: the ``width`` best sequences of tokens over ``depth`` steps, by sum of log-probabilities, then by ids.

    logits: key, step (from 0), token, logprob, the same choices whatever came before. Each step is a join by key and step, of which the
    best of each key are kept, so no key holds more than ``width`` sequences.
    """
    steps = logits.groupBy(key, "step", "token").agg(F.max("logprob").alias("logprob"))
    ranked = steps.groupBy(key, "step").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("logprob")).alias("cost"), "token"))), 1, 2 * width).alias("choices"))
    held = ranked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("step", "choices"))).alias("m"))
    empty = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<bigint>").alias("ids")))

    def grow(beams, step):
        more = F.coalesce(F.try_element_at("m", step), F.array().cast("array<struct<cost:double,token:bigint>>"))
        wide = F.flatten(F.transform(beams, lambda b: F.transform(more, lambda c: F.struct((b["cost"] + c["cost"]).alias("cost"), F.concat(b["ids"], F.array(c["token"].cast("bigint"))).alias("ids")))))
        return F.when(F.size(more) > 0, F.slice(F.array_sort(wide), 1, width)).otherwise(beams)

    best = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), empty, grow)
    rows = held.select(key, F.posexplode(best).alias("rank", "b"))
    return rows.select(key, "rank", F.col("b.ids").alias("ids"), (-F.col("b.cost")).alias("total"))
