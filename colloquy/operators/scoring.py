"""Scores of one timeline against another, on cells of equal length, which are held and counted as spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.matching import best_assignment
from colloquy.operators import timelines as tl
from colloquy.operators.joins import overlapping
from colloquy.operators.painting import painted
from colloquy.operators.scan import islands
from colloquy.operators.walks import walk

BUCKET = 600  # cells


def frames(ref: DataFrame, hyp: DataFrame, step: float) -> DataFrame:
    """rec_id, from, to, ref, hyp, n of each span of cells in which either side speaks and neither changes; -1 is silence, n its cells."""
    return painted({"ref": tl.layer(ref, step), "hyp": tl.layer(hyp, step)}).withColumn("n", F.col("to") - F.col("from"))


def counts(f: DataFrame) -> DataFrame:
    """rec_id, ref, hyp, n: how many cells have each pair of labels, which is all that most scores need."""
    return f.groupBy("rec_id", "ref", "hyp").agg(F.sum("n").alias("n"))


def overlap(f: DataFrame) -> DataFrame:
    """rec_id, hyp, ref, n where both speak; f: spans or their counts."""
    return f.filter("ref >= 0 and hyp >= 0").groupBy("rec_id", "hyp", "ref").agg(F.sum("n").alias("n"))


def assign(matrix: DataFrame) -> DataFrame:
    """rec_id, hyp, ref of the best one-to-one mapping; matrix: counts, of which those with silence do not matter. A recording's matrix is as large as its
    numbers of speakers, whatever its length."""
    schema = pa.schema([("rec_id", pa.string()), ("hyp", pa.int32()), ("ref", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not cells:
                    continue
                hyps, refs = sorted({c["hyp"] for c in cells}), sorted({c["ref"] for c in cells})
                gain = np.zeros((len(hyps), len(refs)))
                for c in cells:
                    gain[hyps.index(c["hyp"]), refs.index(c["ref"])] = c["n"]
                out += [(rec, hyps[i], refs[j]) for i, j in best_assignment(gain)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    # not a filter, which would go below the counts and have them made once more for the scores
    both = F.when((F.col("ref") >= 0) & (F.col("hyp") >= 0), F.struct("hyp", "ref", "n"))
    return matrix.groupBy("rec_id").agg(F.collect_list(both)).mapInArrow(run, "rec_id string, hyp int, ref int")


def _mapped(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select("rec_id", "hyp", F.col("ref").alias("as_ref"))
    return counts.join(m, ["rec_id", "hyp"], "left").withColumn("as_ref", F.when(F.col("hyp") < 0, -1).otherwise(F.coalesce("as_ref", F.lit(-9))))


def score(f: DataFrame, mapping: DataFrame) -> DataFrame:
    """f: counts. frame_acc over cells where both speak; miss, fa, conf and their sum der over cells where either does. Without any mapping 0 and 1."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    ref, hyp, both = F.col("ref") >= 0, F.col("hyp") >= 0, (F.col("ref") >= 0) & (F.col("hyp") >= 0)
    c = _mapped(f, mapping).groupBy("rec_id").agg(
        n(ref | hyp).alias("n_speech"), n(both).alias("both"), n(both & (F.col("as_ref") == F.col("ref"))).alias("hit"), n(ref & ~hyp).alias("m"), n(~ref & hyp).alias("f")
    )
    none, d = F.col("both") == 0, F.col("n_speech").cast("double")
    share = lambda x: F.when(none, 1.0).otherwise(x / d)
    wrong = F.col("both") - F.col("hit")
    return c.select(
        "rec_id", "n_speech", F.when(none, 0.0).otherwise(F.col("hit") / F.col("both")).alias("frame_acc"),
        share(F.col("m")).alias("miss"), share(F.col("f")).alias("fa"), share(wrong).alias("conf"), share(F.col("m") + F.col("f") + wrong).alias("der"),
    )


def recall(f: DataFrame, mapping: DataFrame) -> DataFrame:
    """rec_id, ref, recall: the share of a reference speaker's cells that are mapped to them."""
    m = _mapped(f, mapping).filter("ref >= 0")
    return m.groupBy("rec_id", "ref").agg((F.sum(F.when(F.col("as_ref") == F.col("ref"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))


def majority_labels(ref: DataFrame, f: DataFrame, step: float, least: float = 1.0) -> DataFrame:
    """rec_id, idx, majority: the label that most cells of a turn of at least ``least`` seconds have, silence apart, the smallest at a tie."""
    turns = tl.layer(ref.filter(F.col("end") - F.col("start") >= least), step).select("rec_id", F.col("rank").alias("idx"), F.col("a").alias("start"), F.col("b").alias("end"))
    spans = f.filter("hyp >= 0").select("rec_id", F.col("from").alias("s"), F.col("to").alias("e"), "hyp")
    votes = overlapping(turns, spans, "rec_id", BUCKET).groupBy("rec_id", "idx", "hyp").agg(F.sum(F.least("end", "e") - F.greatest("start", "s")).alias("n"))
    return votes.groupBy("rec_id", "idx").agg(F.max_by("hyp", F.struct("n", -F.col("hyp"))).alias("majority"))


def turn_majority(ref: DataFrame, f: DataFrame, mapping: DataFrame, step: float, least: float = 1.0) -> DataFrame:
    """rec_id, turns_ok, turns_total: long turns whose majority label is mapped to their speaker; silent ones count in the total."""
    m = mapping.select("rec_id", F.col("hyp").alias("majority"), F.col("ref").alias("as_ref"))
    votes = majority_labels(ref, f, step, least).join(m, ["rec_id", "majority"], "left").select("rec_id", "idx", "as_ref")
    turns = ref.filter(F.col("end") - F.col("start") >= least).join(votes, ["rec_id", "idx"], "left")
    return turns.groupBy("rec_id").agg(F.count(F.when(F.col("as_ref") == F.col("speaker"), 1)).alias("turns_ok"), F.count("*").alias("turns_total"))


def match_change_points(ref: DataFrame, hyp: DataFrame, tolerance: float) -> DataFrame:
    """rec_id, matched, n_ref, n_hyp: each reference point, in order, takes the first unused point within the tolerance.

    Points further apart than the tolerance never meet, so a recording is cut where no two of its points are that close, and
    only the points of one such stretch are walked together.
    """
    both = ref.select("rec_id", "idx", "at", F.lit(0).alias("side")).unionByName(hyp.select("rec_id", "idx", "at", F.lit(1).alias("side")))
    both = both.withColumn("end", F.col("at"))
    parts = islands(both, ["rec_id"], "at", "end", ["at", "side", "idx"], tolerance + 1e-6, name="part")

    def step(state: tuple[list, list], row: tuple) -> list[tuple]:
        state[row[1]].append(row[0])
        return []

    def end(state: tuple[list, list]) -> list[tuple]:
        mine, theirs = state
        free, hits = list(range(len(theirs))), 0
        for r in mine:
            k = next((k for k in free if abs(r - theirs[k]) <= tolerance), None)
            if k is not None:
                free.remove(k)
                hits += 1
        return [(hits, len(mine), len(theirs))]

    mixed = Window.partitionBy("rec_id", "part")
    parts = parts.withColumn("two", F.min("side").over(mixed) != F.max("side").over(mixed))
    alone = parts.filter("not two").groupBy("rec_id").agg(F.lit(0).cast("long").alias("matched"), F.count(F.when(F.col("side") == 0, 1)).alias("n_ref"), F.count(F.when(F.col("side") == 1, 1)).alias("n_hyp"))
    arrow = pa.schema([("rec_id", pa.string()), ("part", pa.int64()), ("matched", pa.int64()), ("n_ref", pa.int64()), ("n_hyp", pa.int64())])
    rows = parts.filter("two").select("rec_id", F.col("part").cast("long"), "at", "side", "idx")
    met = walk(rows, ["rec_id", "part"], [F.col("at"), F.col("idx")], ["at", "side"], "rec_id string, part long, matched long, n_ref long, n_hyp long", arrow, lambda: ([], []), step, end).drop("part")
    return met.unionByName(alone).groupBy("rec_id").agg(F.sum("matched").alias("matched"), F.sum("n_ref").alias("n_ref"), F.sum("n_hyp").alias("n_hyp"))
