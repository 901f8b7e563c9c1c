"""The steps from windows to speaker turns, put together. What models give (speech, level, vectors, activities) comes in as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import frames as fr
from colloquy.operators import timelines as tl
from colloquy.operators.clusters import cluster_recordings


def turns_of_windows(windows: DataFrame, speech: float = 0.4, level: float = 0.005, gap: float = 3.0, least: float = 0.2, **options) -> DataFrame:
    """The first pipeline: windows (rec_id, idx, start, end, speech, rms, vector) that hold enough speech at enough level are clustered by their vectors, and their
    labels become turns: joined, cut where they overlap, short ones absorbed, speakers renumbered. options: those of ``cluster_recordings``.

    A recording without such windows has no turns; null levels count as silence."""
    kept = windows.filter((F.col("speech") >= speech) & (F.col("rms") >= level) & F.col("vector").isNotNull())
    labels = cluster_recordings(kept, "rec_id", "idx", "vector", **options)
    t = kept.select("rec_id", "idx", "start", "end").join(labels, ["rec_id", "idx"]).select("rec_id", "idx", "start", "end", F.col("cluster").alias("speaker"))
    return tl.postprocess(t, gap, least)


def turns_of_activities(frames: DataFrame, vectors: DataFrame, hz: float, onset: float = 0.45, radius: int = 6, most_gap: int = 12, least: int = 5, pad: float = 0.1, overlapping: bool = False, **options) -> DataFrame:
    """The second pipeline: frames (rec_id, win, local, frame, pos, len, act) of overlapping windows, whose local speakers have vectors (rec_id, win, local, vector).
    The vectors are clustered over the whole recording, activities of one cluster are added up over windows, and turns are read from them: of the
    strongest speaker of each frame, smoothed by the most frequent label around it, or with ``overlapping`` of each speaker by itself. Gaps up to
    ``most_gap`` frames are filled, runs under ``least`` dropped, starts moved back by up to ``pad`` seconds, speakers renumbered."""
    named = vectors.filter("vector is not null").withColumn("own", F.format_string("%012d %06d", "win", "local"))
    labels = cluster_recordings(named, "rec_id", "own", "vector", **options).join(named.select("rec_id", "own", "win", "local"), ["rec_id", "own"])
    placed = frames.join(labels.select("rec_id", "win", "local", "cluster"), ["rec_id", "win", "local"])
    act = fr.overlap_add(placed, ["rec_id"], "frame", "cluster", "act", "pos", "len")
    track = ["rec_id", "cluster"]
    if overlapping:
        on = act.filter(F.col("act") >= onset).select(*track, "frame")
    else:
        best = fr.argmax_labels(act, ["rec_id"], "frame", "cluster", "act", onset)
        on = fr.mode_filter(best, ["rec_id"], "frame", "cluster", radius).filter("cluster >= 0")
    runs = fr.drop_short(fr.fill_gaps(fr.runs(on, track, "frame"), track, most_gap), least)
    turns = runs.select("rec_id", F.col("from").alias("idx"), (F.col("from") / hz).alias("start"), (F.col("to") / hz).alias("end"), F.col("cluster").alias("speaker"))
    return tl.renumber(turns if overlapping else tl.prepad(turns, pad))
