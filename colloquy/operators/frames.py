"""Frames: sequences of equal steps, as rows of (track, frame, ...), and the intervals made of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.scan import neighbours, running


FRAMES = 10_000  # frames of a bucket of the two-level scans


def _joined(df: DataFrame, track: list[str], at: str, end: str, most: int | Column) -> DataFrame:
    """track..., at, end of stretches in which each row begins no more than ``most`` after the end of the one before. A long track is many tasks."""
    rows = neighbours(df, track, at, [at], before={"__end": end}, bucket=FRAMES)
    fresh = F.when(F.col("__end").isNull() | (F.col(at) - F.col("__end") > most), F.col(at))
    rows = running(rows.withColumn("__first", fresh), track, at, [at], {"__from": ("max", F.col("__first"))}, inclusive=True, bucket=FRAMES)
    return rows.groupBy(*track, "__from").agg(F.max(end).alias("to")).withColumnRenamed("__from", "from").select(*track, "from", "to")


def runs(df: DataFrame, track: list[str], frame: str) -> DataFrame:
    """track..., from, to (exclusive) of each run of consecutive frames; df has the frames that are on, each once."""
    return _joined(df.select(*track, F.col(frame).alias("__at"), (F.col(frame) + 1).alias("__to")), track, "__at", "__to", 0)


def fill_gaps(r: DataFrame, track: list[str], most: int | Column) -> DataFrame:
    """Runs joined over gaps of up to ``most`` frames (a number, or what each track has); what lies before the first and after the last run is no gap."""
    return _joined(r, track, "from", "to", most)


def drop_short(r: DataFrame, least: int) -> DataFrame:
    return r.filter(F.col("to") - F.col("from") >= least)


def argmax_labels(df: DataFrame, track: list[str], frame: str, label: str, value: str, onset: float) -> DataFrame:
    """track..., frame, label of the greatest value of each frame, the lowest label at a tie, -1 under ``onset``."""
    best = df.groupBy(*track, frame).agg(F.min_by(F.struct(label, value), F.struct(-F.col(value), F.col(label))).alias("b"))
    return best.select(*track, frame, F.when(F.col(f"b.{value}") >= onset, F.col(f"b.{label}")).otherwise(-1).alias(label))


def mode_filter(df: DataFrame, track: list[str], frame: str, label: str, radius: int) -> DataFrame:
    """Each active frame (label >= 0) takes the most frequent label of the active frames within ``radius``, the first seen of equals. A frame
    is sent to its 2 * radius + 1 neighbours, so the work is one join by equality."""
    active = df.filter(F.col(label) >= 0)
    votes = active.select(*track, F.explode(F.sequence(F.col(frame) - radius, F.col(frame) + radius)).alias("__to"), F.col(frame).alias("__at"), F.col(label).alias("__l"))
    counts = votes.groupBy(*track, "__to", "__l").agg(F.count("*").alias("n"), F.min("__at").alias("f"))
    best = counts.groupBy(*track, "__to").agg(F.min_by("__l", F.struct(-F.col("n"), "f")).alias("__best")).withColumnRenamed("__to", frame)
    out = df.join(best, [*track, frame], "left")
    return out.withColumn(label, F.when(F.col(label) >= 0, F.col("__best")).otherwise(F.col(label))).drop("__best")


def overlap_add(df: DataFrame, track: list[str], frame: str, speaker: str, value: str, position: str, length: str) -> DataFrame:
    """track..., frame, speaker, act: values of overlapping windows, averaged with weights that fall from a window's middle to its ends."""
    mean = (F.col(length) - 1) / 2.0
    w = F.lit(0.1) + F.lit(0.9) * (F.lit(1.0) - F.abs(F.col(position) - mean) / (mean + 1.0))
    return df.groupBy(*track, frame, speaker).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("act"))


def window_starts(n: Column, size: int, hop: int) -> Column:
    """Starts of windows of ``size`` every ``hop`` over n samples, the last flush with the end."""
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(n - size, F.lit(0)).cast("long"), F.lit(hop).cast("long"))
    last = F.element_at(regular, -1)
    return F.when(n <= size, F.array(F.lit(0).cast("long"))).when(last + size < n, F.concat(regular, F.array((n - size).cast("long")))).otherwise(regular)


def window_rows(df: DataFrame, n: str, size: int, hop: int, flush: bool, block: int = 1 << 16) -> DataFrame:
    """df without n, and start: a row for each window of ``size`` every ``hop`` over n samples, with ``flush`` the last flush with the end. The
    starts of a row are made in blocks of ``block``, so n may be of any size."""
    rest = [c for c in df.columns if c != n]
    last = F.expr(f"greatest(`{n}` - {size}, 0) div {hop}")
    blocks = df.withColumn("__last", last).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"__last div {block}"))))
    numbers = F.sequence(F.col("__b") * block, F.least(F.col("__b") * block + block - 1, F.col("__last")))
    rows = blocks.select(*rest, F.explode(numbers).alias("__k")).select(*rest, (F.col("__k") * hop).alias("start"))
    if not flush:
        return rows
    over = df.withColumn("__last", last).filter((F.col(n) > size) & (F.col("__last") * hop + size < F.col(n)))
    return rows.unionByName(over.select(*rest, (F.col(n) - size).alias("start")))


def powerset_classes(speakers: int, at_once: int) -> list[list[int]]:
    """Speakers of each class: none, then each, then each pair and so on, in order."""
    from itertools import combinations

    return [list(c) for k in range(at_once + 1) for c in combinations(range(speakers), k)]


def marginals(probabilities: Column, speakers: int, at_once: int) -> Column:
    """Of class probabilities, the probability that each speaker is active."""
    classes = powerset_classes(speakers, at_once)
    return F.array(*[sum((F.element_at(probabilities, i + 1) for i, c in enumerate(classes) if s in c), F.lit(0.0)) for s in range(speakers)])


def energy_vad(x: np.ndarray, rate: int, frame_ms: int = 30, hop_ms: int = 10, floor_db: float = -40.0) -> np.ndarray:
    """Which samples lie in a frame louder than ``floor_db``."""
    size, hop = rate * frame_ms // 1000, max(1, rate * hop_ms // 1000)
    on = np.zeros(len(x), bool)
    if size <= 0:
        return on
    total = np.concatenate([[0.0], np.cumsum(np.nan_to_num(x.astype(float)) ** 2)])
    at = np.arange(0, len(x) - size + 1, hop)
    db = 20 * np.log10(np.sqrt((total[at + size] - total[at]) / size + 1e-12) + 1e-12)
    mark = np.zeros(len(x) + 1, int)
    np.add.at(mark, at[db > floor_db], 1)
    np.add.at(mark, at[db > floor_db] + size, -1)
    return np.cumsum(mark[:-1]) > 0


def resample(x: np.ndarray, rate: int, to: int, form: str = "ratio") -> np.ndarray:
    """Linear interpolation: ``ratio`` steps by the ratio of the rates, ``endpoints`` maps first to first and last to last, ``open`` divides
    the time without its end."""
    if rate == to or not len(x):
        return x
    n = max(1, int(round(len(x) * to / rate)))
    if form == "ratio":
        at = np.minimum(np.arange(n) * (rate / to), len(x) - 1)
    elif form == "endpoints":
        at = np.arange(n) / max(n - 1, 1) * (len(x) - 1)
    else:
        at = np.arange(n) / n * len(x)
    return np.interp(at, np.arange(len(x)), x)


def log_mel(x: np.ndarray, rate: int, bins: int = 80, frame_ms: float = 25.0, hop_ms: float = 10.0, emphasis: float = 0.97) -> np.ndarray:
    """Log energies in mel bands of Hamming-windowed, pre-emphasised frames, less their mean over the frames."""
    size, hop = int(rate * frame_ms / 1000), int(rate * hop_ms / 1000)
    if size < 2 or hop < 1 or len(x) < size:
        return np.zeros((0, bins))
    frames = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(x.astype(float)), size)[::hop].copy()
    frames -= frames.mean(axis=1, keepdims=True)
    frames = np.concatenate([frames[:, :1] * (1 - emphasis), frames[:, 1:] - emphasis * frames[:, :-1]], axis=1)
    frames *= 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    width = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames, width)) ** 2
    mel = lambda f: 1127.0 * np.log(1.0 + f / 700.0)
    low, high = mel(20.0 if rate > 100 else 0.0), mel(rate / 2.0)
    edges = low + (high - low) / (bins + 1) * np.arange(bins + 2)
    at = mel(np.arange(width // 2 + 1) * rate / width)
    up, down = (at - edges[:-2, None]) / (edges[1] - edges[0]), (edges[2:, None] - at) / (edges[1] - edges[0])
    bank = np.maximum(0.0, np.minimum(up, down))
    out = np.log(np.maximum(power @ bank.T, np.finfo(np.float32).eps))
    return out - out.mean(axis=0)
