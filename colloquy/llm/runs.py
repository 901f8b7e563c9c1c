"""Runs of repeated consecutive events, each collapsed into one with its count and duration.

A state machine walks the sorted events of each entity and holds one open run: an event joins it if it is like the run's anchor,
its first event, and starts no later than the tolerance after the event before; otherwise the run is finished and emitted. State
is carried over Arrow batches, so no entity is held in memory; the walk itself is done on whole batches at a time.

An entity is cut into time buckets walked by different tasks. A run that reaches the first or last event of its bucket is a
fragment, and a second walk over the fragments, at most two to a bucket, joins those that meet.

``collapse_like`` takes a likeness in place of equality: each event is compared with the anchor of the open run, so events that drift away from it begin a new
run. What an anchor gathers cannot be told from the middle, so an entity is not cut into buckets but only where events are further apart than
the tolerance, which no run crosses; each such stretch is streamed through one task.

Defined results: events without entity, start or label are left out; ties in time follow the order of ``key``; repeated rows are events of
their own; an empty table gives an empty table. A run's end is the latest end of its events, their start where the end is missing or earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.scan import neighbours, running

BUCKET_MS = 3_600_000
_FIELDS = "ent string, b long, seq long, label long, k long, first_ms long, last_ms long, to_ms long, n long, opens boolean, closes boolean"
_SCHEMA = pa.schema([("ent", pa.string())] + [(c, pa.int64()) for c in ("b", "seq", "label", "k", "first_ms", "last_ms", "to_ms", "n")] + [("opens", pa.bool_()), ("closes", pa.bool_())])


def _walk(max_gap: int):
    """Events (ent, b, label, k, start, end), sorted, to runs within each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the open run; seq counts the runs of a bucket
        last: tuple | None = None
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            ent = batch.column(0)
            code = np.asarray(ent.dictionary_encode().indices)
            b, label, k, start, end = (np.asarray(batch.column(i)) for i in range(1, 6))
            group, fresh = np.ones(m, bool), np.ones(m, bool)
            group[1:] = (code[1:] != code[:-1]) | (b[1:] != b[:-1])
            fresh[1:] = group[1:] | (label[1:] != label[:-1]) | (start[1:] - start[:-1] > max_gap)
            if last is not None:
                group[0] = (ent[0].as_py(), b[0]) != last[:2]
                fresh[0] = bool(group[0] or label[0] != last[2] or start[0] - last[3] > max_gap)
            last = (ent[m - 1].as_py(), b[m - 1], label[m - 1], start[m - 1])
            at = np.flatnonzero(fresh)
            if not len(at) or at[0]:
                at = np.concatenate([[0], at])
            to = np.append(at[1:], m)
            names = ent.take(pa.array(at)).to_pylist()
            tops = np.maximum.reduceat(np.maximum(start, end), at)
            out = []
            for i in range(len(at)):
                a, z = at[i], to[i] - 1
                if not fresh[a]:
                    held[6], held[7], held[8] = int(start[z]), max(held[7], int(tops[i])), held[8] + int(to[i] - a)
                    continue
                opens = bool(group[a])
                if held is not None:
                    held[10] = opens
                    out.append(held)
                seq = 0 if opens else held[2] + 1
                held = [names[i], int(b[a]), seq, int(label[a]), int(k[a]), int(start[a]), int(start[z]), int(tops[i]), int(to[i] - a), opens, False]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)
        if held is not None:
            held[10] = True
            yield pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip(held, _SCHEMA.types)], schema=_SCHEMA)

    return run


def _stitch(max_gap: int):
    """Fragments of an entity in order of bucket and place: the last of a bucket and the first of the next become one where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                r = list(row)
                if held is not None and held[0] == r[0] and held[10] and r[9] and held[3] == r[3] and r[5] - held[6] <= max_gap:
                    held[6], held[7], held[8], held[10] = r[6], max(held[7], r[7]), held[8] + r[8], r[10]
                    continue
                if held is not None:
                    out.append(held)
                held = r
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip(held, _SCHEMA.types)], schema=_SCHEMA)

    return run


def collapse(df: DataFrame, entity: str, label: str, start: str, end: str, key: str, max_gap: int, bucket: int = BUCKET_MS) -> DataFrame:
    """ent, label, first_key, n, from_ms, to_ms of each run; start and end in whole milliseconds, key and label whole numbers."""
    rows = df.filter(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(
        F.col(entity).cast("string").alias("ent"), F.floor(F.col(start) / bucket).alias("b"), F.col(label).cast("long").alias("label"),
        F.col(key).cast("long").alias("k"), F.col(start).alias("s"), F.coalesce(end, start).alias("e"),
    )
    found = rows.repartition("ent", "b").sortWithinPartitions("ent", "b", "s", "k").mapInArrow(_walk(max_gap), _FIELDS)
    # One more shuffle, of runs: fragments go by entity, the runs between them anywhere, and pass the second walk as they are.
    part = F.when(F.col("opens") | F.col("closes"), F.xxhash64("ent")).otherwise(F.xxhash64("ent", "b", "seq"))
    placed = found.withColumn("part", part).repartition("part").sortWithinPartitions(F.col("opens") | F.col("closes"), "ent", "b", "seq").drop("part")
    whole = placed.mapInArrow(_stitch(max_gap), _FIELDS)
    return whole.select("ent", "label", F.col("k").alias("first_key"), "n", F.col("first_ms").alias("from_ms"), "to_ms")


@lru_cache(1 << 16)
def likeness(a: str, b: str) -> float:
    """1 less the edits that turn one text into the other as a share of the longer; 1 for two empty ones."""
    if a == b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0], corner = i, i, i - 1
        for j, y in enumerate(b, 1):
            left, corner = min(row[j] + 1, left + 1, corner + (x != y)), row[j]
            row[j] = left
    return 1.0 - row[-1] / max(len(a), len(b))


def _walk_like(max_gap: int, alike: Callable[[str, str], bool]):
    """Events (ent, part, label, k, start, end), sorted, to runs; one open run is held."""
    kind = pa.schema([("ent", pa.string()), ("label", pa.string()), ("first_key", pa.int64()), ("n", pa.int64()), ("from_ms", pa.int64()), ("to_ms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        part, last = None, 0
        for batch in batches:
            out = []
            for ent, p, label, k, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and (ent, p) == part and s - last <= max_gap and alike(held[1], label):
                    held[3], held[5] = held[3] + 1, max(held[5], s, e)
                else:
                    if held is not None:
                        out.append(held)
                    held = [ent, label, k, 1, s, max(s, e)]
                part, last = (ent, p), s
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kind.types)], schema=kind)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip(held, kind.types)], schema=kind)

    return run


def collapse_like(df: DataFrame, entity: str, label: str, start: str, end: str, key: str, max_gap: int, least: float = 0.8, alike: Callable[[str, str], bool] | None = None, bucket: int = BUCKET_MS) -> DataFrame:
    """As ``collapse``, of events whose label, a text, is like the anchor's by at least ``least``, or as ``alike`` (anchor, label) has it."""
    alike = alike or (lambda a, b: likeness(a, b) >= least)
    rows = df.filter(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(entity).cast("string").alias("ent"), F.col(label).cast("string").alias("label"), F.col(key).cast("long").alias("k"), F.col(start).cast("long").alias("s"), F.coalesce(end, start).cast("long").alias("e"))
    rows = neighbours(rows, ["ent"], "s", ["s", "k", "label", "e"], before={"s0": "s"}, bucket=bucket)
    fresh = F.when(F.col("s0").isNull() | (F.col("s") - F.col("s0") > max_gap), F.col("s"))
    rows = running(rows, ["ent"], "s", ["s", "k", "label", "e"], {"part": ("max", fresh)}, inclusive=True, bucket=bucket)
    order = rows.select("ent", "part", "label", "k", "s", "e").repartition("ent", "part").sortWithinPartitions("ent", "part", "s", "k", "label", "e")
    return order.mapInArrow(_walk_like(max_gap, alike), "ent string, label string, first_key long, n long, from_ms long, to_ms long")
