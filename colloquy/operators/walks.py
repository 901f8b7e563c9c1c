"""Sequential rules: the rows of a key in order through a state, streamed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def walk(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], schema: str, arrow: pa.Schema, start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], end: Callable[[object], list[tuple]] = lambda s: []) -> DataFrame:
    """Rows of each key in order, through a state that ``start`` makes for each key; what ``step`` and ``end`` return follows the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, rest = row[: len(keys)], row[len(keys) :]
                if key != at:
                    if at is not None:
                        out += [(*at, *r) for r in end(state)]
                    at, state = key, start()
                out += [(*key, *r) for r in step(state, rest)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
        if at is not None and (out := [(*at, *r) for r in end(state)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, schema)
