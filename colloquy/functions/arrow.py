"""Arrow helpers shared by the operators that need imperative code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the table has fewer splits than twice the cores, as a small one in a single file has; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def slices_by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text; a longer text stands alone."""
    n = len(texts)
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < n:
        j = int(np.searchsorted(total, total[i] + most, side="right")) - 1
        j = max(j, i + 1)
        yield i, min(j, n)
        i = min(j, n)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and the offset of each."""
    whole = "".join(texts)
    flat = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return flat, off


def numbered(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows as one table, and the number of each row's group; rows of one group (keys without nulls) stand together."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    fresh = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        fresh |= np.asarray(pc.not_equal(rows[k].slice(1), rows[k].slice(0, rows.num_rows - 1)))
    return rows, np.concatenate([np.zeros(min(rows.num_rows, 1), dtype=np.int64), np.cumsum(fresh)])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in parts of whole groups, of about ``most`` rows unless one group is larger, with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        rows, g = numbered(held, keys)
        cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
        if cut:
            yield rows.slice(0, cut), g[:cut]
        held = rows.slice(cut).to_batches()
        n = 0 if not cut else rows.num_rows - cut
    if held:
        rows, g = numbered(held, keys)
        if rows.num_rows:
            yield rows, g
