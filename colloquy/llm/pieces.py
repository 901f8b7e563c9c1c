"""Oversized audio cut into pieces at silences by recursive bisection.

A stretch longer than the limit less the overlap is cut at its strongest boundary near the midpoint (the longest silence), and its halves
are cut likewise. Two ways to cut come of the one recursion:

``cut_bisecting`` takes these cuts as the ends of the pieces, and each piece begins the overlap before its cut. The pieces are of even
length.
``cut_composed`` is for a rule that fixes each end from the piece's own start: the last silence that leaves the piece within the limit and
longer than the least, or the limit. Cuts at midpoints are not those, so a stretch stands for a map instead, from the place where a piece
enters it to the ends of the pieces that begin in it and the place where the next stretch is entered. The map of a stretch within the limit is looked up
among the silences that it can reach, that of a longer one is composed of its halves', and the overlaps are attached to the ends that come out.

Defined results: requests without samples, or without a usable rate or duration, have no pieces; a rate that rounds to zero is
not usable; NaN samples are loud. A piece is cut on whole samples. Redelivered requests count once, with the earliest arrival: the
pieces, not the samples, are what is shuffled for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.delivery import first_delivery

LIMIT, LEAST, OVERLAP, QUIET, STILL = 20.0, 5.0, 0.5, 0.02, 0.2


def silences(x: np.ndarray, rate: int, quiet: float = QUIET, still: float = STILL) -> np.ndarray:
    """from and to of the maximal stretches of quiet samples that last at least ``still`` seconds."""
    low = np.zeros(len(x) + 2, dtype=np.int8)
    low[1:-1] = np.abs(x) <= np.float32(quiet) if x.dtype == np.float32 else np.abs(x) <= quiet
    edge = np.flatnonzero(np.diff(low))
    runs = edge.reshape(-1, 2)
    return runs[(runs[:, 1] - runs[:, 0]) >= still * rate - 1e-9]  # 0.2 of some rates is not exact


def _near_midpoint(a: int, b: int, middle: np.ndarray, size: np.ndarray) -> int:
    """Where [a, b) is cut: in the longest silence around the midpoint, the nearest to it of equal ones, then the earlier; at the midpoint without any."""
    half, reach = (a + b) // 2, (b - a) // 4
    near = np.flatnonzero((middle > half - reach) & (middle < half + reach))
    return half if not len(near) else int(middle[min(near, key=lambda k: (-size[k], abs(middle[k] - half), k))])


def bisect(n: int, rate: int, still: np.ndarray, limit: float, overlap: float) -> list[tuple[int, int]]:
    """The stretches, in order, that recursive bisection leaves: none longer than the limit less the overlap."""
    middle, size = (still[:, 0] + still[:, 1]) // 2, still[:, 1] - still[:, 0]
    most = max(1, int(limit * rate) - int(overlap * rate))
    out, stack = [], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= most:
            out.append((a, b))
        else:
            cut = _near_midpoint(a, b, middle, size)
            stack += [(cut, b), (a, cut)]  # the left half is done before the right one
    return out


def cut_bisecting(n: int, rate: int, still: np.ndarray, limit: float = LIMIT, least: float = LEAST, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    back = int(overlap * rate)
    return [(max(0, a - back) if a else 0, b) for a, b in bisect(n, rate, still, limit, overlap)]


def cut_composed(n: int, rate: int, still: np.ndarray, limit: float = LIMIT, least: float = LEAST, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    middle = (still[:, 0] + still[:, 1]) // 2
    back, most = int(overlap * rate), limit * rate

    def within(b: int, reach: np.ndarray, at: int) -> tuple[list[int], int]:
        """The map of a stretch up to b, which holds or reaches the silences ``reach``: ends of the pieces that begin in it from ``at`` on, and the next entry."""
        ends = []
        while at < b and n - at > most:
            fit = reach[np.searchsorted(reach, at + least * rate, side="right") : np.searchsorted(reach, at + most, side="right")]
            ends.append(int(fit[-1]) if len(fit) else at + int(most))
            at = max(ends[-1] - back, at + 1)
        return ends, at

    # the leaves come in order, so that composing the halves of every stretch is passing on the entry from leaf to leaf
    ends: list[int] = []
    at = 0
    for a, b in bisect(n, rate, still, limit, overlap):
        reach = middle[np.searchsorted(middle, a) : np.searchsorted(middle, b + most, side="right")]
        more, at = within(b, reach, at)
        ends += more
    starts = [0]
    for e in ends:
        starts.append(max(e - back, starts[-1] + 1))
    return list(zip(starts, [*ends, n]))


def pieces(df: DataFrame, cut: Callable = cut_composed, limit: float = LIMIT, only_over: bool = True, key: str = "request_id", samples: str = "samples", rate: str = "sample_rate", duration: str = "duration_seconds", arrived: str = "ingested_at") -> DataFrame:
    """key, piece_no, from_sample, to_sample of the pieces of each request; ``only_over`` leaves out those within the limit."""
    kind = df.schema
    own = [kind[key].dataType.simpleString(), kind[arrived].dataType.simpleString()]
    shape = f"`{key}` {own[0]}, `{arrived}` {own[1]}, cuts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column(2), []
            for i, (r, d) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if not lists[i].is_valid:
                    out.append([])
                    continue
                x = lists[i].values.to_numpy(zero_copy_only=False)
                if not (r and r > 0):
                    r = int(np.rint(len(x) / d)) if d is not None and np.isfinite(d) and d > 0 else 0
                over = r > 0 and len(x) > limit * r
                if r <= 0 or (only_over and not over):
                    out.append([])
                else:
                    got = cut(len(x), r, silences(x, r), limit) if over else [(0, len(x))]
                    out.append([int(v) for piece in got for v in piece])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.list_(pa.int64()))], names=[key, arrived, "cuts"])

    cuts = first_delivery(df.select(key, arrived, samples, rate, duration).mapInArrow(run, shape), key, arrived, ["cuts"])
    numbered = cuts.filter(F.size("cuts") > 0).select(key, "cuts", F.explode(F.sequence(F.lit(0), (F.size("cuts") / 2).cast("int") - 1)).alias("piece_no"))
    at = lambda k: F.element_at("cuts", F.col("piece_no") * 2 + k)
    return numbered.select(key, "piece_no", at(1).alias("from_sample"), at(2).alias("to_sample"))
