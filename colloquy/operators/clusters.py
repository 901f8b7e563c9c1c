"""Clusters of vectors: centroids, silhouettes, absorption of small clusters; and models fitted to the vectors of one recording.

What works on all vectors is relational. The models (calibration, linkage, hidden Markov refinement) take the vectors of one recording, of
which the quadratic linkage needs a bounded number: ``LINK_MOST`` vectors, above which a recording is refused rather than sampled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import vectors as vx

LINK_MOST = 20_000


def _positions(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.select(*keys, F.posexplode(v).alias("p", "x"))


def sums(df: DataFrame, label: str, v: str) -> DataFrame:
    """label, n, total: the sum of each cluster's unit vectors; combined map-side, one row per cluster and dimension."""
    unit = df.select(label, vx.unit(vx.doubles(F.col(v))).alias("v"))
    sized = unit.groupBy(label).agg(F.count("*").alias("n"))
    parts = _positions(unit, [label], "v").groupBy(label, "p").agg(F.sum("x").alias("x"))
    whole = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("total"))
    return whole.join(sized, label)


def centroids(df: DataFrame, label: str, v: str) -> DataFrame:
    """label, n, centroid: the mean of the cluster's unit vectors, itself brought to unit length."""
    s = sums(df, label, v)
    n = F.col("n")
    return s.select(label, "n", vx.unit(F.transform("total", lambda x: x / n)).alias("centroid"))


def silhouettes(df: DataFrame, key: str, label: str, v: str) -> DataFrame:
    """key, label, silhouette under cosine distance, 0 distance within a cluster of one; -1 where there is no other cluster.

    The mean distance of a vector to a cluster is 1 less its dot product with the cluster's mean, so vectors are held against cluster
    sums, not against one another; the sums, one row per cluster, are attached to each vector as one array.
    """
    s = sums(df, label, v).select(F.struct(F.col(label).alias("c"), "n", "total").alias("s"))
    every = s.agg(F.collect_list("s").alias("all"))
    x = df.select(key, label, vx.unit(vx.doubles(F.col(v))).alias("v")).crossJoin(F.broadcast(every))  # one row
    mean = F.transform("all", lambda s: F.struct(
        s["c"].alias("c"), s["n"].alias("n"),
        F.when(s["c"] == F.col(label), F.when(s["n"] > 1, (s["n"] - 1 - (vx.dot(F.col("v"), s["total"]) - vx.dot(F.col("v"), F.col("v")))) / (s["n"] - 1)).otherwise(0.0))
        .otherwise(1.0 - vx.dot(F.col("v"), s["total"]) / s["n"]).alias("d"),
    ))
    x = x.withColumn("m", mean)
    a = F.element_at(F.filter("m", lambda s: s["c"] == F.col(label)), 1)["d"]
    b = F.array_min(F.transform(F.filter("m", lambda s: s["c"] != F.col(label)), lambda s: s["d"]))
    return x.select(key, label, F.when(b.isNull(), -1.0).otherwise((b - a) / F.greatest(a, b)).alias("silhouette"))


def absorb(df: DataFrame, key: str, label: str, v: str, least: float, size: Column | None = None) -> DataFrame:
    """key, label: members of clusters smaller than ``least`` (in members, or by another aggregate as ``size``) go to the nearest centroid of
    those that are not, the lowest label at a tie; labels are then numbered densely. One round is enough, since the targets do not change.
    What is attached to every row is one row for all clusters."""
    sizes = df.groupBy(label).agg((F.count("*") if size is None else size).alias("__size"))
    c = centroids(df, label, v).join(sizes, label)
    every = c.agg(F.collect_list(F.struct(F.col(label).alias("c"), "centroid", (F.col("__size") >= least).alias("large"))).alias("__all"))
    rows = df.crossJoin(F.broadcast(every))
    mine = F.element_at(F.filter("__all", lambda t: t["c"] == F.col(label)), 1)["large"]
    targets = F.filter("__all", lambda t: t["large"])
    scored = F.transform(targets, lambda t: F.struct((-F.round(vx.dot(vx.unit(vx.doubles(F.col(v))), t["centroid"]), 9)).alias("s"), t["c"].alias("c")))
    moved = rows.select(key, F.when(~mine & (F.size(targets) > 0), F.array_min(scored)["c"]).otherwise(F.col(label)).alias("c"))
    dense = moved.select("c").distinct().agg(F.array_sort(F.collect_list("c")).alias("order"))
    return moved.crossJoin(F.broadcast(dense)).select(key, (F.array_position("order", F.col("c")) - 1).cast("int").alias(label))


def two_gaussian_threshold(scores: np.ndarray, steps: int = 20) -> float:
    """Two Gaussians of one variance fitted to the scores; where both are equally likely."""
    x = np.asarray(scores, dtype=float)
    if not len(x):
        return 0.0
    mean = np.array([x.mean() - x.std(), x.mean() + x.std()])
    weight, var = np.array([0.5, 0.5]), max(float(x.var()), 1e-12)
    for _ in range(steps):
        log = -0.5 * (x[:, None] - mean) ** 2 / var + np.log(np.maximum(weight, 1e-300))
        log -= log.max(axis=1, keepdims=True)
        r = np.exp(log)
        r /= r.sum(axis=1, keepdims=True)
        total = np.maximum(r.sum(axis=0), 1e-12)
        weight, mean = total / len(x), (r * x[:, None]).sum(axis=0) / total
        var = max(float((r * (x[:, None] - mean) ** 2).sum() / len(x)), 1e-12)
    gap = mean[1] - mean[0]
    if abs(gap) < 1e-12:
        return float(mean.mean())
    return float(mean.mean() + var * np.log(max(weight[0], 1e-300) / max(weight[1], 1e-300)) / gap)


def linkage_steps(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merges of average linkage on cosine distance down to one cluster, in order: the two clusters, each named by its first vector and the
    lower one kept, and their distance."""
    n = len(v)
    if n > LINK_MOST:
        raise ValueError(f"a recording of {n} vectors is over the {LINK_MOST} that linkage takes")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d = np.clip(1.0 - u @ u.T, 0.0, 2.0)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    pairs, apart = np.zeros((max(n - 1, 0), 2), dtype=np.int64), np.zeros(max(n - 1, 0))
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    alive = np.ones(n, bool)
    for step in range(n - 1):
        best = np.where(alive, d[np.arange(n), near], np.inf)
        i = int(best.argmin())
        j = int(near[i])
        apart[step] = best[i]
        i, j = min(i, j), max(i, j)
        pairs[step] = i, j
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        stale = alive & ((near == i) | (near == j) | (np.arange(n) == i))
        near[stale] = d[stale].argmin(axis=1)
        closer = alive & (d[:, i] < d[np.arange(n), near])
        near[closer] = i
    return pairs, apart


def labels_of(pairs: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of the k clusters that are left after the first merges, numbered by first occurrence."""
    owner = np.arange(n)
    for i, j in pairs[: n - min(max(k, 1), n)]:
        owner[owner == j] = i
    return first_occurrence(owner)


def average_linkage(v: np.ndarray, cut: float, most: int) -> np.ndarray:
    """Labels by average linkage on cosine distance, merged while the closest two lie within ``cut`` or more than ``most`` clusters remain;
    numbered by first occurrence."""
    n = len(v)
    pairs, apart = linkage_steps(v)
    stop = np.flatnonzero((apart > cut) & (n - np.arange(len(apart)) <= most))
    return labels_of(pairs, n, n - int(stop[0]) if len(stop) else 1)


def mean_silhouettes(u: np.ndarray, labelings: list[np.ndarray], rows: int = 1024) -> list[float]:
    """The mean silhouette under cosine distance of the unit vectors under each labeling; a vector alone is at distance 0 from its own cluster."""
    n, total = len(u), np.zeros(len(labelings))
    member = [np.eye(int(x.max()) + 1)[x] for x in labelings]
    for i in range(0, n, rows):
        at = np.arange(i, min(i + rows, n))
        d = np.clip(1.0 - u[at] @ u.T, 0.0, 2.0)
        d[at - i, at] = 0.0
        for m, (labels, one) in enumerate(zip(labelings, member)):
            size, far = one.sum(axis=0), d @ one
            own = labels[at]
            a = far[at - i, own] / np.maximum(size[own] - 1, 1)
            mean = far / size
            mean[at - i, own] = np.inf
            b = mean.min(axis=1)
            total[m] += np.where((a == 0) & (b == 0), 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).sum()
    return (total / n).tolist()


def absorb_few(u: np.ndarray, labels: np.ndarray, least: int) -> np.ndarray:
    """Members of clusters of fewer than ``least`` unit vectors go to the nearest centroid of the others; numbered densely in the order of labels."""
    size = np.bincount(labels)
    large = np.flatnonzero(size >= least)
    move = size[labels] < least
    if len(large) and move.any():
        c = np.stack([u[labels == k].mean(axis=0) for k in large])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        labels = labels.copy()
        labels[move] = large[(u[move] @ c.T).argmax(axis=1)]
    return np.unique(labels, return_inverse=True)[1]


def calibrated_linkage(v: np.ndarray, bias: float = 0.0, most: int = 8, force_k: int | None = None, allow_single: bool = False) -> np.ndarray:
    """Labels by average linkage, cut at the calibrated threshold. Where that leaves more than ``most`` clusters or only one, the number from 2 to
    ``most`` with the best mean silhouette is taken, the least of equals; ``force_k`` takes so many in any case, ``allow_single`` accepts the one.
    Clusters of fewer than 3 to 8 vectors, a twentieth of all between, are absorbed at the end."""
    n = len(v)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    pairs, apart = linkage_steps(v)
    if force_k is not None:
        labels = labels_of(pairs, n, force_k)
    else:
        cut = max(1e-6, 1.0 - (two_gaussian_threshold((u @ u.T)[np.triu_indices(n, 1)]) + bias))
        over = np.flatnonzero(apart > cut)
        k = n - int(over[0]) if len(over) else 1
        if k < 2 and allow_single:
            return np.zeros(n, dtype=np.int64)
        if not 2 <= k <= most:
            tried = [labels_of(pairs, n, x) for x in range(2, min(most, n) + 1)]
            k = 2 + int(np.argmax(mean_silhouettes(u, tried))) if tried else 2
        labels = labels_of(pairs, n, k)
    return absorb_few(u, labels, max(3, min(8, n // 20)))


def first_occurrence(labels: np.ndarray) -> np.ndarray:
    return pd.factorize(labels)[0]


def forward_backward(log_emission: np.ndarray, log_transition: np.ndarray, log_initial: np.ndarray) -> tuple[np.ndarray, float]:
    """State posteriors and the log-likelihood of a sequence."""
    n, k = log_emission.shape

    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    f, b = np.empty((n, k)), np.zeros((n, k))
    f[0] = log_initial + log_emission[0]
    for t in range(1, n):
        f[t] = total(f[t - 1][:, None] + log_transition, 0) + log_emission[t]
    for t in range(n - 2, -1, -1):
        b[t] = total(log_transition + (log_emission[t + 1] + b[t + 1])[None, :], 1)
    like = float(total(f[-1][None, :], 1)[0])
    return np.exp(f + b - like), like


def hmm_refine(x: np.ndarray, labels: np.ndarray, loop: float = 0.9, sharp: float = 5.0, data: float = 0.3, prior: float = 1.0, phi: np.ndarray | None = None, steps: int = 20, least: float = 1e-4) -> np.ndarray | None:
    """Variational refinement of labels: speakers as latent means under a unit prior, a Markov chain over them that stays with probability
    ``loop``; begins from a softmax of ``sharp`` times the labels. None where fewer than two speakers are left. ``data`` and ``prior`` scale what the vectors and
    the prior count for; ``phi``: the variance between speakers along each dimension, of vectors whose variance within a speaker is one (1 unless given)."""
    phi = np.ones(x.shape[1]) if phi is None else np.asarray(phi, dtype=float)
    scaled, ratio = x * np.sqrt(phi), data / prior
    k = int(labels.max()) + 1
    start = np.exp(sharp * np.eye(k)[labels])
    g = start / start.sum(axis=1, keepdims=True)
    pi, before = np.full(k, 1.0 / k), -np.inf
    for _ in range(steps):
        n = g.sum(axis=0)
        var = 1.0 / (1.0 + ratio * n[:, None] * phi)  # of each speaker along each dimension
        mean = ratio * var * (g.T @ scaled)
        em = data * (scaled @ mean.T - 0.5 * ((mean**2 + var) @ phi))
        tr = np.log(loop * np.eye(k) + (1 - loop) * pi[None, :] + 1e-8)
        g, like = forward_backward(em, tr, np.log(pi + 1e-8))
        pi = np.maximum(g[0] + (1 - loop) * g.sum(axis=0), 1e-8)
        pi /= pi.sum()
        bound = like + prior * 0.5 * (np.log(var) - var - mean**2 + 1).sum()
        if bound - before < least:
            break
        before = bound
    out = first_occurrence(g.argmax(axis=1))
    return out if out.max(initial=0) >= 1 else None


def cluster_recordings(df: DataFrame, rec: str, key: str, v: str, bias: float = 0.0, most: int = 8, refine: bool = False, force_k: int | None = None, allow_single: bool = False) -> DataFrame:
    """rec, key, cluster of each vector: threshold by calibration, linkage (see ``calibrated_linkage``), and optionally the Markov refinement."""
    kind = df.schema
    shape = f"`{rec}` {kind[rec].dataType.simpleString()}, `{key}` {kind[key].dataType.simpleString()}, cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[v].tolist(), dtype=float)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        labels = calibrated_linkage(x, bias, most, force_k, allow_single)
        if refine and labels.max(initial=0) >= 1:
            better = hmm_refine(u * np.sqrt(x.shape[1]), labels)
            labels = labels if better is None else better
        return pd.DataFrame({rec: pdf[rec].to_numpy(), key: pdf[key].to_numpy(), "cluster": labels.astype("int32")})

    return df.select(rec, key, v).groupBy(rec).applyInPandas(run, shape)


def transform(df: DataFrame, key: str, v: str, mean1: np.ndarray, lda: np.ndarray, mean2: np.ndarray) -> DataFrame:
    """key, v: centred, to unit length, projected, centred and to unit length again. The matrices are model parameters, sent with the task."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(a: pa.Array) -> pa.Array:
        x = np.array(a.to_pylist(), dtype=float) - mean1
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y = x @ lda - mean2
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return pa.array(list(y), type=pa.list_(pa.float64()))

    return df.filter(F.col(v).isNotNull()).select(key, project(F.col(v)).alias(v))
