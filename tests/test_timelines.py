"""Timeline folds, scores and clusters against plain loops."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from colloquy.operators import clusters, context, scoring
from colloquy.operators import timelines as tl
from colloquy.operators.frames import powerset_classes, resample

SHAPE = "rec_id string, idx long, start double, end double, speaker int"


def timeline(seed, n=120, extra=0):
    rnd = random.Random(seed)
    rows = []
    for rec in ["hot", "hot", "b"]:
        at = 0.0
        for _ in range(n):
            at = round(at + rnd.choice([0, 0.05, 0.3, 1, 2, 4, 4.5]), 3)
            rows.append((rec, len(rows), at, round(at + rnd.choice([0.05, 0.1, 0.25, 0.5, 1, 3]), 3), rnd.randint(0, 2)))
    return rows


def by_rec(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        out.setdefault(r[0], []).append([r[2], r[3], r[4]])
    return out


def tight(turns, gap):
    out = []
    for s, e, k in turns:
        if out and out[-1][2] == k and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, k])
    return out


def middle(turns, low):
    out = []
    for s, e, k in turns:
        if out and s < out[-1][1]:
            if out[-1][2] == k:
                out[-1][1] = max(out[-1][1], e)
                continue
            out[-1][1] = s = (s + out[-1][1]) * 0.5
            if e - s < low:
                continue
        out.append([s, e, k])
    return out


def swallow(turns, low, gap):
    out = []
    for s, e, k in turns:
        short = e - s < low
        if out and (short or out[-1][2] == k and s <= out[-1][1] + gap):
            out[-1][1] = max(out[-1][1], e)
        elif not short:
            out.append([s, e, k])
    return out


def last_round(turns, gap, low):
    out = []
    for s, e, k in turns:
        if out and s < out[-1][1] and out[-1][2] != k:
            out[-1][1] = s = (s + out[-1][1]) * 0.5
        if out and out[-1][2] == k and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        elif e - s >= low:
            out.append([s, e, k])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_postprocess_equals_loop(spark, seed):
    rows = timeline(seed)
    df = spark.createDataFrame(rows, SHAPE)
    got = {}
    for r in tl.split_and_fill(tl.absorb_short(tl.split_overlaps(tl.merge_same_speaker(tl.stretches(df, 3.0, 0.2), 0.05), 0.2), 0.2, 3.0), 3.0, 0.15).collect():
        got.setdefault(r.rec_id, []).append([r.start, r.end, r.speaker])
    want = {k: last_round(swallow(middle(tight(v, 0.05), 0.2), 0.2, 3.0), 3.0, 0.15) for k, v in by_rec(rows).items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_change_points_match_equals_loop(spark):
    a, b = timeline(3, 40), timeline(4, 40)
    want = {}
    for rec in ("hot", "b"):
        pts = []
        for rows in (a, b):
            t = sorted((r[2], r[1], r[4]) for r in rows if r[0] == rec)
            pts.append([y[0] for x, y in zip(t, t[1:]) if x[2] != y[2]])
        free, hits = list(range(len(pts[1]))), 0
        for r in pts[0]:
            k = next((k for k in free if abs(r - pts[1][k]) <= 0.5), None)
            if k is not None:
                free.remove(k)
                hits += 1
        want[rec] = (hits, len(pts[0]), len(pts[1]))
    x, y = (tl.change_points(spark.createDataFrame(r, SHAPE)) for r in (a, b))
    assert {r.rec_id: (r.matched, r.n_ref, r.n_hyp) for r in scoring.match_change_points(x, y, 0.5).collect()} == want


def test_best_assignment_is_best():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a = rng.integers(0, 6, (rng.integers(1, 6), rng.integers(1, 6)))
        t = a if a.shape[0] <= a.shape[1] else a.T
        best = max(sum(t[i, p[i]] for i in range(t.shape[0])) for p in itertools.permutations(range(t.shape[1]), t.shape[0]))
        assert sum(a[i, j] for i, j in scoring.best_assignment(a)) == best


def test_linkage_equals_loop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 20):
        v = rng.normal(size=(n, 4))
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d = np.clip(1 - u @ u.T, 0, 2)
        c = [[i] for i in range(n)]
        while len(c) > 1:
            m, i, j = min((np.mean([d[x, y] for x in c[i] for y in c[j]]), i, j) for i in range(len(c)) for j in range(i + 1, len(c)))
            if m > 0.6 and len(c) <= 8:
                break
            c[i] += c.pop(j)
        want = np.zeros(n, int)
        for k, x in enumerate(c):
            want[x] = k
        assert (clusters.average_linkage(v, 0.6, 8) == clusters.first_occurrence(want)).all()


def linked_loop(v, most, force_k=None):
    """Labels as the reference has them, by plain loops: cut, the best silhouette where the cut leaves too many or one, small clusters absorbed."""
    n = len(v)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.clip(1 - u @ u.T, 0, 2)
    c, at, apart = [[i] for i in range(n)], {n: np.arange(n)}, []
    while len(c) > 1:
        m, i, j = min((np.mean([d[x, y] for x in c[i] for y in c[j]]), i, j) for i in range(len(c)) for j in range(i + 1, len(c)))
        c[i] += c.pop(j)
        apart.append(m)
        at[len(c)] = clusters.first_occurrence(np.array([next(k for k, x in enumerate(c) if i in x) for i in range(n)]))

    def silhouette(labels):
        out = []
        for i in range(n):
            far = {k: [d[i, j] for j in range(n) if j != i and labels[j] == k] for k in set(labels.tolist())}
            a = np.mean(far[labels[i]]) if far[labels[i]] else 0.0
            b = min(np.mean(x) for k, x in far.items() if k != labels[i])
            out.append(0.0 if a == b == 0 else (b - a) / max(a, b))
        return np.mean(out)

    cut = max(1e-6, 1 - clusters.two_gaussian_threshold((u @ u.T)[np.triu_indices(n, 1)]))
    first = k = n - sum(1 for _ in itertools.takewhile(lambda m: m <= cut, apart))
    if force_k:
        k = force_k
    elif not 2 <= k <= most:
        k = max(range(2, min(most, n) + 1), key=lambda x: (round(silhouette(at[x]), 12), -x))
    labels, least = at[k].tolist(), max(3, min(8, n // 20))
    size = Counter(labels)
    large = [x for x in sorted(size) if size[x] >= least]
    if large:
        cen = {x: u[[y == x for y in labels]].mean(axis=0) for x in large}
        labels = [x if size[x] >= least else max(large, key=lambda g: (u[i] @ cen[g] / np.linalg.norm(cen[g]), -g)) for i, x in enumerate(labels)]
    return first, [sorted(set(labels)).index(x) for x in labels]


def test_number_of_clusters_by_silhouette(spark):
    """Cuts that leave too many clusters, one, or a number within the range."""
    rng = np.random.default_rng(4)
    recs, firsts = {}, set()
    for r in range(12):
        v = rng.normal(size=(int(rng.integers(12, 40)), 6)) + 4 * np.eye(6)[rng.integers(0, r % 4 + 1, 1)] * (r % 2)
        if r in (7, 8, 9):  # many tight groups
            v = np.repeat(rng.normal(size=(14, 12)), 3 + r % 2, axis=0)
            v = v + 0.05 * rng.normal(size=v.shape)
        if r == 10:
            v = np.ones((20, 6)) + 1e-9 * rng.normal(size=(20, 6))
        recs[r] = v
    rows = [(r, i, x.tolist()) for r, v in recs.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "rec int, vec_id int, v array<double>")
    for most, force in ((4, None), (8, 5)):
        got = {}
        kw = {"force_k": force} if force else {}
        for x in sorted(clusters.cluster_recordings(df, "rec", "vec_id", "v", most=most, **kw).collect()):
            got.setdefault(x.rec, []).append(x.cluster)
        for r, v in recs.items():
            if r == 10:
                continue
            first, want = linked_loop(v, most, force)
            firsts.add("many" if first > most else "one" if first < 2 else "fit")
            assert got[r] == want, r
    assert firsts == {"many", "one", "fit"}
    same = recs[10]
    assert clusters.calibrated_linkage(same, 0.0, 8, None, True).max() == 0
    assert clusters.calibrated_linkage(same[:1]).tolist() == [0] and clusters.labels_of(clusters.linkage_steps(same)[0], 20, 3).max() == 2


def test_known_vectors():
    assert np.isfinite(clusters.two_gaussian_threshold(np.r_[np.full(25, 0.1), np.full(25, 0.9)]))
    classes = powerset_classes(4, 2)
    assert len(classes) == 11 and classes[0] == [] and classes[1] == [0] and classes[10] == [2, 3]
    assert resample(np.array([0.0, 1.0]), 1, 2, "endpoints").tolist() == [0.0, 1 / 3, 2 / 3, 1.0]
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(20, 8)) * 0.2 + 3 * np.eye(8)[0], rng.normal(size=(20, 8)) * 0.2 + 3 * np.eye(8)[1]]
    assert clusters.hmm_refine(x, np.repeat([0, 1], 20)).tolist() == [0] * 20 + [1] * 20


def test_first_accepted_and_reading_order(spark):
    box = (0.0, 0.0, 100.0, 50.0)
    rows = [(1, 3, 0, "Hello  World", *box), (1, 1, 1, "hello world", *box), (1, 2, 1, "hello world", None, None, None, None), (1, 4, 2, "other", *box), (1, 5, 2, " ", *box), (1, 6, 2, "HELLO WORLD", 500.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "capture long, seq long, priority int, text string, x double, y double, width double, height double")
    assert {(r.seq, r["into"]) for r in context.first_accepted(df).collect()} == {(3, 3), (1, 3), (2, 2), (4, 4), (6, 6)}
    fused = {r.seq: (r.place, r.n_refs, r.duplicate, r.conflict) for r in context.fuse(df).collect()}
    assert fused == {3: (0, 2, True, 3), 2: (1, 1, False, None), 4: (2, 1, False, 3), 6: (3, 1, False, None)}
    page = spark.createDataFrame([(1, 0.5, 0.8, 0.1, "b"), (1, 0.1, 0.81, 0.1, "a "), (1, 0.1, 0.2, 0.1, "c"), (1, 0.1, 0.2, 0.1, " ")], "page long, x double, y double, h double, text string")
    assert context.reading_order(page).collect()[0].text == "a\nb\nc"


def test_windows_of_recordings_of_any_length(spark, tmp_path):
    from colloquy.plans import registry

    lens = {"a": 5.0, "b": 86399.0, "c": 86400.0, "d": 200_000.3, "e": 16.1, "f": 24.0}
    rows = [(k, v) for k, v in lens.items()] + [("g", float("nan")), ("h", float("inf")), ("i", None), ("j", -1.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "rec_id string, duration_seconds double").selectExpr("*", "timestamp'2026-01-01' ingested_at")
    df.write.parquet(f"{tmp_path}/recordings.parquet")

    def loop(n, size, hop, flush):
        out = list(range(0, max(n - size, 0) + 1, hop))
        return out + [n - size] * (flush and n > size and out[-1] + size < n)

    for name, rate, size, hop, flush in (("m11_windows", 10, 160, 80, True), ("m10_windows", 100, 150, 75, False)):
        got = {}
        for r in registry.queries()[name](spark, str(tmp_path)).toPandas().itertuples():
            got.setdefault(r.rec_id, []).append(r.start)
        assert {k: sorted(v) for k, v in got.items()} == {k: loop(round(v * rate), size, hop, flush) for k, v in lens.items()}


@pytest.mark.parametrize("bucket", [3, 40, 10_000])
def test_painted_equals_cells(spark, bucket):
    """Spans against cells, with one interval that reaches over very many buckets."""
    from colloquy.operators.painting import painted

    rnd = random.Random(bucket)
    rows = [(rnd.choice(["hot", "hot", "a", None]), a := rnd.randint(0, 200), a + rnd.choice([-1, 0, 1, 4, 30, 120]), i, rnd.choice([0, 1, 2, None])) for i in range(120)]
    far = [("hot", 150, 10**11, 500, 7), ("b", -5, 10**12, 1, 1), ("b", 10**11, 10**11 + 2, 2, 2)]
    kind = "rec_id string, a long, b long, rank long, label int"
    one, two = spark.createDataFrame(rows[::2] + far, kind), spark.createDataFrame(rows[1::2], kind)
    got = sorted(tuple(r) for r in painted({"x": one, "y": two}, bucket).collect())
    assert all(p[0] != q[0] or p[2] <= q[1] for p, q in zip(got, got[1:])) and all(r[2] > r[1] for r in got)
    want = {}
    for layer, part in ((0, rows[::2] + far), (1, rows[1::2])):
        for rec, a, b, i, label in sorted(part, key=lambda r: r[3]):
            if rec is not None and label is not None:
                for c in range(a, min(b, 400)):
                    want.setdefault((rec, c), [-1, -1])[layer] = label
    cells = {(r[0], c): [r[3], r[4]] for r in got for c in range(r[1], min(r[2], 400))}
    assert cells == want
    late = [(r[1], r[2], r[3]) for r in got if r[0] == "b" and r[2] > 10**11]
    assert sum(b - max(a, 10**11) for a, b, x in late if x == 1) == 10**12 - 10**11 - 2 and [b - a for a, b, x in late if x == 2] == [2]
    assert painted({"x": one.limit(0)}).count() == 0


def test_overlapping_pairs_come_once(spark):
    from colloquy.operators.joins import overlapping

    rnd = random.Random(4)
    make = lambda n: [(rnd.choice("ab"), float(s := rnd.randint(0, 300)), float(s + rnd.choice([0, 1, 7, 90, 10**9])), i) for i in range(n)]
    x, y = make(60), make(50)
    got = [(r.i, r.j) for r in overlapping(spark.createDataFrame(x, "k string, start double, end double, i int"), spark.createDataFrame(y, "k string, s double, e double, j int"), "k", 3.0).collect()]
    want = {(i, j) for k, a, b, i in x for q, s, e, j in y if k == q and s < b and a < e}
    assert len(got) == len(set(got)) and set(got) == want
