"""p1, p2 and p5 against brute force, with nulls, ties, repeats, clashing names and empty tables."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.functions.labels import SpeakerTable
from colloquy.functions.times import to_ms
from colloquy.operators import drift
from colloquy.operators.delivery import first_delivery
from colloquy.operators.intervals import periods_and_gaps
from colloquy.operators.references import dangling_positions, deltas, merged as merged_state, orphan_keys, orphan_references, orphans, signed_counts

T0 = datetime(2026, 1, 1)


def merged(rows):
    out = []
    for s, e in sorted(r for r in rows if None not in r and r[1] > r[0]):
        if out and s <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], e), out[-1][2] + 1
        else:
            out.append([s, e, 1])
    gaps = [("gap", a[1], b[0], None) for a, b in zip(out, out[1:])]
    return {("period", a, b, n) for a, b, n in out} | set(gaps)


@pytest.mark.parametrize("bucket", [7, 50, 10_000])
def test_periods_and_gaps(spark, bucket):
    rnd = random.Random(bucket)
    rows = []
    for k in ["hot"] * 300 + list("abc") * 10 + [None]:
        s = rnd.choice([None, -20, 0, rnd.randint(-50, 900)])
        rows.append((k, rnd.choice([1, 1, None]), s, None if s is None else s + rnd.choice([-1, 0, 1, 5, 5, 40]), "x"))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "rec string, who int, s long, e long, t string")
    got = {}
    for r in periods_and_gaps(df, ["rec", "who"], "s", "e", bucket).collect():
        got.setdefault((r.rec, r.who), set()).add((r.kind, r.from_ms, r.to_ms, r.n))
    want = {}
    for k in {(r[0], r[1]) for r in rows}:
        if m := merged([(r[2], r[3]) for r in rows if (r[0], r[1]) == k]):
            want[k] = m
    assert got == want


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([], "rec string, s long, e long")
    assert periods_and_gaps(df, ["rec"], "s", "e").count() == 0


def test_first_delivery_and_times(spark):
    rows = [(1, T0, 5.0), (1, T0 - timedelta(1), 7.0), (1, None, 1.0), (2, None, 3.0), (None, T0, 1.0), (None, T0, 1.0), (3, T0, 2.0), (3, T0, 1.0)]
    df = spark.createDataFrame(rows, "id long, at timestamp, v double")
    got = sorted((r.id or 0, r.v) for r in first_delivery(df, "id", "at", ["v"]).collect())
    assert got == [(0, 1.0), (0, 1.0), (1, 7.0), (2, 3.0), (3, 1.0)]
    ms = spark.createDataFrame([(1.0005,), (0.0025,), (None,), (float("nan"),), (float("inf"),), (-1.25,)], "x double").select(to_ms(F.col("x")).alias("m")).collect()
    assert [r.m for r in ms] == [1000, 2, None, None, None, -1250]


def test_references(spark):
    at = lambda h: T0 + timedelta(hours=h)
    records = spark.createDataFrame([("a", at(1), None), ("b", at(1), at(5)), ("c", None, at(3)), ("d", at(9), at(2))], "key string, arrived timestamp, deleted timestamp")
    refs = [("a", at(2), 1), ("a", at(0), 2), ("b", at(5), 3), ("b", at(6), 4), ("c", at(4), 5), ("d", at(4), 6), ("x", at(1), 7), ("x", None, 8), (None, at(1), 9), ("a", None, 10)] + [("hot", at(1), 100 + i) for i in range(200)]
    df = spark.createDataFrame([(*r, 0) for r in refs], "key string, arrived timestamp, id int, salt int")
    got = {(r.id, r.kind) for r in orphan_references(records, df).collect()}
    assert got == {(r.id, r.kind) for r in orphan_references(records, df, heavy=1).collect()} and len(got) == orphan_references(records, df, heavy=2).count()
    assert got == {(2, "late"), (4, "deleted"), (5, "deleted"), (6, "deleted"), (7, "missing"), (8, "missing")} | {(100 + i, "missing") for i in range(200)}
    assert {(r.key, r.existing, r.referring) for r in orphan_keys(records, df).collect()} == {("b", 0, 2), ("c", 0, 1), ("d", 0, 1), ("x", 0, 2), ("hot", 0, 200)}
    assert orphan_references(records, df.limit(0)).count() == 0
    assert orphan_references(records.limit(0), df).count() == 209


def test_state_of_references_is_maintained(spark):
    """Deltas of one hour after the other, merged into the state before, are the state of all at once."""
    rnd = random.Random(6)
    at = lambda h: T0 + timedelta(hours=h)
    records = [(f"k{i}", at(rnd.randint(0, 9)), at(rnd.randint(0, 9)) if i % 3 == 0 else None) for i in range(12)]
    refs = [(f"k{rnd.randint(0, 20)}", at(rnd.randint(0, 9)), i) for i in range(200)] + [(None, at(1), 999)]
    all_ = deltas(spark.createDataFrame(records, "key string, arrived timestamp, deleted timestamp"), spark.createDataFrame(refs, "key string, arrived timestamp, id int"))
    state = signed_counts(all_.limit(0))
    for low, high in ((0, 3), (3, 4), (4, 10), (10, 20)):
        state = merged_state(state, signed_counts(all_.filter((F.col("at") >= F.lit(at(low))) & (F.col("at") < F.lit(at(high))))))
    whole = signed_counts(all_)
    assert sorted(map(tuple, state.collect()), key=str) == sorted(map(tuple, whole.select(state.columns).collect()), key=str)
    gone = {k for k, _, d in records if d is not None}
    assert {r.key for r in orphans(state).collect()} == {k for k, _, _ in refs if k is not None and (int(k[1:]) >= 12 or k in gone)}


def test_labels():
    t = SpeakerTable([("SPEAKER_01", "Ann Mary Lee"), ("SPEAKER_02", None), ("spk-a1b2c", "Bo"), (None, "Cy Xu"), ("S7", " ")])
    known = {"speaker 1": "SPEAKER_01", "ann": "SPEAKER_01", "LEE, ann  mary": "SPEAKER_01", "Spk-02": "SPEAKER_02", "SPK_A1B2C": "spk-a1b2c", "bo ": "spk-a1b2c", "cy": "", "s 07": "S7"}
    assert {k: t.find(k) for k in known} == known
    assert all(t.find(x) is None for x in ["", None, "lee", "speaker 3", "-", "ann lee"])


def test_dangling_positions(spark):
    kind = "transcript_id long, ingested_at timestamp, speakers array<struct<id:string,display_name:string>>, segments array<struct<speaker:string,text:string>>, places int"
    rows = [(1, T0, [("S1", "Ann"), None], [("S1", ""), ("", ""), (None, ""), ("Bob", ""), ("s-01", ""), None], 0), (2, T0, None, [("S1", "")], 0), (3, T0, [], None, 0), (4, None, None, [], 0)]
    got = {r.transcript_id: r.places for r in dangling_positions(spark.createDataFrame(rows, kind), "transcript_id", "ingested_at").collect()}
    assert got == {1: [3], 2: [0], 3: [], 4: []}


def lines(files):
    return [("f", n, json.dumps(d) if not isinstance(d, (str, type(None))) else d) for n, docs in files.items() for d in docs]


def test_drift(spark):
    files = {
        1: [{"schema": "v1", "a": 1, "seg": [{"x": "q", "t": 1}], "p": {"m": 1}}, "[1]", "{broken", None, "NaN"],
        2: [{"schema": "v1", "b": 1, "seg": [{"x": 3, "t": 1}, {"x": "q", "u": None}], "p": {"m": 1}}],
        3: [{"schema": "v2", "b": 1, "seg": "none", "p": {"n": 1, "o": True}}],
        5: [{"schema": "v2", "b": {"c": 1}, "p": {"n": 1}}],
    }
    rows = lines(files) * 2 + [(None, 1, "{}"), ("f", None, "{}")]
    df = spark.createDataFrame(rows, "feed string, file_no int, payload string")
    p = drift.profile(df, "feed", "file_no", "payload")
    got = {tuple(r)[1:5] for r in drift.changes(p).collect()}
    assert got == {
        (2, "renamed", "b", "a"), (2, "retyped", "seg[].x", ""), (3, "retagged", "schema", ""), (3, "retyped", "seg", ""),
        (3, "removed", "p.m", ""), (3, "added", "p.n", ""), (3, "added", "p.o", ""), (5, "retyped", "b", ""), (5, "removed", "seg", ""), (5, "removed", "p.o", ""),
    }
    names = {(r.file_no, r.path): r.unified for r in drift.unified_names(drift.changes(p), p).collect()}
    assert names[1, "a"] == "b" and names[2, "b"] == "b" and names[1, "p.m"] == "p.m"
    one = drift.unify(df.withColumn("line_id", F.monotonically_increasing_id()), drift.unified_names(drift.changes(p), p), "feed", "file_no", "payload", "line_id").filter("file_no = 1").collect()
    assert any(r["values"].get("b") == "1" for r in one)
    assert drift.changes(drift.profile(df.limit(0), "feed", "file_no", "payload")).count() == 0


def test_report_holds_every_reference_found(spark, sf):
    from colloquy.plans import registry

    q = registry.queries()
    found = {(r.ref_table, r.kind): r["count"] for r in q["p2_found"](spark, sf).groupBy("ref_table", "kind").count().collect()}
    report = {}
    for r in q["p2_orphan_report"](spark, sf).collect():
        report[r.ref_table, r.kind] = report.get((r.ref_table, r.kind), 0) + r.n
    assert report == found and found["segments", "missing"] > 0


def test_fields_renamed_together_are_unified(spark, tmp_path):
    """Two fields renamed at once under one parent are one column each; what is not alike, or has only few values in common, is not."""
    from colloquy.plans import registry

    old = lambda i: {"seg": [{"start_sec": i / 7, "speaker": f"s{i}", "done": True}], "q": [i]}
    new = lambda i: {"seg": [{"start_s": i / 9, "speaker_id": f"s{i}", "kept": True}], "q": [i]}
    rows = [(n, "f", 1 + (n >= 6), json.dumps((new if n >= 6 else old)(n % 6))) for n in range(12)]
    df = spark.createDataFrame(rows, "line_id long, feed_id string, file_no int, payload string").selectExpr("*", "timestamp'2026-01-01' delivered_at")
    df.write.parquet(f"{tmp_path}/raw_transcripts.parquet")
    q = registry.queries()
    names = {(r.file_no, r.path): r.unified for r in q["p5_names"](spark, str(tmp_path)).collect()}
    assert names[1, "seg[].start_sec"] == "seg[].start_s" and names[1, "seg[].speaker"] == "seg[].speaker_id" and names[1, "seg[].done"] == "seg[].done"
    assert all(names[2, p] == p for n, p in names if n == 2)
    values = {k for r in q["p5_unified"](spark, str(tmp_path)).collect() for k in r["values"]}
    assert values == {"seg[].start_s", "seg[].speaker_id", "seg[].done", "seg[].kept", "q"}
    assert {r.drift_kind for r in q["p5_found"](spark, str(tmp_path)).collect()} == {"removed", "added"}


def test_proposals_are_the_best_matching(spark):
    """Against all permutations, with scores by a second reading of the rules."""
    from itertools import permutations

    rnd = random.Random(12)
    names = ["start_sec", "start", "begin", "who", "speaker", "speaker_id", "words", "n_words"]
    for _ in range(40):
        docs = []
        for _ in range(2):
            picked = rnd.sample(names, rnd.randint(1, 4))
            docs.append([{n: rnd.choice([f"{rnd.randint(0, 9)}", rnd.randint(0, 9)]) if n.startswith("s") else f"v{rnd.randint(0, 6)}" for n in picked} for _ in range(6)])
        sides = [{k: [v[0], [v[1]]] for k, v in drift._profile(d).items()} for d in docs]
        went, came = sorted(sides[0].keys() - sides[1].keys()), sorted(sides[1].keys() - sides[0].keys())
        if not went or not came:
            continue
        alone = len(went) == len(came) == 1

        def score(a, b):
            if sides[0][a][0] != sides[1][b][0]:
                return 0.0
            grams = [{f"^{n}$"[i : i + 2] for i in range(len(n) + 1)} for n in (a, b)]
            p, q = ({drift.zlib.crc32((v if isinstance(v, str) else repr(v)).encode()) for d in docs[k] if (v := d.get(n)) is not None} for k, n in ((0, a), (1, b)))
            p, q = set(sorted(p)[:8]), set(sorted(q)[:8])
            both = sorted(p | q)[:8]
            shared = len([h for h in both if h in p & q]) / len(both) if both and (alone or min(len(p), len(q)) >= 4) else 0.0
            return 1 + len(grams[0] & grams[1]) / len(grams[0] | grams[1]) + shared

        small, large = (went, came) if len(went) <= len(came) else (came, went)
        best = max(sum(score(x, y) if small is went else score(y, x) for x, y in zip(small, p)) for p in permutations(large, len(small)))
        table = drift.np.array([[score(a, b) for b in came] for a in went])
        assert abs(sum(table[i, j] for i, j in drift.assignment(table)) - best) < 1e-9
        for kind, new, old, value in drift.compare(*sides, proposals=True):
            if kind in ("renamed", "proposed"):
                assert abs(value - score(old, new)) < 1e-9 and (kind == "renamed") == alone


def test_deep_documents(spark):
    deep = "[" * 900 + "{\"x\": 1}" + "]" * 900
    df = spark.createDataFrame([("f", 1, f'{{"a": {deep}}}'), ("f", 2, '{"a": [[{"x": 1}]], "b": {"c": {"d": [1, {"e": 2}]}}}')], "feed string, file_no int, payload string")
    got = {tuple(r)[2:5] for r in drift.changes(drift.profile(df, "feed", "file_no", "payload")).collect()}
    assert got == {("removed", "a" + "[]" * 900 + ".x", ""), ("added", "a[][].x", ""), ("added", "b", "")}
