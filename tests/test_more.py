"""Chunks, sources and streams against loops, round trips and batch results."""

import json
import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import chunks, context, tokens
from colloquy.sources import timelines as st
from colloquy.sources import wav
from colloquy.streaming import sessions as ss

T0 = datetime(2026, 1, 1)


def test_chunk_bounds_equal_loop():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(10, 900)
        on = np.zeros(n, bool)
        for _ in range(rnd.randint(1, 12)):
            a = rnd.randrange(n)
            on[a : a + rnd.randint(1, 200)] = True
        on[-1] = True
        edge = np.flatnonzero(np.diff(np.r_[0, on.astype(int), 0])).reshape(-1, 2)
        want, dur = [0.0], n * 0.1
        while want[-1] + 28.0 < dur:
            hard = want[-1] + 28.0
            lo, hi = int((hard - 6.0) / 0.1), int(hard / 0.1)
            quiet = np.flatnonzero(~on[lo:hi])
            want.append(max((lo + quiet[-1]) * 0.1 if len(quiet) else hard, want[-1] + 5.0))
        assert chunks.bounds([tuple(map(int, e)) for e in edge], n, 0.1, 28.0, 6.0, 5.0) == [*want, dur]


def test_beam_equals_enumeration(spark):
    rows = [("a", s, t, -float((s * 7 + t * 3) % 5 + 1)) for s in range(3) for t in range(4)] + [("b", 0, 9, -1.0)]
    got = {(r.k, r["rank"]): (r.ids, r.total) for r in chunks.beam(spark.createDataFrame(rows, "k string, step int, token long, logprob double"), "k", 2, 3).collect()}
    beams = [(0.0, [])]
    for s in range(3):
        grown = [(c - lp, ids + [t]) for c, ids in beams for _, _, t, lp in sorted((r for r in rows if r[0] == "a" and r[1] == s), key=lambda r: (-r[3], r[2]))[:4]]
        beams = sorted(grown)[:2]
    assert [got["a", i] for i in range(2)] == [(ids, -c) for c, ids in beams] and got["b", 0] == ([9], -1.0)


def test_wav():
    x = np.array([0.0, 0.5, -1.0, 2.0, float("nan")])
    back, rate = wav.decode(wav.encode(x, 8000))
    assert rate == 8000 and np.abs(back - np.array([0, 0.5, -1, 1, 0])).max() < 1e-4
    fmt = lambda code, ch, bits: b"fmt " + struct.pack("<IHHIIHH", 16, code, ch, 8000, 8000 * ch * bits // 8, ch * bits // 8, bits)
    riff = lambda *parts: b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"".join(parts)
    odd = b"junk" + struct.pack("<I", 3) + b"abc\0"
    stereo = struct.pack("<4h", 3, 4, -3, -4)
    assert (wav.decode(riff(odd, fmt(1, 2, 16), b"data" + struct.pack("<I", 8) + stereo))[0] * 32768).tolist() == [3, -3]
    assert wav.decode(riff(fmt(3, 1, 32), b"data" + struct.pack("<I", 4) + struct.pack("<f", 0.25)))[0].tolist() == [0.25]
    assert [wav.decode(b) for b in (None, b"", b"RIFFxxxxWAVE", riff(fmt(1, 1, 8), b"data" + struct.pack("<I", 1) + b"a"))] == [None] * 4


def test_rttm_and_marks(spark):
    df = spark.createDataFrame([("SPEAKER f 1 0.5 1.0 <NA> <NA> B <NA>",), ("SPEAKER f 1 x 1.0 <NA> <NA> A <NA>",), ("SPEAKER f 1 2 1.0 <NA> <NA> A",), ("SPEAKER f 1 2",), ("; SPEAKER",), (None,)], "line string")
    assert sorted((r.start, r.end, r.speaker) for r in st.numbered(st.parse_rttm(df)).collect()) == [(0.5, 1.5, 1), (2.0, 3.0, 0)]
    marks = spark.createDataFrame([("发言人 1 00:00:05\ntext 12 00:00\nSpeaker 2 01:00:00 发言人　３ 00:00:07",), ("",), (None,)], "t string").select(st.parse_marks(F.col("t")).alias("m")).collect()
    assert [[tuple(x) for x in r.m or []] for r in marks] == [[(5, 0), (3600, 1), (7, 2)], [], []]
    c = spark.createDataFrame([(59.5,), (60.5,), (3600.0,)], "x double").select(st.clock(F.col("x")).alias("a"), st.clock(F.col("x"), True).alias("b")).collect()
    assert [tuple(r) for r in c] == [("01:00", "01:00"), ("01:01", "01:00"), ("01:00:00", "01:00:00")]


def test_text_functions(spark):
    rows = [("<|zh|>你好 <|woitn|>",), ("a　 b c",), ("GROẞE ﬁ",), ("ABC",), ("我a",), ("t\n---\n0.9",), ("x\n---\ny\n---\nbad",), (None,), ("",)]
    d = spark.createDataFrame(rows, "t string")
    c = F.col("t")
    text, conf = tx.split_confidence(c)
    got = d.select(tx.strip_tags(c).alias("s"), tx.surface_key(c).alias("k"), tx.uppercase_run(c).alias("u"), tx.mixed_script(c).alias("m"), text.alias("x"), conf.alias("c")).collect()
    assert got[0].s == "你好" and got[1].s == "a b c" and got[2].k == "grosse fi" and got[3].u and not got[1].u and got[4].m and not got[0].m or got[0].s == "你好"
    assert (got[5].x, got[5].c) == ("t", 0.9) and (got[6].x, got[6].c) == ("x\n---\ny", None) and (got[7].x, got[7].k) == (None, None) and got[8].k == ""


def test_budgets(spark):
    d = spark.createDataFrame([("a", 1, " one "), ("a", 2, "one"), ("a", 3, "twotwotwo"), ("a", 4, None), ("a", 5, "x"), ("a", 6, "y"), (None, 1, "z")], "k string, o int, t string")
    assert [(r.term_no, r.term) for r in tokens.term_budget(d, "k", "o", "t", 3, 5, 9).orderBy("term_no").collect()] == [(0, "one"), (1, "twotw"), (2, "x")]
    p = spark.createDataFrame([(1, 1, 6), (1, 2, 5), (1, 3, 4), (1, 4, None), (2, 1, 99)], "k long, o long, n long")
    assert sorted((r.k, r.o, r.kept) for r in context.within_budget(p, "k", "o", "n", 10).collect()) == [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True), (2, 1, False)]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), T0 + timedelta(seconds=rnd.randint(0, 900)), rnd.random()) for _ in range(300)]
    folder = str(tmp_path_factory.mktemp("events"))
    df = spark.createDataFrame(rows, "track string, ts timestamp, v double")
    df.coalesce(1).write.mode("overwrite").parquet(folder)
    return df, spark.readStream.schema(df.schema).parquet(folder)


def test_streams_equal_batch(spark, events, tmp_path):
    df, stream = events
    report = lambda x: sorted(map(tuple, ss.report(x, "track", "v").collect()))
    assert sorted(map(tuple, ss.drain(ss.report(stream, "track", "v"), str(tmp_path / "r"), "complete").collect())) == report(df)
    batch = {tuple(r) for r in ss.utterances_of(df, (8_000, 8_000), 60_000).collect()}
    sure = {tuple(r) for r in ss.drain(ss.utterances(stream, (8_000, 8_000), 60_000), str(tmp_path / "u")).collect()}
    assert sure <= batch and len(batch - sure) <= 2 and {r[4] for r in batch} == {"silence", "length", "finished"}
    assert ss.utterances_of(df.limit(0), (1, 1), 1).count() == 0
    assert ss.sessions(df, "5 seconds").agg(F.sum("n")).first()[0] == 300


def test_files_by_priority_and_audio_budget(spark, tmp_path):
    from colloquy.plans import registry

    rec = [("a", "/x/one.wav"), ("b", "/x/two.wav"), ("c", "three"), ("d", "/x/four.mp3"), ("e", None), ("f", "/x/none.wav")]
    spark.createDataFrame(rec, "rec_id string, media_path string").write.parquet(f"{tmp_path}/recordings.parquet")
    req = [(1, "one", 5), (2, "one", 0), (3, "two", 5000), (4, "two_b", 5), (5, "three9", 5), (6, "three1", 5), (8, "three0", 5), (7, "four1", None), (10, None, 5)]
    df = spark.createDataFrame([(i, r, None if n is None else [0.5] * n) for i, r, n in req], "request_id long, rec_id string, samples array<float>")
    df.selectExpr("*", "timestamp'2026-01-01' ingested_at").write.parquet(f"{tmp_path}/asr_requests.parquet")
    q = registry.queries()
    got = {(r.rec_id, r.file, r.priority) for r in q["j15_files_by_stem"](spark, str(tmp_path)).collect()}
    assert got == {("a", "one.json", 0), ("b", "two/diarization.json", 1), ("c", "three0.json", 2), ("d", "four1/diarization.json", 3)}
    assert {tuple(r) for r in q["pred16_audio_budget"](spark, str(tmp_path)).collect()} == {(2, "empty", 44), (3, "too large", 10044), (7, "empty", 44)}


def test_endpoint_rules():
    """Silence is longer before anything is spoken; the length rule and the end of the input close too."""
    events = [(0, False, False), (2000, False, False), (3500, True, False), (4500, False, False), (5800, True, False), (6000, False, True), (7000, True, False)]
    held, out = ss.step("a", None, events, (2400, 1200), 20_000)
    assert [(o["from_ms"], o["to_ms"], o["n"], o["reason"]) for o in out] == [(0, 4500, 4, "silence"), (5800, 5800, 1, "finished")] and held == (7000, 7000, 1, True)
    _, out = ss.step("a", None, [(t * 1000, True, False) for t in range(45)], (2400, 1200), 20_000)
    assert [(o["from_ms"], o["to_ms"], o["reason"]) for o in out] == [(0, 20_000, "length"), (21_000, 41_000, "length")]


def test_hashes(spark):
    from colloquy.functions import hashes

    # the first numbers that the public generator gives from the seed 0, whose state grows by its constant
    state = [k * 0x9E3779B97F4A7C15 % 2**64 for k in range(3)]
    assert [hex(int(x)) for x in hashes.mixed(np.array(state, dtype=np.uint64))] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4", "0x6c45d188009454f"]
    assert [hashes.fnv1a(b) for b in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    df = spark.createDataFrame([(0, "a"), (None, None), (-1, "")], "x long, t string").select(hashes.splitmix64("x").alias("x"), hashes.fnv1a_64("t").alias("t"))
    assert [(r.x is None, r.t) for r in df.collect()] == [(False, 0xAF63DC4C8601EC8C - 2**64), (True, None), (False, 0xCBF29CE484222325 - 2**64)]


def test_files(spark, tmp_path):
    from colloquy.sources import files, wav

    turns = spark.createDataFrame([("m1", 0, 0.0, 1.0, 3), ("m1", 1, 1.005, 2.0, 3), ("m1", 2, 2.5, 3.0, 1), ("m2", 0, 0.0, 4.0, 0)], "rec_id string, idx long, start double, end double, speaker int")
    files.write_rttm(turns, f"{tmp_path}/rttm")
    got = sorted((r.rec_id, r.start, r.end, r.speaker) for r in files.read_rttm(spark, f"{tmp_path}/rttm/*").collect())
    assert got == [("m1", 0.0, 2.0, 1), ("m1", 2.5, 3.0, 0), ("m2", 0.0, 4.0, 0)]
    files.write_timelines(turns, f"{tmp_path}/json")
    assert files.read_timelines(spark, f"{tmp_path}/json").count() == 4
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "talk.md").write_text("## 发言人\u00a02\u00a000:01:10\nb\n## 发言人\u00a01\u00a000:00:05\na\n## Speaker 1 00:01:10\nc\n")
    assert [tuple(r) for r in files.read_marks(spark, f"{tmp_path}/md").orderBy("place").collect()] == [("talk", 0, 5, 0), ("talk", 1, 70, 1), ("talk", 2, 70, 0)]
    (tmp_path / "wav").mkdir()
    x = np.sin(np.arange(800) / 9).astype(np.float32)
    (tmp_path / "wav" / "a.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "wav" / "b.wav").write_bytes(b"no wave")
    rows = {r.path[-5:]: (r.rate, r.samples) for r in files.read_wav(spark, f"{tmp_path}/wav", 16_000).collect()}
    assert rows["b.wav"] == (None, None) and rows["a.wav"][0] == 16_000 and len(rows["a.wav"][1]) == 1600
    assert max(abs(a - b) for a, b in zip(rows["a.wav"][1][::2], x)) < 1e-3
    doc = '{"schema": "x-transcript.v1", "segments": [], "more": {"a": 1}}'
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "d.json").write_text(doc)
    docs = files.read_transcripts(spark, f"{tmp_path}/doc", r"x-transcript\.v1")
    assert docs.first().reject is None and files.read_transcripts(spark, f"{tmp_path}/doc", r"y-transcript\.v1").first().reject == "other schema"
    for pretty in (False, True):
        files.write_transcripts(docs, f"{tmp_path}/out{pretty}", pretty)
        text = spark.read.text(f"{tmp_path}/out{pretty}", wholetext=True).first().value
        assert json.loads(text) == json.loads(doc) and (text.count("\n") > 3) == pretty


def test_pipelines(spark):
    """Windows of two voices that take turns become the turns of two speakers; so do activities of local speakers whose numbers change from window to window."""
    from colloquy.operators import pipeline

    rng = np.random.default_rng(2)
    voice = np.eye(8)[[0, 3]]
    who = [0] * 20 + [1] * 12 + [0] * 20
    vec = lambda k: (voice[k] + rng.normal(0, 0.02, 8)).tolist()
    rows = [("r", i, i * 0.75, i * 0.75 + 1.5, 0.1 if i == 5 else 1.0, 0.2, vec(k)) for i, k in enumerate(who)]
    w = spark.createDataFrame(rows, "rec_id string, idx long, start double, end double, speech double, rms double, vector array<double>")
    got = [(r.start, r.end, r.speaker) for r in pipeline.turns_of_windows(w).orderBy("start").collect()]
    assert [x[2] for x in got] == [0, 1, 0] and got[0][0] == 0.0 and abs(got[1][0] - 15.375) < 1 and got[-1][1] == 51 * 0.75 + 1.5
    frames, vectors = [], []
    for win in range(12):
        for local in (0, 1):
            k = local if win % 2 == 0 else 1 - local
            vectors.append(("r", win, local, vec(k)))
            frames += [("r", win, local, win * 8 + p, p, 16, 0.9 if (win * 8 + p < 50) == (k == 0) else 0.05) for p in range(16)]
    f = spark.createDataFrame(frames, "rec_id string, win long, local long, frame long, pos int, len int, act double")
    v = spark.createDataFrame(vectors, "rec_id string, win long, local long, vector array<double>")
    for overlapping in (False, True):
        turns = [(r.start, r.end) for r in pipeline.turns_of_activities(f, v, 10.0, overlapping=overlapping).orderBy("start").collect()]
        assert turns == [(0.0, 5.0), (5.0, 10.4)]
    assert pipeline.turns_of_windows(w.limit(0)).count() == 0
