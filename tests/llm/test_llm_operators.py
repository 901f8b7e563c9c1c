"""The llm operators against brute force, round trips and SQL, with nulls, ties, repeats, skew, clashing names and empty tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import fmindex, leaks, nearest, pieces, queries, runs, spans, tokens, transcripts
from colloquy.functions.labels import SpeakerTable
from tests.test_entry import con, plain  # noqa: F401

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, con, name):  # noqa: F811
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    at = [x[0] for x in cur.description]
    theirs = sorted(repr([plain(r[at.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == theirs and (theirs or name == "p10_classes")  # no copies in the smallest tables


# 3. pieces


def forward_loop(x, rate):
    low, out, s = [abs(v) <= 0.02 for v in x], [], 0
    still, i = [], 0
    while i < len(x):
        j = i
        while j < len(x) and low[j]:
            j += 1
        if j > i and (j - i) * 5 >= rate:
            still.append((i + j) // 2)
        i = max(j, i + 1)
    while len(x) - s > 20 * rate:
        fit = [m for m in still if s + 5 * rate < m <= s + 20 * rate]
        end = fit[-1] if fit else s + 20 * rate
        out.append((s, end))
        s = end - rate // 2
    return [*out, (s, len(x))]


def test_pieces(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(30):
        rate = int(rng.choice([5, 7, 10, 35]))
        x = rng.uniform(-1, 1, int(rng.integers(0, 120 * rate)))
        for a in rng.integers(0, max(1, len(x)), 12):
            x[a : a + int(rng.integers(1, rate))] = 0.01
        x = [float(np.float32(v)) for v in x]
        if i % 7 == 0 and x:
            x[len(x) // 2] = float("nan")
        rows.append((i, rate, x, None, T0, "k"))
    rows += [(100, None, [0.5] * 300, 30.0, T0, "k"), (101, 0, [0.5] * 300, None, T0, "k"), (102, 10, None, 3.0, T0, "k"), (103, -1, [0.5] * 300, float("nan"), T0, "k"), (104, None, [0.5] * 10, 0.0, T0, "k")]
    rows += [(1, 5, [0.5] * 500, None, T0 + timedelta(1), "later"), (None, 10, [0.5] * 300, None, None, None)]
    df = spark.createDataFrame(rows, "request_id long, sample_rate int, samples array<float>, duration_seconds double, ingested_at timestamp_ntz, cuts string")
    got = {}
    for r in pieces.pieces(df).orderBy("request_id", "piece_no").collect():
        got.setdefault(r.request_id, []).append((r.from_sample, r.to_sample))
    want = {r[0]: forward_loop(r[2], r[1]) for r in rows[:30] if len(r[2]) > 20 * r[1]}
    assert got == want | {100: forward_loop([0.5] * 300, 10), None: forward_loop([0.5] * 300, 10)}
    assert pieces.pieces(df.limit(0)).count() == 0


def test_bisected_pieces_cover_and_fit():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, rate = int(rng.integers(1, 3000)), int(rng.integers(1, 40))
        x = np.where(rng.random(n) < 0.6, 0.0, 1.0)
        cut = pieces.cut_bisecting(n, rate, pieces.silences(x, rate))
        assert cut[0][0] == 0 and cut[-1][1] == n and all(0 < b - a <= max(20 * rate, 1 + rate // 2) for a, b in cut)
        assert all(b[0] == max(0, a[1] - rate // 2) for a, b in zip(cut, cut[1:]))


def test_composed_pieces_equal_the_rule_from_the_left():
    rng = np.random.default_rng(3)
    for _ in range(300):
        rate = int(rng.integers(1, 25))
        x = np.where(np.repeat(rng.random(500), rng.integers(1, 12))[: int(rng.integers(1, 4000))] < rng.choice([0.05, 0.3, 0.8]), 0.0, 1.0)
        assert pieces.cut_composed(len(x), rate, pieces.silences(x, rate)) == forward_loop(x.tolist(), rate)


# 4. nearest


@pytest.mark.parametrize("bucket", [50, 100_000])
def test_nearest(spark, bucket):
    rnd = random.Random(bucket)
    iv = [(rnd.choice(["hot", "hot", "a", None]), s := rnd.randint(-100, 2000), s + rnd.choice([-1, 0, 1, 5, 30, 200, 1500]), i, 0) for i in range(150)]
    pt = [(rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([None, rnd.randint(-200, 2200), 40]), i, 0) for i in range(300)]
    p = spark.createDataFrame(pt + pt[:9], "ent string, t long, point long, b int")
    v = spark.createDataFrame(iv, "ent string, s long, e long, interval long, g int")
    got = {r.point: (r.interval, r.distance) for r in nearest.nearest_interval(p, v, 20, bucket).collect()}
    want = {}
    for e, t, k, _ in pt:
        fit = [(max(s - t, t - z, 0), -s, i) for f, s, z, i, _ in iv if t is not None and e is not None and f == e and z > s and max(s - t, t - z, 0) <= 20]
        if fit:
            d, _, i = min(fit)
            want[k] = (i, d)
    assert got == want
    assert nearest.nearest_interval(p.limit(0), v, 20).count() == 0 and nearest.nearest_interval(p, v.limit(0), 20).count() == 0


def test_innermost_equals_loop():
    rnd = random.Random(21)
    for _ in range(200):
        iv = [(rnd.randint(0, 2), s := rnd.randint(-20, 20), s + rnd.randint(1, 15), k) for k in range(rnd.randint(1, 25))]
        cols = [np.array(c) for c in zip(*iv)]
        g, at, top = nearest.innermost(*cols)
        assert sorted(set(zip(g.tolist(), at.tolist()))) == list(zip(g.tolist(), at.tolist()))
        for x, t, k in zip(g.tolist(), at.tolist(), top.tolist()):
            fit = [(-s, own, i) for i, (h, s, e, own) in enumerate(iv) if h == x and s <= t <= e]
            assert k == (min(fit)[2] if fit else -1)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_nearest_in_parts(monkeypatch, chunk):
    """A bucket larger than a group is joined in parts, each with all its intervals."""
    import pyarrow as pa

    monkeypatch.setattr(nearest, "CHUNK", chunk)
    rnd = random.Random(chunk)
    iv = [(e, b, False, s := rnd.randint(0, 300), s + rnd.randint(1, 40), i) for i in range(30) for e, b in [(rnd.choice("xy"), rnd.randint(0, 1))]]
    pt = [(e, b, True, t, t, 100 + i) for i in range(200) for e, b, t in [(rnd.choice("xxxz"), rnd.randint(0, 1), rnd.randint(-10, 350))]]
    rows = sorted(iv + pt, key=lambda r: r[:3])
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 5])], names=["ent", "b", "point", "s", "e", "id"]) for i in range(0, len(rows), 5)]
    got = [tuple(r.values()) for out in nearest._pair(9)(iter(batches)) for r in out.to_pylist()]
    want = set()
    for e, b, _, t, _, k in pt:
        fit = [(max(s - t, t - z, 0), -s, i) for f, c, _, s, z, i in iv if (e, b) == (f, c) and max(s - t, t - z, 0) <= 9]
        if fit:
            d, _, i = min(fit)
            want.add((k, i, d))
    assert len(got) == len(set(got)) and set(got) == want


# 6. transcripts


def test_read_line():
    k = SpeakerTable([("S1", "Ann Lee"), ("spk-1a2b3", "Bo")])
    cases = {
        "[00:00:07] [S1]: Uh, hello [ laughter ] there...": ("S1", ["hello", "there..."]),
        "<ANN LEE>：@00:16 we um- met at 10 — ok": ("ANN LEE", ["we", "met", "at", "10", "ok"]),
        ">> spk-1a2b3: ((door slams)) 【music】 Ähm yes": ("spk-1a2b3", ["yes"]),
        "00:00:01,000 --> 00:00:04,000 <v Bo>fine *coughs* ♪ la ♪ day": ("Bo", ["fine", "day"]),
        "no label: here at all": (None, ["no", "label:", "here", "at", "all"]),
        "": (None, []), " \n ": (None, []), "[music] hmmm": (None, []), "Unknown: hi": ("Unknown", ["hi"]),
    }
    assert {t: transcripts.read_line(t, k) for t in cases} == cases


def test_speech_that_looks_like_a_mark_is_kept():
    k = SpeakerTable([("S1", "Ann Lee")])
    cases = {
        "at 10:30 we meet": (None, "at 10:30 we meet"),
        "10:30 works for me": (None, "10:30 works for me"),
        "10:30 Ann Lee: fine": ("Ann Lee", "fine"),
        "00:16 - Ann: fine": ("Ann", "fine"),
        "it is *really* good": (None, "it is really good"),
        "2 * 3 * 4 is 24": (None, "2 3 4 is 24"),
        "the plan (as you know) works (laughter)": (None, "the plan as you know works"),
        "Error: disk full": (None, "Error: disk full"),
        "Bob: disk full": ("Bob", "disk full"),
        "(LONG BEEPS)": (None, ""), "*door slams* come in": (None, "come in"), "(yes)": (None, "yes"),
        "from 00:01:02 on [00:05] and @00:07 too": (None, "from on and too"),
    }
    assert {t: (n, " ".join(w)) for t in cases for n, w in [transcripts.read_line(t, k)]} == cases


def test_caption_files():
    people = [{"id": "S1", "display_name": "Ann Lee"}, {"id": "S2", "display_name": "Bo Ek"}]
    srt = "1\r\n00:00:01,000 --> 00:00:04,000\r\nAnn Lee: hello there\r\nhow are you (laughter)\r\n\r\n2\r\n00:00:05,000 --> 00:00:06,500\r\nBO: uh, fine at 10:30\r\n\r\n3\r\n00:00:07,000 --> 00:00:08,000\r\nbo ek: thanks\r\n"
    vtt = "\ufeffWEBVTT - a title\nKind: captions\n\nNOTE nothing\nof this\n\nSTYLE\n::cue { color: red }\n\nintro\n00:01.000 --> 00:04.000 align:start position:0%\n<v Ann Lee>hello there\nhow are you\n\n00:05.000 --> 00:06.500\n<v.loud Bo Ek>fine <i>at</i> 10:30</v>\n\n00:07.000 --> 00:08.000\n- Bo: thanks\n"
    plain_form = "[00:00:01] Ann Lee: hello there\nhow are you\n\n[00:00:05] Bo: um fine at 10:30\nBo Ek： thanks"
    want = [("S1", "hello there how are you"), ("S2", "fine at 10:30 thanks")]
    for text in (srt, vtt, plain_form):
        assert [(t[0], t[3]) for t in transcripts.caption_turns(text, people)] == want, text
    assert [t[1:3] for t in transcripts.caption_turns(srt, people)] == [(1.0, 4.0), (5.0, 8.0)] == [t[1:3] for t in transcripts.caption_turns(vtt, people)]
    assert transcripts.caption_turns("") == [] == transcripts.caption_turns("WEBVTT\n\nNOTE only\n")
    assert transcripts.caption_turns("1\n2\nthree") == [("", None, None, "1 2 three")]
    cue = "7\n00:00:01,000 --> 00:00:04,000\nAnn Lee: hello"
    assert transcripts.read_text(cue, SpeakerTable([("S1", "Ann Lee")])) == ("Ann Lee", ["hello"])


def turns_by_loop(people, segments):
    """The rules of TESTDATA.md read once more, with plain string work and no regular expression."""
    fold = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())

    def entry(label):
        key = fold(label)
        digits = key.lstrip("abcdefghijklmnopqrstuvwxyz")
        for way in range(5):
            for own, name in people:
                w = [x for x in (name or "").replace(",", " ").split() if fold(x)]
                forms = [fold(own), fold(name), w and fold(w[-1]) + "".join(map(fold, w[:-1])), w and fold(w[0])]
                if way < 4 and key and forms[way] == key:
                    return own
                own_digits = fold(own).lstrip("abcdefghijklmnopqrstuvwxyz")
                if way == 4 and digits.isdigit() and own_digits.isdigit() and int(digits) == int(own_digits):
                    return own
        return None

    out = []
    for _, i, text, who in sorted((s[0], i, s[1], s[2]) for i, s in enumerate(segments)):
        tokens, label = text.split(), None
        while tokens and (tokens[0][0] in "[(<" and tokens[0].strip("[]()<>").replace(":", "").isdigit() or tokens[0] == ">>"):
            tokens = tokens[1:]
        for n in (1, 2):
            if label is None and len(tokens) >= n and tokens[n - 1].endswith(":") and entry(" ".join(tokens[:n])) is not None:
                label, tokens = " ".join(tokens[:n])[:-1], tokens[n:]
        kept, depth = [], 0
        for w in tokens:
            depth += w.count("[")
            if not depth and any(c.isalnum() for c in w) and w.strip(",.?-").lower() not in ("uh", "um", "hmm", "erm"):
                kept.append(w)
            depth -= w.count("]")
        if not kept:
            continue
        own = who if who and who.strip() else label or ""
        who = entry(own) if entry(own) is not None else own
        if out and out[-1][2] == who:
            out[-1][1], out[-1][3] = i, out[-1][3] + len(kept)
        else:
            out.append([i, i, who, len(kept)])
    return [tuple(x) for x in out]


def test_turns_equal_a_plain_loop():
    rnd = random.Random(41)
    people = [("S1", "Ann Lee"), ("S2", "Bo Ek"), ("spk_03", None)]
    for _ in range(300):
        segs = []
        for _ in range(rnd.randint(0, 12)):
            label = rnd.choice(["", "", "Ann: ", "Lee, Ann: ", "bo ek: ", ">> S2: ", "[00:12] SPEAKER_3: ", "(1:02) "])
            words = [rnd.choice(["so", "ok.", "uh,", "Um", "ten", "[door slams]", "[ laughter ]", "hmm..."]) for _ in range(rnd.randint(0, 6))]
            segs.append((float(rnd.randint(0, 6)), label + " ".join(words), rnd.choice([None, " ", "S1", "ek bo", "Speaker 3", "Cy"])))
        got = transcripts.turns_of([{"id": a, "display_name": b} for a, b in people], [{"start_sec": a, "end_sec": a + 1, "text": t, "speaker": w, "words": None} for a, t, w in segs])
        assert [t[:4] for t in got] == turns_by_loop(people, segs), segs


def test_turns(spark):
    seg = lambda start, text, who=None, words=None: (start, None if start is None else start + 1, text, who, words)
    segs = [seg(5.0, "b", "S 1"), seg(1.0, "a", "ann"), seg(None, "z", "S9"), seg(5.0, "uh", "S2"), seg(6.0, None, None, [("c",), (None,), ("d",)]), seg(7.0, " ", ""), None, seg(float("nan"), "S1: q", " ")]
    kind = "transcript_id long, ingested_at timestamp, speakers array<struct<id:string,display_name:string>>, segments array<struct<start_sec:double,end_sec:double,text:string,speaker:string,words:array<struct<word:string>>>>, turns int"
    rows = [(1, T0, [("S1", "Ann Lee"), ("S2", None)], segs, 1), (1, T0 + timedelta(1), None, segs[:1], 1), (2, None, None, None, 1), (3, T0, None, [], 1), (None, T0, None, segs[:1], 1)]
    got = sorted(((r[0] or 0, r.first_pos, r.last_pos, r.speaker_id, r.n_words) for r in transcripts.speaker_turns(spark.createDataFrame(rows, kind)).collect()))
    assert got == [(0, 0, 0, "S 1", 1), (1, 1, 0, "S1", 2), (1, 2, 2, "S9", 1), (1, 4, 4, "", 2), (1, 7, 7, "S1", 1)]


# 7. runs


@pytest.mark.parametrize("bucket", [10, 10_000_000])
def test_runs(spark, bucket):
    rnd = random.Random(bucket)
    rows, t = [], 0
    for i in range(600):
        t += rnd.choice([0, 0, 1, 3, 6])
        rows.append((rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([1, 1, 1, 2, None]), rnd.choice([t, t, t, None]), t + rnd.choice([-2, 1, 9]), i, 0))
    df = spark.createDataFrame(rows, "rec string, who int, s long, e long, id long, ent int").repartition(5)
    got = {(r.ent, r.first_key): (r.label, r.n, r.from_ms, r.to_ms) for r in runs.collapse(df, "rec", "who", "s", "e", "id", 3, bucket).collect()}
    want = {}
    for rec in ("hot", "a"):
        last = None
        for _, w, s, e, i, _ in sorted((r for r in rows if r[0] == rec and r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[4])):
            if last and last[0] == w and s - last[1] <= 3:
                k = last[2]
                want[k] = (w, want[k][1] + 1, want[k][2], max(want[k][3], s, e))
            else:
                k = (rec, i)
                want[k] = (w, 1, s, max(s, e))
            last = (w, s, k)
    assert got == want
    assert runs.collapse(df.limit(0), "rec", "who", "s", "e", "id", 3).count() == 0


def test_likeness():
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        rows = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert runs.likeness(a, b) == (1 - rows[-1][-1] / max(len(a), len(b)) if a or b else 1.0)


@pytest.mark.parametrize("bucket", [10, 10_000_000])
def test_runs_of_near_identical_events(spark, bucket):
    """The anchor decides: a chain of events that drift is not one run."""
    rnd = random.Random(bucket)
    rows, t = [], 0
    for i in range(500):
        t += rnd.choice([0, 1, 1, 2, 9])
        rows.append((rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice(["aaaaa", "aaaab", "aaabb", "aabbb", "zz", "", None]), rnd.choice([t, t, t, None]), t + rnd.choice([-2, 1, 9]), i, 0))
    df = spark.createDataFrame(rows, "rec string, what string, s long, e long, id long, part int").repartition(5)
    got = {(r.ent, r.first_key): (r.label, r.n, r.from_ms, r.to_ms) for r in runs.collapse_like(df, "rec", "what", "s", "e", "id", 3, 0.8, bucket=bucket).collect()}
    want = {}
    for rec in ("hot", "a"):
        at, last = None, 0
        for _, w, s, e, i, _ in sorted((r for r in rows if r[0] == rec and r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[4])):
            if at and s - last <= 3 and runs.likeness(want[at][0], w) >= 0.8:
                a = want[at]
                want[at] = (a[0], a[1] + 1, a[2], max(a[3], s, e))
            else:
                at = (rec, i)
                want[at] = (w, 1, s, max(s, e))
            last = s
    assert got == want and any(v[1] > 2 for v in want.values())
    assert runs.collapse_like(df.limit(0), "rec", "what", "s", "e", "id", 3).count() == 0


# 8. tokens


def test_encoding_equals_library(spark):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.load_ranks(tokens.vocabulary()), special_tokens={})
    rnd = random.Random(3)
    parts = ["a", "the", "'s", "'", "'ll", " ", "  ", "\n", "\t", "12", "é", "日本", " ", "　", "!?", "\x1c", "\x85", "😀", "<|endoftext|>", "x" * 40, "ﬁ", "²", "﻿"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(800)] + [None, "", "ab " * 300_000, "z" * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_texts(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)} | {None: enc.encode_ordinary("a")}
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    ranks = {bytes([a, b]): a * 7 + b for a in range(20) for b in range(30)}
    h = tokens.PerfectHash.build(ranks)
    assert len(h.ids) == len(ranks)
    keys = list(ranks) + [b"zz", b"a"]
    data = np.frombuffer(b"".join(keys) + bytes(40), dtype=np.uint8)
    size = np.array([len(k) for k in keys])
    assert h.find(data, np.cumsum(size) - size, size).tolist() == [ranks.get(k, -1) for k in keys]


# 9. leaks


def naive_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_table():
    rnd = random.Random(4)
    for _ in range(500):
        p, t = ([rnd.choice("abc") for _ in range(rnd.randint(1, n))] for n in (12, 16))
        assert leaks.myers(p, t) == naive_distance(p, t)


def test_leaks(spark):
    w = [f"w{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(w)), (1, " ".join(w)), (2, " ".join(w[:11])), (3, None), (None, " ".join(w)), (4, "é " + " ".join(w[8:]))], "item_id long, text string")
    near = w[4:10] + ["zz"] + w[11:16]
    docs = [
        (1, "x " + ", ".join(w[3:15]).upper() + " y"), (2, " ".join(w[3:14])), (3, "\\emph{" + " ".join(w[:6]) + "}\n% \\textbf{" + " ".join(w[6:12]) + "}"),
        (4, " ".join(near)), (5, None), (6, ""), (7, " ".join(w[2:8]) + r" \\" + " ".join(w[8:14])), (8, "É-" + "-".join(w[8:]) + " q" * 50_000), (None, " ".join(w)),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs] * 2, "doc_id long, text string, words int")
    rows = {(r.doc_id, r.item_id): (r.n_exact, r.distance) for r in leaks.leaked_windows(df, items).collect()}
    assert rows == {(1, 1): (1, 0), (3, 1): (1, 0), (4, 1): (0, 1), (7, 1): (1, 0), (8, 1): (1, 0), (8, 4): (2, 0), (2, 1): (0, 1)} | {k: v for k, v in rows.items() if v[0] == 0 and k in {(3, 4), (1, 4), (7, 4), (4, 4)}}
    assert {tuple(r) for r in leaks.leaked_items(df, items).collect()} == {(1, 1), (3, 1), (7, 1), (8, 1), (8, 4)}
    assert leaks.leaked_items(df.limit(0), items).count() == 0 and leaks.leaked_items(df, items.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(5)], "doc_id long, text string")
    assert {tuple(r) for r in leaks.leaked_items(docs, items).collect()} == {(i, i) for i in range(5)}


# 10. spans


def test_index_equals_search():
    rnd = random.Random(5)
    for _ in range(60):
        texts = list(dict.fromkeys("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 6))))
        arr = [np.array([ord(c) for c in t], dtype=np.int32) for t in texts]
        p, pos, n, _ = fmindex.FMIndex(arr).matching_statistics(arr, np.arange(len(arr)), 4)
        want = {}
        for i, t in enumerate(texts):
            for s in range(len(t)):
                best = max((e for e in range(1, len(t) - s + 1) for q, u in enumerate(texts) if q != i and t[s : s + e] in u), default=0)
                if best >= 4:
                    want[i, s] = best
        assert {(int(a), int(b)): int(c) for a, b, c in zip(p, pos, n)} == want


def brute_pairs(texts, least):
    seen = {}
    for k, t in texts:
        for s in range(len(t or "") - least + 1):
            seen.setdefault(t[s : s + least], set()).add(k)
    return {(a, b) for g in seen.values() for a in g for b in g if a < b}


@pytest.mark.parametrize("seed", range(3))
def test_shared_pairs_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda n, al="abcdefgh ": "".join(rnd.choice(al) for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 90, 400)] + [" " * 120, "ab" * 60]
    texts = []
    for k in range(60):
        t = word(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 3)
            t += s[a : a + rnd.randint(30, 200)] + word(rnd.randint(0, 60), "xyzé日")
        texts.append((k, t))
    texts += [(100, texts[7][1]), (101, texts[7][1]), (102, None), (103, ""), (104, shared[4] * 3)]
    df = spark.createDataFrame([(k, t, 0) for k, t in texts] + [(None, shared[4], 0)] + [(k, t, 0) for k, t in texts[:3]], "doc_id long, text string, fp int")
    got = [tuple(r) for r in spans.shared_pairs(df, min_len=40, gram=20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 40)


def test_shared_pairs_of_hot_groups(spark):
    """A third of all rows are copies of one text, another third share one stretch: classes are linked to their least member, no link to
    other texts is lost."""
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    copy, stretch = word(200), word(90)
    texts = [(k, copy) for k in range(100)] + [(k, word(60) + stretch + word(60)) for k in range(100, 200)] + [(k, word(150)) for k in range(200, 300)]
    texts += [(300, word(30) + copy[50:120] + word(30)), (301, word(20) + stretch[10:80])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in spans.shared_pairs(df, min_len=40, gram=20, expand=10).collect()}
    link = {x: x for x, _ in texts}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in got:
        link[root(a)] = root(b)
    classes = {}
    for x in link:
        classes.setdefault(root(x), set()).add(x)
    assert got <= brute_pairs(texts, 40)
    assert sorted(map(len, classes.values()), reverse=True)[:3] == [101, 101, 1]
    assert (0, 300) in got and {(100, k) for k in range(101, 200)} <= got and len(got) < 600
    assert spans.shared_pairs(df.limit(0), min_len=40, gram=20).count() == 0


def test_prefixes_and_suffixes_of_other_texts(spark):
    """Many texts that go on before or after another's end: each pair has nothing but the shared end to tell its texts apart."""
    rnd = random.Random(15)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    texts = []
    for k in range(0, 1200, 2):
        t, more = word(rnd.randint(40, 90)), word(rnd.randint(1, 60))
        texts += [(k, t), (k + 1, t + more if k % 4 else more + t)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [tuple(r) for r in spans.shared_pairs(df, min_len=40, gram=20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 40) and len(got) >= 600


def test_every_pair_of_a_hot_stretch(spark, monkeypatch):
    """More different texts than any bound share one stretch, beside copies in many splits: every pair of different texts comes out."""
    monkeypatch.setattr(spans, "PAIRS_AT_ONCE", 100)
    rnd = random.Random(13)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    stretch, other = word(90), word(60)
    texts = [(k, stretch + word(60)) for k in range(80)] + [(k, word(20) + stretch[10:80] + word(20)) for k in (80, 81)]
    copy = word(50) + other + word(50)
    copied = [(k, copy) for k in range(100, 170)]
    rest = [(200, word(30) + other + word(30)), (201, other + word(30))]
    df = spark.createDataFrame(texts + copied + rest, "doc_id long, text string").repartition(80)
    got = [tuple(r) for r in spans.shared_pairs(df, min_len=40, gram=20).collect()]
    want = brute_pairs(texts + copied[:1] + rest, 40) | {(100, k) for k in range(101, 170)}
    assert len(got) == len(set(got)) and set(got) == want and (200, 201) in want and len(want) > 80 * 79 // 2


def test_every_pair_equals_loop(monkeypatch):
    monkeypatch.setattr(spans, "PAIRS_AT_ONCE", 7)
    rnd = random.Random(14)
    for _ in range(100):
        sets = [set(rnd.sample(range(30), rnd.randint(1, 12))) for _ in range(rnd.randint(1, 8))]
        flat = sorted((g, m) for g, s in enumerate(sets) for m in s)
        group, member = (np.array(x) for x in zip(*flat))
        got = [p for a, b in spans.every_pair(group, member) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == {(x, y) for s in sets for x in s for y in s if x < y}


def test_an_anchor_over_a_block_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 500)
    rnd = random.Random(11)
    core = "".join(rnd.choice("abcdefgh") for _ in range(20))
    tails = ["".join(rnd.choice("ijklmnop") for _ in range(40)) for _ in range(15)]
    texts = [(k, "".join(rnd.choice("qrstuvwx") for _ in range(40)) + core + tails[k % 15]) for k in range(60)]
    got = set()
    rows = [(7, k, 0, t[0:100]) for k, t in texts]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["fp", "doc", "begin", "region"])
    for b in spans._search(40, 64)(iter([batch])):
        got |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert got == brute_pairs(texts, 40)


def brute_cover(texts, least):
    seen = {}
    for k, t in texts:
        for s in range(len(t or "") - least + 1):
            seen.setdefault(t[s : s + least], set()).add(k)
    out = set()
    for k, t in texts:
        on = [False] * len(t or "")
        for s in range(len(on) - least + 1):
            if len(seen[t[s : s + least]]) > 1:
                on[s : s + least] = [True] * least
        # unions of windows that touch are one interval, so runs of covered characters are the intervals
        a = None
        for i, x in enumerate([*on, False]):
            if x and a is None:
                a = i
            elif not x and a is not None:
                out.add((k, a, i))
                a = None
    return out


@pytest.mark.parametrize("hot", [2, 1000])
@pytest.mark.parametrize("seed", range(2))
def test_shared_intervals_and_refined_anchors_equal_brute_force(spark, seed, hot):
    """hot=2: nearly every anchor is refined."""
    rnd = random.Random(30 + seed)
    word = lambda n, al="abcdefgh ": "".join(rnd.choice(al) for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 90, 400)] + [" " * 120, "ab" * 60]
    phrase = word(30)  # shared, but too short
    texts = []
    for k in range(80):
        t = word(rnd.randint(0, 100)) + (phrase if k % 2 else "")
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 3)
            t += word(rnd.randint(0, 40), "xyzé日😀") + s[a : a + rnd.randint(30, 200)]
        texts.append((k, t))
    texts += [(100, texts[7][1] + "q" * 50), (101, texts[7][1] + "q" * 50), (102, None), (103, ""), (104, shared[4] * 3)]
    df = spark.createDataFrame([(k, t, 0) for k, t in texts] + [(None, shared[4], 0)] + [(k, t, 0) for k, t in texts[:3]], "doc_id long, text string, begin int")
    got = [tuple(r) for r in spans.shared_pairs(df, min_len=40, gram=20, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 40)
    got = [tuple(r) for r in spans.shared_intervals(df, min_len=40, gram=20, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cover(texts, 40)
    assert spans.shared_intervals(df.limit(0), min_len=40, gram=20).count() == 0


def test_pairs_with_only_an_end_in_common_keep_an_anchor_that_tells_them_apart():
    """20,000 pairs of texts that share a prefix or a suffix and nothing else: some common anchor has different surroundings."""
    rng = np.random.default_rng(16)
    for side in ("prefix", "suffix"):
        texts = []
        for _ in range(10_000):
            common, own = rng.integers(97, 123, int(rng.integers(250, 420))), rng.integers(97, 123, int(rng.integers(1, 200)))
            more = np.concatenate([common, own] if side == "prefix" else [own, common])
            texts += [common, more]
        flat, off = np.concatenate(texts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        doc, _, fp, around, _, _ = spans.anchors(flat, off, 250, spans.GRAM)
        told = set()
        by = {}
        for d, f, a in zip(doc.tolist(), fp.tolist(), around.tolist()):
            by.setdefault((d // 2, f), {}).setdefault(d % 2, set()).add(a)
        for (pair, _), sides in by.items():
            if len(sides) == 2 and sides[0] != sides[1]:
                told.add(pair)
        assert len(told) == 10_000


def test_one_phrase_in_very_many_surroundings():
    """An anchor in 50,000 texts that share no more than a phrase: the refined anchors keep none of them together, in one batch after the other."""
    import pyarrow as pa

    rng = np.random.default_rng(17)
    phrase = "".join(map(chr, rng.integers(97, 123, 200)))
    seen, most = {}, 0
    for k in range(0, 50_000, 5000):
        texts = ["".join(map(chr, a)) + phrase + "".join(map(chr, b)) for a, b in zip(rng.integers(97, 123, (5000, 90)), rng.integers(97, 123, (5000, 90)))]
        batch = pa.RecordBatch.from_arrays([pa.array([1] * 5000), pa.array(range(k, k + 5000)), pa.array([0] * 5000, type=pa.int32()), pa.array(texts)], names=["fp", "doc", "begin", "region"])
        for out in spans._refine(250, 240)(iter([batch])):
            for f, d in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                seen.setdefault(f, set()).add(d)
    assert len(set().union(*seen.values())) == 50_000 and max(map(len, seen.values())) == 1
