"""Queries over frames and samples, and joins of intervals by time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import frames as fr
from colloquy.operators import joins as jn
from colloquy.operators import timelines as tl
from colloquy.operators.delivery import first_delivery
from colloquy.plans.registry import query, table
from colloquy.plans.texts import SEG, WORDS, segments, words
from colloquy.plans.timelines import TL, raster_sql, timeline

# Sparse frames: the hours in which a user has events, each type a label, the value its strength.
FRAMES = "fr as (select user_id u, (epoch_us(ts) // 3600000000)::bigint f, event_type label, max(value) v from events group by all)"


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("f"), F.col("event_type").alias("label"), "value")
    return e.groupBy("u", "f", "label").agg(F.max("value").alias("v"))


RUNS = f"""{FRAMES}, on_ as (select distinct u, f from fr), k as (select u, f, f - row_number() over (partition by u order by f) g from on_), runs as (select u, min(f) a, max(f) + 1 b from k group by u, g),
m as (select *, coalesce((a - lag(b) over (partition by u order by a) > 3)::int, 1) fresh from runs), n as (select *, sum(fresh) over (partition by u order by a rows unbounded preceding) part from m), filled as (select u, min(a) a, max(b) b from n group by u, part)"""


@query("r09_runs", f'with {RUNS} select u, a "from", b "to" from runs')
def r09_runs(spark, sf_dir):
    return fr.runs(_frames(spark, sf_dir).select("u", "f").distinct(), ["u"], "f")


@query("r10_filled", f'with {RUNS} select u, a "from", b "to" from filled')
def r10_filled(spark, sf_dir):
    return fr.fill_gaps(r09_runs(spark, sf_dir), ["u"], 3)


@query("r11_long_runs", f'with {RUNS} select u, a "from", b "to" from filled where b - a >= 4')
def r11_long_runs(spark, sf_dir):
    return fr.drop_short(r10_filled(spark, sf_dir), 4)


@query("r27_tracks", f"""with {FRAMES}, k as (select u, label, f, f - row_number() over (partition by u, label order by f) g from fr), runs as (select u, label, min(f) a, max(f) + 1 b from k group by u, label, g),
m as (select *, coalesce((a - lag(b) over (partition by u, label order by a) > 24)::int, 1) fresh from runs), n as (select *, sum(fresh) over (partition by u, label order by a rows unbounded preceding) part from m)
select u, label, min(a) "from", max(b) "to" from n group by u, label, part having max(b) - min(a) >= 2""")
def r27_tracks(spark, sf_dir):
    """Per speaker: onset, gaps filled, short runs dropped; tracks of different speakers may overlap."""
    r = fr.runs(_frames(spark, sf_dir), ["u", "label"], "f")
    return fr.drop_short(fr.fill_gaps(r, ["u", "label"], 24), 2)


ARGMAX = f"{FRAMES}, am as (select u, f, case when max(v) >= 20 then arg_min(label, (-v, label)) else 'none' end label from fr group by all)"


def _argmax(spark, sf_dir):
    labels = _frames(spark, sf_dir).withColumn("label", F.when(F.col("label") == "click", 0).otherwise(F.length("label") * 10 + F.ascii(F.substring("label", 1, 1)) % 10))
    return fr.argmax_labels(labels, ["u"], "f", "label", "v", 20.0)


LABELS = f"""{FRAMES}, fl as (select u, f, case when label = 'click' then 0 else len(label) * 10 + ascii(label[1:1]) % 10 end label, v from fr), flm as (select u, f, label, max(v) v from fl group by all),
am as (select u, f, case when max(v) >= 20 then arg_min(label, (-v, label)) else -1 end::int label from flm group by all)"""


@query("r20_argmax", f"with {LABELS} select u, f, label from am")
def r20_argmax(spark, sf_dir):
    return _argmax(spark, sf_dir)


MODE = f"""{LABELS}, votes as (select c.u, c.f, o.label, count(*) n, min(o.f) first_f from am c join am o on o.u = c.u and o.f between c.f - 6 and c.f + 6 where c.label >= 0 and o.label >= 0 group by all),
best as (select u, f, label from votes qualify row_number() over (partition by u, f order by n desc, first_f) = 1), md as (select am.u, am.f, coalesce(best.label, am.label) label from am left join best on best.u = am.u and best.f = am.f)"""


@query("r03_mode_filter", f"with {MODE} select u, f, label from md")
def r03_mode_filter(spark, sf_dir):
    return fr.mode_filter(_argmax(spark, sf_dir), ["u"], "f", "label", 6)


@query("r28_exclusive_turns", f"""with {MODE}, k as (select u, label, f, f - row_number() over (partition by u, label order by f) g from md where label >= 0) select u, label, min(f) "from", max(f) + 1 "to" from k group by u, label, g""")
def r28_exclusive_turns(spark, sf_dir):
    """The strongest label of each frame, smoothed, as turns."""
    return fr.runs(r03_mode_filter(spark, sf_dir).filter("label >= 0"), ["u", "label"], "f")


@query("a09_overlap_add", f"""with {FRAMES}, w as (select u, f, label, v, unnest([f // 8, f // 8 - 1]) win from fr), p as (select *, f - win * 8 pos from w),
x as (select *, 0.1e0 + 0.9e0 * (1 - abs(pos - 7.5e0) / 8.5e0) wt from p) select u, f, label, round(sum(v * wt) / sum(wt), 6) act from x group by all""")
def a09_overlap_add(spark, sf_dir):
    """Windows of 16 frames every 8; each frame lies in two."""
    w = _frames(spark, sf_dir).withColumn("win", F.explode(F.array(F.floor(F.col("f") / 8), F.floor(F.col("f") / 8) - 1)))
    w = w.withColumns({"pos": F.col("f") - F.col("win") * 8, "len": F.lit(16)})
    return fr.overlap_add(w, ["u"], "f", "label", "v", "pos", "len").select("u", "f", "label", F.round("act", 6).alias("act"))


REQ = "rq as (select * from asr_requests where request_id is not null qualify row_number() over (partition by request_id order by ingested_at nulls last) = 1)"


def _samples(spark, sf_dir, expr, kind: T.DataType, f: Callable[[np.ndarray, int], object]):
    """One value per request, computed from its samples where they lie; only the values are reduced to the first delivery."""
    shape = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("ingested_at", T.TimestampNTZType()), T.StructField("value", kind)])

    def run(batches):
        for b in batches:
            lists, rates = b.column(2), b.column(3).to_pylist()
            out = [f(lists[i].values.to_numpy(zero_copy_only=False), r) if lists[i].is_valid and r and r > 0 else None for i, r in enumerate(rates)]
            arrow = {T.DoubleType(): pa.float64(), T.LongType(): pa.int64()}.get(kind, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=arrow)], names=["request_id", "ingested_at", "value"])

    t = table(spark, sf_dir, "asr_requests").select("request_id", "ingested_at", "samples", "sample_rate")
    return first_delivery(t.mapInArrow(run, shape), "request_id", "ingested_at", ["value"]).select("request_id", F.col("value").alias(expr))


@query("pred02_rms_gate", f"with {REQ}, s as (select request_id, list_transform(list_filter(samples, lambda x: not isnan(x)), lambda x: x::double * x::double) q from rq where len(samples) > 0) select request_id, sqrt(list_sum(q) / len(q)) >= 0.2e0 loud from s where len(q) > 0")
def pred02_rms_gate(spark, sf_dir):
    """Whether the root mean square of a request's samples, NaN apart, reaches a level; the array never leaves the JVM or its row."""
    x = F.transform(F.filter("samples", lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: v.cast("double") * v.cast("double"))
    t = table(spark, sf_dir, "asr_requests").select("request_id", "ingested_at", F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)) >= 0.2).alias("loud"))
    return first_delivery(t, "request_id", "ingested_at", ["loud"]).filter("loud is not null").drop("ingested_at")


@query("pred03_energy_vad")
def pred03_energy_vad(spark, sf_dir):
    """The share of a request's samples in loud frames."""
    return _samples(spark, sf_dir, "speech", T.DoubleType(), lambda x, r: float(fr.energy_vad(x, r, 300, 100, -12.0).mean()) if len(x) else None)


@query("pred01_speech_fraction")
def pred01_speech_fraction(spark, sf_dir):
    """Requests of which at least 0.4 is speech."""
    return pred03_energy_vad(spark, sf_dir).filter("speech >= 0.4").select("request_id")


@query("f27_resampled")
def f27_resampled(spark, sf_dir):
    """Length and mean of each request resampled to 80 samples a second, in each of the three forms of interpolation."""
    forms = ("ratio", "endpoints", "open")
    return _samples(spark, sf_dir, "means", T.ArrayType(T.DoubleType()), lambda x, r: [float(np.nanmean(fr.resample(x.astype(float), r, 80, k))) if len(x) and not np.isnan(x).all() else 0.0 for k in forms])


@query("f28_log_mel")
def f28_log_mel(spark, sf_dir):
    """Mean over time of the magnitude of each mel band, frames of a second."""
    return _samples(spark, sf_dir, "bands", T.ArrayType(T.DoubleType()), lambda x, r: np.abs(fr.log_mel(x, r, 8, 1000.0, 500.0)).mean(axis=0).tolist() if len(x) >= r else [])


@query("f37_pcm_scale", f"with {REQ} select request_id, case when list_max(list_transform(list_filter(samples, lambda x: not isnan(x)), lambda x: abs(x))) <= 1.5 then 'unit' else 'int16' end scale from rq where len(list_filter(samples, lambda x: not isnan(x))) > 0")
def f37_pcm_scale(spark, sf_dir):
    peak = F.array_max(F.transform(F.filter("samples", lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: F.abs(v)))
    t = table(spark, sf_dir, "asr_requests").select("request_id", "ingested_at", F.when(peak.isNotNull(), F.when(peak <= 1.5, "unit").otherwise("int16")).alias("scale"))
    return first_delivery(t, "request_id", "ingested_at", ["scale"]).filter("scale is not null").drop("ingested_at")


_WINDOWS = """with s as (select rec_id, round(duration_seconds * {rate})::bigint n from (select * from recordings where rec_id is not null qualify row_number() over (partition by rec_id order by ingested_at nulls last) = 1) where duration_seconds > 0 and isfinite(duration_seconds)),
r as (select rec_id, n, unnest(range(0, greatest(n - {size}, 0) + 1, {hop})) w from s) select rec_id, w start from r
union select rec_id, n - {size} from (select rec_id, n, max(w) w from r group by all) where n > {size} and w + {size} < n"""


def _durations(spark, sf_dir, rate):
    """Durations in a wrong unit are taken as they stand."""
    r = first_delivery(table(spark, sf_dir, "recordings").filter("rec_id is not null"), "rec_id", "ingested_at", ["duration_seconds"]).filter("duration_seconds > 0 and duration_seconds < double('infinity')")
    return r.select("rec_id", F.round(F.col("duration_seconds") * rate).cast("long").alias("n"))


@query("m11_windows", _WINDOWS.format(rate=10, size=160, hop=80))
def m11_windows(spark, sf_dir):
    """Windows of 16 s every 8 s, at 10 samples a second, the last flush with the end."""
    return fr.window_rows(_durations(spark, sf_dir, 10), "n", 160, 80, flush=True)


@query("m10_windows", _WINDOWS.format(rate=100, size=150, hop=75).split("union")[0])
def m10_windows(spark, sf_dir):
    """Windows of 1.5 s every 0.75 s, without the flush one."""
    return fr.window_rows(_durations(spark, sf_dir, 100), "n", 150, 75, flush=False)


@query("r26_weights", "select 0::int i, 0e0 w where false union all select i::int, 0.1e0 + 0.9e0 * (1 - abs(i - 7.5e0) / 8.5e0) from range(16) t(i)")
def r26_weights(spark, sf_dir):
    i = F.col("id").cast("int")
    return spark.range(16).select(i.alias("i"), (F.lit(0.1) + F.lit(0.9) * (F.lit(1.0) - F.abs(i - 7.5) / 8.5)).alias("w"))


@query("f21_powerset", """with z as (select vec_id, list_transform(embedding[1:11], lambda x: x::double) z from embeddings), e as (select vec_id, list_transform(z, lambda x: exp(x - list_max(z))) q from z),
p as (select vec_id, list_transform(q, lambda x: x / list_sum(q)) p from e) select vec_id, list_transform([p[2] + p[6] + p[7] + p[8], p[3] + p[6] + p[9] + p[10], p[4] + p[7] + p[9] + p[11], p[5] + p[8] + p[10] + p[11]], lambda x: round(x, 9)) activity from p""")
def f21_powerset(spark, sf_dir):
    """Activity of each of four speakers from the softmax of eleven classes, at most two speakers at once; classes from the embeddings."""
    from colloquy.functions import vectors as vx

    e = table(spark, sf_dir, "embeddings").select("vec_id", fr.marginals(vx.softmax(vx.doubles(F.slice("embedding", 1, 11))), 4, 2).alias("m"))
    return e.select("vec_id", F.transform("m", lambda x: F.round(x, 9)).alias("activity"))


@query("j05_speaker_by_overlap", f"""with {TL}, {SEG}, tr1 as (select transcript_id, rec_id from tr), s as (select transcript_id, rec_id, pos, st, en from segs join tr1 using (transcript_id) where isfinite(st) and isfinite(en) and en > st),
o as (select transcript_id, pos, any_value(s.en - s.st) dur, tl.sp, sum(least(s.en, tl.en) - greatest(s.st, tl.st)) ov from s join tl on tl.rec_id = s.rec_id and tl.st < s.en and s.st < tl.en group by transcript_id, pos, tl.sp),
r as (select *, row_number() over (partition by transcript_id, pos order by round(ov, 6) desc, sp) k, coalesce(lead(round(ov, 6)) over (partition by transcript_id, pos order by round(ov, 6) desc, sp), 0) nx from o)
select transcript_id, pos, sp speaker from r where k = 1 and round(ov / dur, 6) >= 0.5e0 and round((ov - nx) / dur, 6) >= 0.15e0""")
def j05_speaker_by_overlap(spark, sf_dir):
    """The speaker whose turns cover most of a segment, if at least half and 0.15 more than the next."""
    t = first_delivery(table(spark, sf_dir, "transcripts"), "transcript_id", "ingested_at", ["rec_id"]).select("transcript_id", "rec_id")
    s = segments(spark, sf_dir).join(t, "transcript_id").filter("end > start and not isnan(start) and not isnan(end)")
    return jn.speaker_by_overlap(s, timeline(spark, sf_dir), ["transcript_id", "pos"], 0.5, 0.15)


@query("j07_label_at", f"with {TL}, {WORDS}, {raster_sql('tl', 'r', '0.05e0', 0)} select w.rec_id, word_id, coalesce(r.sp, -1) speaker from w left join r on r.rec_id = w.rec_id and r.cell = trunc(st / 0.05e0)::bigint")
def j07_label_at(spark, sf_dir):
    return jn.label_at(words(spark, sf_dir), tl.raster_spans(timeline(spark, sf_dir), 0.05, at_least_one=False), 0.05)


@query("j06_nearest_label", f"""with {TL}, {WORDS}, {raster_sql('tl', 'r', '0.05e0', 0)}, c as (select rec_id, word_id, trunc(st / 0.05e0)::bigint cell from w), at_ as (select c.*, r.sp from c left join r using (rec_id, cell)),
near as (select c.rec_id, c.word_id, arg_min(r.sp, (abs(r.cell - c.cell), r.cell)) sp from at_ c join r on r.rec_id = c.rec_id and r.cell between c.cell - 20 and c.cell + 19 where c.sp is null group by all)
select a.rec_id, a.word_id, coalesce(a.sp, n.sp, -1) speaker from at_ a left join near n using (rec_id, word_id)""")
def j06_nearest_label(spark, sf_dir):
    """The label at a word's start or, in silence, that of the nearest labelled cell within a second, the first of equals."""
    return jn.nearest_label(words(spark, sf_dir), tl.raster_spans(timeline(spark, sf_dir), 0.05, at_least_one=False), 0.05, 20, 20)
