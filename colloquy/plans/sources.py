"""Queries over readers and writers; each writer is read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.operators.delivery import first_delivery
from colloquy.plans.registry import query, table
from colloquy.plans.timelines import TL, merged_sql, timeline
from colloquy.sources import timelines as st
from colloquy.sources import wav


@query("s10_rttm", f"with {TL} select rec_id, idx, printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> SPEAKER_%02d <NA> <NA>', rec_id, st, en - st, sp) line from tl")
def s10_rttm(spark, sf_dir):
    return st.rttm_lines(timeline(spark, sf_dir))


# the end of a line is its start and its duration, as written with three decimals, added
_LINES = "named as (select rec_id, idx, st, st + round_even((en - st) * 1000, 0) / 1000e0 en, (dense_rank() over (partition by rec_id order by printf('SPEAKER_%02d', sp)) - 1)::int sp from tl)"


@query("s09_rttm_read", f"with {TL}, {_LINES}, {merged_sql('named', 0.01, 'm')} select rec_id, sp speaker, count(*) n, round(sum(en - st), 3) total from m group by all")
def s09_rttm_read(spark, sf_dir):
    """RTTM lines, with some that are none among them, read back: turns, joined over gaps of a hundredth of a second, and talk time of each numbered speaker."""
    lines = st.rttm_lines(timeline(spark, sf_dir)).select("idx", F.explode(F.array(F.col("line"), F.concat(F.lit(";; "), "line"))).alias("line"))
    return st.read_rttm(lines, idx="idx").groupBy("rec_id", "speaker").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("total"))


_CLOCK = "case when {0} >= 3600 then printf('%02d:%02d:%02d', {0} // 3600, {0} // 60 % 60, {0} % 60) else printf('%02d:%02d', {0} // 60, {0} % 60) end"


@query("s12_absolute", f"with {TL}, k as (select *, floor(st + 0.5e0)::bigint u, round_even(st, 0)::bigint v from tl) select rec_id, idx, 'Speaker' || (sp + 1) || '    ' || {_CLOCK.format('u')} half_up, 'Speaker' || (sp + 1) || '    ' || {_CLOCK.format('v')} half_even from k")
def s12_absolute(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return t.select("rec_id", "idx", st.speaker_line(F.col("speaker"), F.col("start")).alias("half_up"), st.speaker_line(F.col("speaker"), F.col("start"), True).alias("half_even"))


@query("s13_durations", f"with {TL}, k as (select *, floor((en - st) + 0.5e0)::bigint u from tl) select rec_id, idx, 'Speaker' || (sp + 1) || '    ' || {_CLOCK.format('u')} line from k")
def s13_durations(spark, sf_dir):
    return timeline(spark, sf_dir).select("rec_id", "idx", st.speaker_line(F.col("speaker"), F.col("end") - F.col("start")).alias("line"))


# a mark's hours have at most two digits
@query("s11_marks", f"with {TL}, k as (select *, floor(st)::bigint s from tl where st < 360000) select rec_id, idx, s second_of, sp speaker from k")
def s11_marks(spark, sf_dir):
    """Marks of a transcript in markdown, with no-break spaces between their parts, read back."""
    t = timeline(spark, sf_dir).withColumn("s", F.floor("start"))
    nb = F.lit(" ")
    line = F.concat(F.lit("## 发言人"), nb, (F.col("speaker") + 1).cast("string"), nb, F.format_string("%02d:%02d:%02d", F.floor(F.col("s") / 3600), F.floor(F.col("s") / 60) % 60, F.col("s") % 60), F.lit("\ntext"))
    m = t.select("rec_id", "idx", F.inline(st.parse_marks(line)))
    return m.select("rec_id", "idx", F.col("second").cast("long").alias("second_of"), "speaker")


@query("s08_timeline_json", f'with {TL} select rec_id, count(*) n, round(sum(en - st), 3) total, min(st) "first" from tl group by all')
def s08_timeline_json(spark, sf_dir):
    """Timelines written as JSON documents and read back."""
    t = st.parse_timeline_json(st.timeline_json(timeline(spark, sf_dir)))
    return t.groupBy("rec_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("total"), F.min("start").alias("first"))


RAW = "raw as (select * from raw_transcripts qualify row_number() over (partition by line_id order by delivered_at nulls last) = 1)"


VERSION = r"[a-z]+-transcript\.v1"  # whoever names it, the first version


def _raw(spark, sf_dir):
    return first_delivery(table(spark, sf_dir, "raw_transcripts"), "line_id", "delivered_at", ["payload"])


@query("s05_documents", f"""with {RAW} select line_id, case when not json_valid(payload) then 'not json' when json_extract_string(payload, '$.schema') is null then 'no schema' when not regexp_matches(json_extract_string(payload, '$.schema'), '^[a-z]+-transcript[.]v1$') then 'other schema'
when json_extract(payload, '$.segments') is null or json_extract_string(payload, '$.segments') is null then 'no segments' end reject from raw""")
def s05_documents(spark, sf_dir):
    """Which payloads are transcript documents, and why the others are not."""
    return st.read_documents(_raw(spark, sf_dir), "payload", VERSION).select("line_id", "reject")


@query("s06_written", f"""with {RAW} select line_id, true same, len(json_keys(payload))::int n_fields from raw where json_valid(payload) and regexp_matches(json_extract_string(payload, '$.schema'), '^[a-z]+-transcript[.]v1$') and json_extract_string(payload, '$.segments') is not null""")
def s06_written(spark, sf_dir):
    """Documents read and written again: whether text and variant agree, with their number of top-level fields."""
    d = st.write_documents(st.read_documents(_raw(spark, sf_dir), "payload", VERSION).filter("reject is null"))
    again = F.to_json(F.try_parse_json("payload"))
    return d.select("line_id", (again == F.to_json("raw")).alias("same"), F.size(F.json_object_keys("payload")).alias("n_fields"))


@query("c02_unknown_fields", f"""with {RAW}, k as (select line_id, unnest(json_keys(payload)) field from raw where json_valid(payload) and json_type(payload) = 'OBJECT') select * from k where field not in ('schema', 'provenance', 'media', 'speakers', 'segments')""")
def c02_unknown_fields(spark, sf_dir):
    """Top-level fields of the documents that the typed schema does not know."""
    known = ["schema", "provenance", "media", "speakers", "segments"]
    keys = _raw(spark, sf_dir).select("line_id", F.explode(F.json_object_keys("payload")).alias("field"))
    return keys.filter(~F.col("field").isin(known))


@query("c07_segments_of_turns", f"""with {TL} select rec_id, count(*) n, min(idx) "first" from tl group by all""")
def c07_segments_of_turns(spark, sf_dir):
    """Turns as segments that know only their speaker, in time order, as one array for each recording."""
    s = timeline(spark, sf_dir).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "idx", "speaker"))).alias("t"))
    seg = F.transform("t", lambda x, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("id"), x["start"].alias("start"), x["end"].alias("end"), F.lit("").alias("text"), x["idx"].alias("idx")))
    return s.select("rec_id", seg.alias("s")).select("rec_id", F.size("s").cast("long").alias("n"), F.array_min(F.transform("s", lambda x: x["idx"])).alias("first"))


@query("s04_wav_written", "with rq as (select * from asr_requests where request_id is not null qualify row_number() over (partition by request_id order by ingested_at nulls last) = 1) select request_id, 44 + 2 * len(samples) n_bytes, len(samples) n_back, case when sample_rate > 0 then sample_rate else 16000 end rate from rq where samples is not null")
def s04_wav_written(spark, sf_dir):
    """Samples written as WAV bytes and decoded again."""

    def run(batches):
        for b in batches:
            out = []
            for i, r in enumerate(b.column(3).to_pylist()):
                if not b.column(2)[i].is_valid:
                    out.append([])
                    continue
                data = wav.encode(b.column(2)[i].values.to_numpy(zero_copy_only=False), r if r and r > 0 else 16000)
                x, rate = wav.decode(data)
                out.append([len(data), len(x), rate])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.list_(pa.int64()))], names=["request_id", "ingested_at", "v"])

    t = table(spark, sf_dir, "asr_requests").select("request_id", "ingested_at", "samples", "sample_rate").mapInArrow(run, "request_id long, ingested_at timestamp_ntz, v array<long>")
    t = first_delivery(t, "request_id", "ingested_at", ["v"]).filter(F.size("v") > 0)
    at = lambda k: F.element_at("v", k)
    return t.select("request_id", at(1).alias("n_bytes"), at(2).alias("n_back"), at(3).cast("int").alias("rate"))


@query("f39_prepared", """with rq as (select * from asr_requests where request_id is not null qualify row_number() over (partition by request_id order by ingested_at nulls last) = 1)
select request_id, case when len(samples) = 0 then 0 when sample_rate = 16000 then len(samples) else greatest(1, round_even(len(samples) * 16000 / sample_rate, 0)) end::bigint n from rq where samples is not null and sample_rate > 0""")
def f39_prepared(spark, sf_dir):
    """Audio as an engine takes it: WAV bytes decoded, mixed to one channel and brought to 16,000 samples a second; here how many samples that gives."""

    def run(batches):
        for b in batches:
            out = []
            for i, r in enumerate(b.column(3).to_pylist()):
                x = b.column(2)[i]
                out.append(len(wav.prepare(wav.encode(x.values.to_numpy(zero_copy_only=False), r), 16_000)) if x.is_valid and r and r > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.int64())], names=["request_id", "ingested_at", "n"])

    t = table(spark, sf_dir, "asr_requests").filter("request_id is not null").select("request_id", "ingested_at", "samples", "sample_rate").mapInArrow(run, "request_id long, ingested_at timestamp_ntz, n long")
    return first_delivery(t, "request_id", "ingested_at", ["n"]).filter("n is not null").select("request_id", "n")


@query("f41_sha256", "select doc_id, sha256(text) digest from documents")
def f41_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
