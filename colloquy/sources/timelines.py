"""Timelines as lines of text, and transcript documents as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.timelines import merge_same_speaker, stretches

RTTM = "SPEAKER %s 1 %.3f %.3f <NA> <NA> SPEAKER_%02d <NA> <NA>"
# The names of a transcript document's fields and their types.
DOCUMENT = """schema string, provenance struct<app:string,app_version:string,engine:string,model:string,language:string,created_at:string>,
media struct<duration_seconds:double,sample_rate:int,channels:int,content_hash:string>, speakers array<struct<id:string,display_name:string>>,
segments array<struct<id:string,start:double,`end`:double,text:string,speaker:string,confidence:double,language:string>>"""


def rttm_lines(t: DataFrame) -> DataFrame:
    """rec_id, idx, line of each turn."""
    return t.select("rec_id", "idx", F.format_string(RTTM, "rec_id", "start", F.col("end") - F.col("start"), "speaker").alias("line"))


def parse_rttm(lines: DataFrame, line: str = "line", idx: str | None = None) -> DataFrame:
    """rec_id, idx, start, end, name of each line that begins with SPEAKER, has at least eight fields and numbers for its times. idx: the lines' order, as they
    are read unless given."""
    f = F.split(F.trim(line), r"\s+")
    start, dur = (F.try_element_at(f, F.lit(k)).try_cast("double") for k in (4, 5))
    rows = lines.filter(F.col(line).startswith("SPEAKER") & (F.size(f) >= 8)).select(F.element_at(f, 2).alias("rec_id"), (F.col(idx) if idx else F.monotonically_increasing_id()).alias("idx"), start.alias("start"), (start + dur).alias("end"), F.element_at(f, 8).alias("name"))
    return rows.filter("start is not null and end is not null")


def read_rttm(lines: DataFrame, line: str = "line", idx: str | None = None, gap: float = 0.01) -> DataFrame:
    """rec_id, idx, start, end, speaker of the turns of RTTM lines: speakers numbered by the order of their names, consecutive turns of one speaker joined where
    no more than ``gap`` seconds lie between them."""
    t = numbered(parse_rttm(lines, line, idx))
    return merge_same_speaker(stretches(t, gap), gap).drop("island")


def numbered(rows: DataFrame) -> DataFrame:
    """Speaker names as numbers from 0, by their order."""
    names = rows.select("rec_id", "name").distinct().withColumn("speaker", F.dense_rank().over(Window.partitionBy("rec_id").orderBy("name")) - 1)
    return rows.join(names, ["rec_id", "name"]).drop("name")


def clock(seconds: Column, half_even: bool = False) -> Column:
    """MM:SS, or HH:MM:SS from an hour on, rounded half up or half to even."""
    s = (F.rint(seconds) if half_even else F.floor(seconds + 0.5)).cast("long")
    h, m, x = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, x)).otherwise(F.format_string("%02d:%02d", m, x))


def speaker_line(speaker: Column, seconds: Column, half_even: bool = False) -> Column:
    return F.concat(F.lit("Speaker"), (speaker + 1).cast("string"), F.lit("    "), clock(seconds, half_even))


def parse_marks(text: Column) -> Column:
    """Speaker (from 0) and second of every mark ``<word> N HH:MM:SS`` in a text, whatever white space or width of digits separates them."""
    narrow = F.translate(F.regexp_replace(text, r"(?U)\s", " "), "０１２３４５６７８９：", "0123456789:")
    marks = F.regexp_extract_all(narrow, F.lit(r"((?:发言人|[Ss]peaker|说话人) *\d+ +\d{1,2}:\d{2}:\d{2})"), F.lit(1))
    part = lambda m, k: F.regexp_extract(m, r"(\d+) +(\d{1,2}):(\d{2}):(\d{2})", k).cast("int")
    return F.transform(marks, lambda m: F.struct((part(m, 2) * 3600 + part(m, 3) * 60 + part(m, 4)).alias("second"), (part(m, 1) - 1).alias("speaker")))


def timeline_json(t: DataFrame) -> DataFrame:
    """rec_id, document: each recording's timeline and talk time as one JSON text."""
    talk = t.groupBy("rec_id", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("sec")).groupBy("rec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("SPEAKER_%d", "speaker"), "sec")))).alias("talk_sec"))
    row = F.struct("start", "end", "idx", "speaker")
    whole = t.groupBy("rec_id").agg(F.array_sort(F.collect_list(row)).alias("timeline")).join(talk, "rec_id")
    turns = F.transform("timeline", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["speaker"].alias("speaker")))
    return whole.select("rec_id", F.to_json(F.struct(F.size("timeline").alias("n_turns"), "talk_sec", turns.alias("timeline"))).alias("document"))


def parse_timeline_json(df: DataFrame, column: str = "document") -> DataFrame:
    parsed = F.from_json(column, "timeline array<struct<start:double,`end`:double,speaker:int>>")
    return df.select("rec_id", F.inline(parsed["timeline"]))


def read_documents(df: DataFrame, payload: str, tag: str) -> DataFrame:
    """tag: the discriminator, as a pattern of the whole value of ``schema`` that names the version. The rows with ``doc`` (the typed fields), ``raw`` (everything, as a variant) and ``reject`` (why a text is no document, else null)."""
    raw = F.try_parse_json(payload)
    doc = F.from_json(payload, DOCUMENT)
    own = F.get_json_object(payload, "$.schema")
    why = F.when(raw.isNull(), "not json").when(own.isNull(), "no schema").when(~own.rlike(f"^(?:{tag})$"), "other schema").when(F.get_json_object(payload, "$.segments").isNull(), "no segments")
    return df.withColumns({"raw": raw, "doc": F.when(why.isNull(), doc), "reject": why})


def write_documents(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Documents as JSON from their variant, unknown fields included, absent ones left out; keys may come in another order."""
    return df.withColumn("payload", F.to_json(raw))
