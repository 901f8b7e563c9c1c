"""Queries over streams: the table of events read as files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy.operators.scan import cut_folder
from colloquy.plans.registry import query, table
from colloquy.streaming import sessions as ss


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark):
    return f"{cut_folder(spark)}/{uuid.uuid4().hex}"


@query("t09_stream_report", "select event_type, count(*) n, sum(round(value * 1000)::bigint) total, max(value) top from events group by all")
def t09_stream_report(spark, sf_dir):
    """The running report of a stream after all that is available, equal to the report of the table."""
    return ss.drain(ss.report(_stream(spark, sf_dir), "event_type", "value"), _folder(spark), "complete")


SESS = """e as (select user_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) > 3600000000)::int, 1) fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from e)"""


@query("t02_sessions", f"with {SESS} select user_id track, min(ts) from_ts, max(ts) + interval 1 hour to_ts, count(*) n from s group by user_id, k")
def t02_sessions(spark, sf_dir):
    return ss.sessions(table(spark, sf_dir, "events").withColumnRenamed("user_id", "track"), "1 hour")


# An utterance ends before a row that comes more than four hours after its last one, or two once anything was spoken, or more than twelve after its first.
_UTTERANCES = """with recursive o as (select user_id::varchar track, epoch_us(ts) // 1000 t, value >= 30 sp, row_number() over (partition by user_id order by epoch_us(ts) // 1000, value >= 30) rn from events where user_id is not null and ts is not null),
r as (select track, rn, t f, t l, 1::bigint n, sp, null::bigint cf, null::bigint cl, null::bigint cn, null::varchar reason from o where rn = 1
union all select track, rn, case when why is null then f else t end, t, case when why is null then n + 1 else 1 end, case when why is null then sp or own else own end, f, l, n, why from (
  select o.track, o.rn, r.f, r.l, r.n, r.sp, o.t, o.sp own, case when o.t - r.l > case when r.sp then 7200000 else 14400000 end then 'silence' when o.t - r.f > 43200000 then 'length' end why
  from r join o on o.track = r.track and o.rn = r.rn + 1))
select track, cf from_ms, cl to_ms, cn n, reason from r where reason is not null
union all select track, f, l, n, 'finished' from r qualify row_number() over (partition by track order by rn desc) = 1"""
_RULES = (4 * 3_600_000, 2 * 3_600_000), 12 * 3_600_000


def _tracks(e):
    return e.filter("user_id is not null and ts is not null").select(F.col("user_id").alias("track"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") >= 30).alias("spoken"))


@query("t01_utterances", _UTTERANCES)
def t01_utterances(spark, sf_dir):
    """Utterances by silence, without and with words, and greatest length, from the table."""
    return ss.utterances_of(_tracks(table(spark, sf_dir, "events")), *_RULES, spoken="spoken")


@query("t03_stream_utterances", _UTTERANCES)
def t03_stream_utterances(spark, sf_dir):
    """The same from a stream, in which the last row of a track says that it is finished."""
    folder = _folder(spark)
    last = _tracks(table(spark, sf_dir, "events")).groupBy("track").agg(F.max("ts").alias("ts"))
    last.select("track", "ts", F.lit(False).alias("spoken"), F.lit(True).alias("finished")).write.parquet(f"{folder}/finished")
    marks = spark.readStream.schema("track long, ts timestamp, spoken boolean, finished boolean").parquet(f"{folder}/finished")
    e = _tracks(_stream(spark, sf_dir)).withColumn("finished", F.lit(False)).unionByName(marks)
    return ss.drain(ss.utterances(e, *_RULES, spoken="spoken", finished="finished"), folder)
