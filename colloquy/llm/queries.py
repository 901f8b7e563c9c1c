"""Queries of the llm operators, by name; SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.times import timed, to_ms
from colloquy.llm.leaks import leaked_items, leaked_windows
from colloquy.llm.nearest import BUCKET_MS, nearest_interval
from colloquy.llm.pieces import cut_bisecting, pieces
from colloquy.llm.runs import collapse, collapse_like
from colloquy.llm.spans import copy_classes, shared_intervals, shared_pairs
from colloquy.llm.tokens import encode_texts
from colloquy.llm.transcripts import speaker_turns
from colloquy.operators.delivery import first_delivery
from colloquy.plans.core_training import TURNS, turns


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_table(spark, sf_dir, "asr_requests"))  # by composed bisection


def p3_bisected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests in the pieces of plain bisection."""
    return pieces(_table(spark, sf_dir, "asr_requests"), cut_bisecting)


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In half milliseconds, so that the midpoint of whole milliseconds stays exact."""
    w = first_delivery(_table(spark, sf_dir, "word_timings"), "word_id", "ingested_at", ["rec_id", "start_sec", "end_sec"])
    w = w.withColumns({"s": to_ms(F.col("start_sec")), "e": to_ms(F.col("end_sec"))})
    w = w.select(F.col("rec_id").alias("ent"), (F.col("s") + F.when(F.col("e") >= F.col("s"), F.col("e")).otherwise(F.col("s"))).alias("t"), F.col("word_id").alias("point"))
    t = turns(spark, sf_dir).filter(timed(F.col("start_ms"), F.col("end_ms")))
    t = t.select(F.col("rec_id").alias("ent"), (F.col("start_ms") * 2).alias("s"), (F.col("end_ms") * 2).alias("e"), F.col("turn_id").alias("interval"))
    return nearest_interval(w, t, 2 * 750, 2 * BUCKET_MS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select(F.col("point").alias("word_id"), F.col("interval").alias("turn_id"))


def p4_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distance_ms: in milliseconds, with the half one that a midpoint may have."""
    return _nearest(spark, sf_dir).select(F.col("point").alias("word_id"), F.col("interval").alias("turn_id"), (F.col("distance") / 2).alias("distance_ms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_turns(spark, sf_dir).select("transcript_id", "first_pos", "last_pos", "speaker_id", "n_words")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(_table(spark, sf_dir, "transcripts"))


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, those of a single turn included."""
    runs = collapse(turns(spark, sf_dir), "rec_id", "speaker", "start_ms", "end_ms", "turn_id", 2000)
    return runs.select(
        F.col("ent").alias("rec_id"), F.col("label").cast("int").alias("speaker"), F.col("first_key").alias("first_turn_id"), F.col("n").cast("int").alias("n_turns"),
        "from_ms", (F.col("to_ms") - F.col("from_ms")).alias("duration_ms"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_runs(spark, sf_dir).filter("n_turns >= 3").select("rec_id", "first_turn_id", "n_turns")


def p7_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-identical words, four fifths alike in letters and digits, that follow each other within two seconds, as one with count and duration."""
    w = first_delivery(_table(spark, sf_dir, "word_timings"), "word_id", "ingested_at", ["rec_id", "word", "start_sec", "end_sec"])
    plain = F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}]", "")
    w = w.select("rec_id", "word_id", plain.alias("plain"), to_ms(F.col("start_sec")).alias("s"), to_ms(F.col("end_sec")).alias("e")).filter("plain <> ''")
    runs = collapse_like(w, "rec_id", "plain", "s", "e", "word_id", 2000).filter("n >= 2")
    return runs.select(F.col("ent").alias("rec_id"), F.col("first_key").alias("first_word_id"), "label", F.col("n").cast("int").alias("n_words"), (F.col("to_ms") - F.col("from_ms")).alias("duration_ms"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_windows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(_table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of exact copies: doc_id, class_id (the least id) and n_docs of each member. p10_found gives classes of more than 64 by class_id."""
    docs = _table(spark, sf_dir, "documents").filter("doc_id is not null and length(text) >= 250")
    return copy_classes(docs.select("doc_id", "text")).select("doc_id", F.col("rep").alias("class_id"), F.col("n").alias("n_docs"))


def p10_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of each article that stand verbatim in another one."""
    return shared_intervals(_table(spark, sf_dir, "documents"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each article that shares anything is shared."""
    docs = _table(spark, sf_dir, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    each = shared_intervals(_table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum(F.col("to_char") - F.col("from_char")).alias("shared_chars"), F.count("*").alias("n_intervals"))
    return each.join(docs, "doc_id").select("doc_id", "n_chars", "shared_chars", "n_intervals", (F.col("shared_chars") / F.col("n_chars")).alias("share"))


_NEAREST = f"""with {TURNS},
words1 as (select word_id, rec_id, try_cast(round_even(start_sec * 1000, 0) as bigint) ws, try_cast(round_even(end_sec * 1000, 0) as bigint) we from word_timings
  qualify row_number() over (partition by word_id order by ingested_at nulls last) = 1),
mids as (select word_id, rec_id, case when we >= ws then (ws + we) / 2 else ws end t from words1 where ws is not null),
near as (select word_id, turn_id, s, greatest(s - t, t - e, 0) d from mids join timed using (rec_id) where s - 750 <= t and t <= e + 750),
best as (select * from near qualify row_number() over (partition by word_id order by d, s desc, turn_id) = 1)"""

_RUNS = f"""with {TURNS.split("timed as")[0]}
t as (select *, try_cast(round_even(start_sec * 1000, 0) as bigint) s, try_cast(round_even(end_sec * 1000, 0) as bigint) e from turns1),
marked as (select *, coalesce(speaker = lag(speaker) over w and s - lag(s) over w <= 2000, false) joins from t
  where s is not null and speaker is not null and rec_id is not null window w as (partition by rec_id order by s, turn_id)),
numbered as (select *, sum((not joins)::int) over (partition by rec_id order by s, turn_id rows unbounded preceding) run from marked),
runs as (select rec_id, any_value(speaker) speaker, arg_min(turn_id, (s, turn_id)) first_turn_id, count(*)::int n_turns, min(s) from_ms, max(greatest(s, coalesce(e, s))) - min(s) duration_ms from numbered group by rec_id, run)"""

_WORD_RUNS = """with recursive one as (select *, regexp_replace(lower(word), '[^\\p{L}\\p{N}]', '', 'g') w, try_cast(round_even(start_sec * 1000, 0) as bigint) s, try_cast(round_even(end_sec * 1000, 0) as bigint) e
  from word_timings qualify row_number() over (partition by word_id order by ingested_at nulls last) = 1),
o as (select rec_id, word_id, w, s, greatest(s, coalesce(e, s)) e, row_number() over (partition by rec_id order by s, word_id) rn from one where rec_id is not null and word_id is not null and s is not null and w <> ''),
r as (select rec_id, rn, w anchor, s, e, word_id first_word_id from o where rn = 1
union all select o.rec_id, o.rn, case when t.joins then r.anchor else o.w end, o.s, o.e, case when t.joins then r.first_word_id else o.word_id end from r join o on o.rec_id = r.rec_id and o.rn = r.rn + 1,
  lateral (select o.s - r.s <= 2000 and 1 - levenshtein(o.w, r.anchor) / greatest(len(o.w), len(r.anchor)) >= 0.8 joins) t)
select rec_id, first_word_id, any_value(anchor) label, count(*)::int n_words, max(e) - min(s) duration_ms from r group by rec_id, first_word_id having count(*) >= 2"""

_PIECES = """with recursive rq as (select * from asr_requests qualify row_number() over (partition by request_id order by ingested_at nulls last) = 1),
r as (select request_id, samples, len(samples) n, case when sample_rate > 0 then sample_rate when isfinite(duration_seconds) and duration_seconds > 0 then round_even(len(samples) / duration_seconds, 0)::bigint end rate from rq where samples is not null),
o as (select * from r where rate > 0 and n > 20 * rate),
x as (select request_id, rate, generate_subscripts(samples, 1) - 1 i, unnest(samples) v from o),
q as (select request_id, rate, i, i - row_number() over (partition by request_id order by i) g from x where abs(v) <= 0.02::float),
m as (select request_id, (min(i) + max(i) + 1) // 2 mid from q group by request_id, rate, g having count(*) * 5 >= any_value(rate)),
c as (select request_id, 0 piece_no, 0::bigint st, n, rate from o
union all select c.request_id, c.piece_no + 1, coalesce(max(m.mid), c.st + 20 * c.rate) - c.rate // 2, c.n, c.rate from c left join m on m.request_id = c.request_id and m.mid > c.st + 5 * c.rate and m.mid <= c.st + 20 * c.rate
  where c.n - c.st > 20 * c.rate group by c.request_id, c.piece_no, c.st, c.n, c.rate)
select request_id, piece_no, st from_sample, coalesce(lead(st) over (partition by request_id order by piece_no) + rate // 2, n)::bigint to_sample from c"""

_HALVES = _PIECES.split("c as (")[0] + """ms as (select request_id, (min(i) + max(i) + 1) // 2 mid, count(*) size from q group by request_id, rate, g having count(*) * 5 >= any_value(rate)),
nodes as (select request_id, rate, 0::bigint a, n b, 20 * rate - rate // 2 most from o
union all select request_id, rate, case when k = 0 then a else cut end, case when k = 0 then cut else b end, most from (
  select x.request_id, x.rate, a, b, most, coalesce(arg_min(mid, (-size, abs(mid - (a + b) // 2), mid)), (a + b) // 2) cut from nodes x
  left join ms on ms.request_id = x.request_id and mid > (a + b) // 2 - (b - a) // 4 and mid < (a + b) // 2 + (b - a) // 4 where b - a > most group by x.request_id, x.rate, a, b, most) t, (values (0), (1)) h(k))
select request_id, (row_number() over (partition by request_id order by a) - 1)::int piece_no, case when a = 0 then 0 else greatest(0, a - rate // 2) end from_sample, b to_sample from nodes where b - a <= most"""

_WORDS = "string_split(trim(regexp_replace(regexp_replace(lower(text), '\\\\(?:[a-z]+|(?s:.))', ' ', 'g'), '[^\\p{L}\\p{Nd}]+', ' ', 'g')), ' ')"
_WINDOWS = "select {0}, array_to_string(w[i : i + 11], ' ') g from (select {0}, w, unnest(range(1, len(w) - 10)) i from {1})"

_LEAKS = f"""with d as (select doc_id, {_WORDS} w from documents where text is not null and doc_id is not null), e as (select item_id, {_WORDS} w from eval_items where text is not null and item_id is not null),
dw as ({_WINDOWS.format("doc_id", "d")}), ew as ({_WINDOWS.format("item_id", "e")}) select distinct doc_id, item_id from dw join ew using (g)"""

_SPANS = """with w as (select doc_id, text, unnest(range(1, len(text) - 248)) i from documents where len(text) >= 250 and doc_id is not null),
h as (select distinct doc_id, md5(substring(text, i, 250)) h from w), k as (select h from h group by h having count(*) > 1)
select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from h a join k using (h) join h b using (h) where a.doc_id < b.doc_id"""

_COVERED = _SPANS.split("k as (")[0].replace("select distinct doc_id, md5(substring(text, i, 250)) h from w", "select doc_id, i, md5(substring(text, i, 250)) h from w") + """k as (select h from h group by h having count(distinct doc_id) > 1),
c as (select distinct doc_id, i from h join k using (h)),
f as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 250, true)::int fresh from c),
g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) k from f),
stretches as (select doc_id, min(i) - 1 from_char, max(i) + 249 to_char from g group by doc_id, k)"""

SQL: dict[str, str] = {
    "p10_intervals": _COVERED + " select * from stretches",
    "p10_shared": _COVERED + """ select doc_id, len(text) n_chars, sum(to_char - from_char)::bigint shared_chars, count(*) n_intervals, sum(to_char - from_char) / len(text) share
from stretches join documents using (doc_id) group by doc_id, text""",
    "p10_classes": """select doc_id, min(doc_id) over (partition by text) class_id, count(*) over (partition by text) n_docs from documents where doc_id is not null and len(text) >= 250
qualify count(*) over (partition by text) > 1""",
    "p9_found": _LEAKS,
    "p10_found": _SPANS,
    "p3_found": _PIECES,
    "p3_bisected": _HALVES,
    "p4_found": _NEAREST + " select word_id, turn_id from best",
    "p4_distances": _NEAREST + " select word_id, turn_id, d distance_ms from best",
    "p7_words": _WORD_RUNS,
    "p7_runs": _RUNS + " select * from runs",
    "p7_found": _RUNS + " select rec_id, first_turn_id, n_turns from runs where n_turns >= 3",
}

QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_bisected, p4_found, p4_distances, p6_found, p6_turns, p7_found, p7_runs, p7_words, p8_ids, p9_found, p9_leaks, p10_found, p10_classes, p10_intervals, p10_shared)
}
