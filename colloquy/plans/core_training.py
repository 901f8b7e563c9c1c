"""Queries p1, p2 and p5 over the tables of turns, references and raw transcript files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.times import timed, to_ms
from colloquy.operators import drift
from colloquy.operators.delivery import first_delivery
from colloquy.operators.intervals import periods_and_gaps
from colloquy.operators.references import dangling_positions, orphan_keys, orphan_references
from colloquy.functions.labels import NUMBERED
from colloquy.plans.registry import query, table
from colloquy.plans.texts import SEG

TURNS = """turns1 as (select * from turns qualify row_number() over (partition by turn_id order by ingested_at nulls last) = 1),
timed as (select rec_id, speaker, turn_id, s, e from (select *, try_cast(round_even(start_sec * 1000, 0) as bigint) s,
  try_cast(round_even(end_sec * 1000, 0) as bigint) e from turns1) where e > s)"""

P1 = f"""with {TURNS},
marked as (select *, coalesce(max(e) over (partition by rec_id, speaker order by s, e rows between unbounded preceding and 1 preceding) < s, true) fresh
  from timed where speaker is not null and rec_id is not null),
grouped as (select *, sum(fresh::int) over (partition by rec_id, speaker order by s, e rows unbounded preceding) k from marked),
periods as (select rec_id, speaker, k, min(s) f, max(e) t, count(*) n from grouped group by all),
gaps as (select rec_id, speaker, t f, lead(f) over (partition by rec_id, speaker order by k) t from periods)
select rec_id, speaker, 'period' kind, f from_ms, t to_ms from periods where n >= 2
union all select rec_id, speaker, 'gap', f, t from gaps where t - f <= 10000"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns, each once, with start_ms and end_ms."""
    t = first_delivery(table(spark, sf_dir, "turns"), "turn_id", "ingested_at", ["rec_id", "speaker", "start_sec", "end_sec"])
    return t.withColumns({"start_ms": to_ms(F.col("start_sec")), "end_ms": to_ms(F.col("end_sec"))})


@query("p1_found", P1)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).filter(timed(F.col("start_ms"), F.col("end_ms")) & F.col("speaker").isNotNull() & F.col("rec_id").isNotNull())
    found = periods_and_gaps(t, ["rec_id", "speaker"], "start_ms", "end_ms")
    case = (F.col("kind") == "period") & (F.col("n") >= 2) | (F.col("kind") == "gap") & (F.col("to_ms") - F.col("from_ms") <= 10_000)
    return found.filter(case).select("rec_id", "speaker", "kind", "from_ms", "to_ms")


@query("p1_timeline", P1.split("select rec_id, speaker, 'period' kind")[0] + "select rec_id, speaker, 'period' kind, f from_ms, t to_ms, n from periods union all select rec_id, speaker, 'gap', f, t, null from gaps where t is not null")
def p1_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period and every gap, whatever their size."""
    t = turns(spark, sf_dir).filter(timed(F.col("start_ms"), F.col("end_ms")) & F.col("speaker").isNotNull() & F.col("rec_id").isNotNull())
    return periods_and_gaps(t, ["rec_id", "speaker"], "start_ms", "end_ms")


REFERRING = {"turns": "turn_id", "word_timings": "word_id", "transcripts": "transcript_id", "asr_requests": "request_id"}
_ROWS = ",\n".join(f"{t}1 as (select '{t}' ref_table, {i} ref_id, rec_id, ingested_at arrived_at from {t} qualify row_number() over (partition by {i} order by ingested_at nulls last) = 1)" for t, i in REFERRING.items())
_REFS = f"""with {_ROWS},
refs as ({" union all ".join(f"select * from {t}1" for t in REFERRING)}),
recs as (select rec_id, ingested_at came, deleted_at from recordings where rec_id is not null qualify row_number() over (partition by rec_id order by ingested_at nulls last) = 1),
judged as (select refs.*, case when recs.rec_id is null then 'missing' when deleted_at < arrived_at then 'deleted' when came > arrived_at then 'late' end kind
  from refs left join recs using (rec_id) where refs.rec_id is not null)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = first_delivery(table(spark, sf_dir, "recordings").filter("rec_id is not null"), "rec_id", "ingested_at", ["deleted_at"])
    return r.select(F.col("rec_id").alias("key"), F.col("ingested_at").alias("arrived"), F.col("deleted_at").alias("deleted"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = []
    for name, own in REFERRING.items():
        d = first_delivery(table(spark, sf_dir, name).select(own, "rec_id", "ingested_at"), own, "ingested_at", ["rec_id"])
        each.append(d.select(F.col("rec_id").alias("key"), F.col("ingested_at").alias("arrived"), F.lit(name).alias("ref_table"), F.col(own).alias("ref_id")))
    return reduce(DataFrame.unionByName, each)


def _plain(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _number(c: str) -> str:
    form = f"trim(lower({c})), '^([a-z]*)[^a-z0-9]*0*([0-9]+)$'"
    return f"case when regexp_extract({form}, 1) in ({', '.join(repr(x) for x in sorted(NUMBERED))}) then try_cast(nullif(regexp_extract({form}, 2), '') as bigint) end"


_SPEAKERS = f"""{SEG}, en as (select transcript_id, unnest(speakers) e from tr), nm as (select transcript_id, e.id own, list_filter(string_split_regex(coalesce(e.display_name, ''), '[\\s,]+'), lambda w: {_plain('w')} <> '') ws, e.display_name dn from en),
known as (select transcript_id, {_plain('own')} a, {_plain('dn')} b, case when len(ws) > 0 then {_plain('ws[-1]')} || {_plain("array_to_string(ws[:-2], '')")} end c, case when len(ws) > 0 then {_plain('ws[1]')} end d, {_number('own')} k from nm),
said as (select transcript_id, pos, {_plain('sp')} l, {_number('sp')} k from segs where trim(sp) <> ''),
loose as (select transcript_id, pos from said s where not exists (select 1 from known e where e.transcript_id = s.transcript_id and ((s.l <> '' and s.l in (e.a, e.b, e.c, e.d)) or s.k = e.k)))"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(dangling_positions(table(spark, sf_dir, "transcripts"), "transcript_id", "ingested_at"), "transcript_id", "ingested_at", ["places"])


@query("p2_found", f"""{_REFS}, {_SPEAKERS} select ref_table, ref_id, -1 ref_pos, kind from judged where kind is not null
union all select 'segments', transcript_id, pos, 'missing' from loose""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orphan_references(_records(spark, sf_dir), _references(spark, sf_dir))
    rows = rows.select("ref_table", "ref_id", F.lit(-1).alias("ref_pos"), "kind")
    inner = _places(spark, sf_dir).select(F.lit("segments").alias("ref_table"), F.col("transcript_id").alias("ref_id"), F.explode("places").alias("ref_pos"), F.lit("missing").alias("kind"))
    return rows.unionByName(inner)


@query("p2_orphan_report", f"""{_REFS}, {_SPEAKERS}, every as (select ref_table, kind, arrived_at from judged where kind is not null
  union all select 'segments', 'missing', ingested_at from loose join tr using (transcript_id))
select ref_table, kind, strftime(arrived_at, '%Y-%m') period, count(*) n from every group by all""")
def p2_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of p2_found, those of segments to speakers included, per table and month of arrival."""
    rows = orphan_references(_records(spark, sf_dir), _references(spark, sf_dir)).select("ref_table", "kind", "arrived")
    inner = _places(spark, sf_dir).select(F.lit("segments").alias("ref_table"), F.lit("missing").alias("kind"), F.col("ingested_at").alias("arrived"), F.explode("places").alias("place"))
    rows = rows.unionByName(inner.drop("place"))
    return rows.groupBy("ref_table", "kind", F.date_format("arrived", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))


@query("p2_orphan_keys", _REFS + """, now as (select refs.rec_id key, count(*) referring, coalesce(any_value(case when r.rec_id is null then 0 when r.deleted_at is null then 1 else 0 end), 0) existing
from refs left join recs r on r.rec_id = refs.rec_id where refs.rec_id is not null group by all) select key, existing, referring from now where existing <= 0""")
def p2_orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current orphans: keys with references and no existence after all changes."""
    return orphan_keys(_records(spark, sf_dir), _references(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "raw_transcripts"), "line_id", "delivered_at", ["feed_id", "file_no", "payload"])


_DRIFT = """with ln as (select * from raw_transcripts qualify row_number() over (partition by line_id order by delivered_at nulls last) = 1),
good as (select feed_id, file_no, payload::json p from ln where json_valid(payload) and json_type(payload) = 'OBJECT' and feed_id is not null and file_no is not null),
tree as (select feed_id, file_no, regexp_replace(substr(j.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') path, case j.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end kind,
  j.value::varchar v from good, json_tree(p) j where j.type <> 'NULL' and j.fullkey <> '$'),
f as (select feed_id, file_no, path, list_sort(list(distinct kind)) kinds from tree where not ends_with(path, '[]') group by all),
tg as (select feed_id, file_no, list_sort(list(distinct v)) tags from tree where path = 'schema' group by all),
pr as (select feed_id, file_no, lag(file_no) over (partition by feed_id order by file_no) prev from (select distinct feed_id, file_no from good) qualify prev is not null),
now_ as (select pr.feed_id, pr.file_no, path, kinds from pr join f using (feed_id, file_no)),
was as (select pr.feed_id, pr.file_no, path, kinds from pr join f on f.feed_id = pr.feed_id and f.file_no = pr.prev),
ch as (select coalesce(n.feed_id, w.feed_id) feed_id, coalesce(n.file_no, w.file_no) file_no, coalesce(n.path, w.path) path, coalesce(n.kinds, w.kinds) kinds,
  case when w.path is null then 'added' when n.path is null then 'removed' else 'retyped' end what from now_ n full join was w on n.feed_id = w.feed_id and n.file_no = w.file_no and n.path = w.path where n.kinds is distinct from w.kinds),
top as (select *, case when contains(path, '.') then regexp_replace(path, '[.][^.]*$', '') else '' end up from ch c
  where not exists (select 1 from ch d where d.feed_id = c.feed_id and d.file_no = c.file_no and (starts_with(c.path, d.path || '.') or starts_with(c.path, d.path || '[]')))),
one as (select feed_id, file_no, up, max(path) filter (what = 'added') came, max(path) filter (what = 'removed') went from top group by all
  having count(*) filter (what = 'added') = 1 and count(*) filter (what = 'removed') = 1 and any_value(kinds) filter (what = 'added') = any_value(kinds) filter (what = 'removed'))
select feed_id, file_no, what drift_kind, path field_path, '' old_path from top anti join one on one.feed_id = top.feed_id and one.file_no = top.file_no and (one.came = top.path or one.went = top.path)
union all select feed_id, file_no, 'renamed', came, went from one
union all select pr.feed_id, pr.file_no, 'retagged', 'schema', '' from pr left join tg a on a.feed_id = pr.feed_id and a.file_no = pr.file_no left join tg b on b.feed_id = pr.feed_id and b.file_no = pr.prev where a.tags is distinct from b.tags"""


@query("p5_found", _DRIFT)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.changes(drift.profile(_lines(spark, sf_dir), "feed_id", "file_no", "payload"))
    return found.select(F.col("feed").alias("feed_id"), "file_no", "drift_kind", "field_path", "old_path")


@query("p5_proposals")
def p5_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renames that the matching proposes, with their scores: those of p5_found, and the likely pairs where several fields went or came. They unify the names."""
    found = drift.changes(drift.profile(_lines(spark, sf_dir), "feed_id", "file_no", "payload"), proposals=True).filter("drift_kind in ('renamed', 'proposed')")
    return found.select(F.col("feed").alias("feed_id"), "file_no", "old_path", F.col("field_path").alias("new_path"), F.round("score", 6).alias("score"), (F.col("drift_kind") == "renamed").alias("certain"))


@query("p5_names")
def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name in the unified table of each field of each file."""
    profiles = drift.profile(_lines(spark, sf_dir), "feed_id", "file_no", "payload")
    return drift.unified_names(drift.changes(profiles, proposals=True), profiles)


@query("p5_unified")
def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under unified names."""
    lines = _lines(spark, sf_dir)
    return drift.unify(lines, p5_names(spark, sf_dir), "feed_id", "file_no", "payload", "line_id")
