"""Queries over speaker timelines: the table of turns, each once, with whole milliseconds as seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.times import timed
from colloquy.operators import scan, scoring
from colloquy.operators import timelines as tl
from colloquy.plans.core_training import TURNS, turns
from colloquy.plans.registry import query

TL = f"""{TURNS}, tl as (select rec_id, turn_id idx, s / 1000e0 st, e / 1000e0 en, speaker sp from timed where speaker is not null and rec_id is not null)"""
OUT = 'rec_id, idx, st "start", en "end", sp speaker'


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, idx, start, end, speaker of the timed turns."""
    t = turns(spark, sf_dir).filter(timed(F.col("start_ms"), F.col("end_ms")) & F.col("speaker").isNotNull() & F.col("rec_id").isNotNull())
    return t.select("rec_id", F.col("turn_id").alias("idx"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "speaker")


def merged_sql(src: str, gap: float, pre: str) -> str:
    """CTEs that merge consecutive turns of one speaker, under the name ``pre``."""
    return f"""{pre}_a as (select *, case when sp is not distinct from lag(sp) over (partition by rec_id order by st, en, idx) then 0 else 1 end ch from {src}),
{pre}_b as (select *, sum(ch) over (partition by rec_id order by st, en, idx rows unbounded preceding) run from {pre}_a),
{pre}_c as (select *, coalesce(st > max(en) over (partition by rec_id, run order by st, en, idx rows between unbounded preceding and 1 preceding) + {gap!r}e0, true)::int fr from {pre}_b),
{pre}_d as (select *, sum(fr) over (partition by rec_id, run order by st, en, idx rows unbounded preceding) part from {pre}_c),
{pre} as (select rec_id, arg_min(idx, (st, en, idx)) idx, min(st) st, max(en) en, any_value(sp) sp from {pre}_d group by rec_id, run, part)"""


def fold_sql(src: str, pre: str, over: str, nst: str, joins: str, drop: str, lend: str) -> str:
    """CTEs that fold each recording in order, one turn per step of the recursion, under the name ``pre``; l.. is the last turn kept."""
    return f"""{pre}_o as (select *, row_number() over (partition by rec_id order by st, en, idx) rn from {src}),
{pre}_f as (select distinct rec_id, 0::bigint rn, null::double lst, null::double len_, null::bigint lidx, null::int lsp, null::double dst, null::double den, null::bigint didx, null::int dsp from {pre}_o
union all select rec_id, rn, case when gone then lst else nst end, case when gone then lend else en end, case when gone then lidx else idx end, case when gone then lsp else sp end,
  case when not gone then lst end, case when not gone and lidx is not null then lend end, case when not gone then lidx end, case when not gone then lsp end
from (select *, {lend} lend from (select *, {drop} gone from (select *, coalesce({joins}, false) joins from (select *, {nst} nst from (select *, coalesce({over}, false) over_ from (
  select o.rec_id, o.rn, o.st, o.en, o.idx, o.sp, f.lst, f.len_, f.lidx, f.lsp, (o.st + f.len_) * 0.5e0 mid from {pre}_f f join {pre}_o o on o.rec_id = f.rec_id and o.rn = f.rn + 1))))))),
{pre} as (select rec_id, didx idx, dst st, den en, dsp sp from {pre}_f where didx is not null
union all select rec_id, arg_max(lidx, rn), arg_max(lst, rn), arg_max(len_, rn), arg_max(lsp, rn) from (select rec_id, rn, coalesce(lidx, -1) lidx, coalesce(lst, -1) lst, coalesce(len_, -1) len_, coalesce(lsp, -1) lsp from {pre}_f) group by rec_id having arg_max(lidx, rn) >= 0)"""


def r05_sql(src: str, pre: str, low: float) -> str:
    return fold_sql(src, pre, "st < len_", "case when over_ then mid else st end", "over_ and sp = lsp", f"joins or (over_ and en - mid < {low!r}e0)", "case when joins then greatest(len_, en) when over_ then mid else len_ end")


def r06_sql(src: str, pre: str, low: float, gap: float) -> str:
    return fold_sql(src, pre, "false", "st", f"lidx is not null and (en - st < {low!r}e0 or (sp = lsp and st <= len_ + {gap!r}e0))", f"joins or en - st < {low!r}e0", "case when joins then greatest(len_, en) else len_ end")


def r07_sql(src: str, pre: str, gap: float, low: float) -> str:
    return fold_sql(src, pre, "st < len_ and sp <> lsp", "case when over_ then mid else st end", f"lidx is not null and sp = lsp and nst <= len_ + {gap!r}e0", f"joins or en - nst < {low!r}e0", "case when joins then greatest(len_, en) when over_ then mid else len_ end")


def renumber_sql(src: str, pre: str) -> str:
    return f"""{pre}_t as (select rec_id, sp, sum(round((en - st) * 1000)::bigint) ms, min((st, en, idx)) f from {src} group by all),
{pre}_r as (select rec_id, sp, (row_number() over (partition by rec_id order by ms desc, f) - 1)::int k from {pre}_t),
{pre} as (select rec_id, idx, st, en, k sp from {src} join {pre}_r using (rec_id, sp))"""


@query("a01_talk_seconds", f"with {TL} select rec_id, sp speaker, sum(round((en - st) * 1000)::bigint) talk_ms from tl group by all")
def a01_talk_seconds(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return t.groupBy("rec_id", "speaker").agg(F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long")).alias("talk_ms"))


@query("k01_sorted_turns", f"with {TL} select rec_id, idx, row_number() over (partition by rec_id order by st, en, idx) place from tl")
def k01_sorted_turns(spark, sf_dir):
    t = scan.running(timeline(spark, sf_dir), tl.REC, "start", tl.ORDER, {"place": ("sum", F.lit(1))}, inclusive=True)
    return t.select("rec_id", "idx", "place")


@query("pred15_long_turns", f"with {TL} select {OUT} from tl where en - st >= 0.15e0")
def pred15_long_turns(spark, sf_dir):
    return timeline(spark, sf_dir).filter(F.col("end") - F.col("start") >= 0.15)


@query("r01_renumbered", f"with {TL}, {renumber_sql('tl', 'rn')} select {OUT} from rn")
def r01_renumbered(spark, sf_dir):
    return tl.renumber(timeline(spark, sf_dir))


@query("r02_relabelled", f"with {TL}, k as (select rec_id, sp, (dense_rank() over (partition by rec_id order by sp) - 1)::int dense from (select distinct rec_id, sp from tl)) select rec_id, idx, dense speaker from tl join k using (rec_id, sp)")
def r02_relabelled(spark, sf_dir):
    t = timeline(spark, sf_dir)
    labels = t.select("rec_id", "speaker").distinct().withColumn("dense", F.dense_rank().over(Window.partitionBy("rec_id").orderBy("speaker")) - 1)
    return t.join(labels, ["rec_id", "speaker"]).select("rec_id", "idx", F.col("dense").alias("speaker"))


@query("r04_merged", f"with {TL}, {merged_sql('tl', 0.05, 'm')} select {OUT} from m")
def r04_merged(spark, sf_dir):
    return tl.merge_same_speaker(tl.stretches(timeline(spark, sf_dir), 0.05), 0.05).drop("island")


@query("r05_split_overlaps", f"with recursive {TL}, {merged_sql('tl', 0.05, 'm')}, {r05_sql('m', 'f', 0.2)} select {OUT} from f")
def r05_split_overlaps(spark, sf_dir):
    return tl.split_overlaps(tl.merge_same_speaker(tl.stretches(timeline(spark, sf_dir), 0.05), 0.05), 0.2).drop("island")


@query("r06_absorbed", f"with recursive {TL}, {r06_sql('tl', 'f', 0.6, 3.0)} select {OUT} from f")
def r06_absorbed(spark, sf_dir):
    return tl.absorb_short(tl.stretches(timeline(spark, sf_dir), 3.0, 0.6), 0.6, 3.0).drop("island")


@query("r07_final_round", f"with recursive {TL}, {r07_sql('tl', 'f', 3.0, 0.15)} select {OUT} from f")
def r07_final_round(spark, sf_dir):
    return tl.split_and_fill(tl.stretches(timeline(spark, sf_dir), 3.0), 3.0, 0.15).drop("island")


@query("r08_other_rule", f"with recursive {TL}, {merged_sql('tl', 0.001, 'm')}, {r07_sql('m', 'f', 0.25, -1e9)}, {renumber_sql('f', 'rn')} select {OUT} from rn where en - st >= 0.15e0".replace("-1000000000.0e0", "-1e9"))
def r08_other_rule(spark, sf_dir):
    t = tl.renumber(tl.split_then_join(timeline(spark, sf_dir), 0.001, 0.25))
    return t.filter(F.col("end") - F.col("start") >= 0.15)


@query("r29_postprocessed", f"with recursive {TL}, {merged_sql('tl', 0.05, 'm')}, {r05_sql('m', 'f5', 0.2)}, {r06_sql('f5', 'f6', 0.2, 3.0)}, {r07_sql('f6', 'f7', 3.0, 0.15)}, {renumber_sql('f7', 'rn')} select {OUT} from rn")
def r29_postprocessed(spark, sf_dir):
    return tl.postprocess(timeline(spark, sf_dir))


@query("r12_prepadded", f"with {TL}, p as (select *, coalesce(lag(en) over (partition by rec_id order by st, en, idx), 0) f from tl) select rec_id, idx, case when st > f then greatest(st - 0.3e0, f, 0) else st end \"start\", en \"end\", sp speaker from p")
def r12_prepadded(spark, sf_dir):
    return tl.prepad(timeline(spark, sf_dir), 0.3).select("rec_id", "idx", "start", "end", "speaker")


@query("r13_ends_from_starts", f"""with {TL}, d as (select rec_id, max(en) dur from tl group by all), p as (select tl.*, coalesce(lead(st) over (partition by rec_id order by st, idx), greatest(dur, st + 1)) nx from tl join d using (rec_id))
select rec_id, idx, st "start", case when nx <= st then st + 0.3e0 else nx end "end", sp speaker from p""")
def r13_ends_from_starts(spark, sf_dir):
    t = timeline(spark, sf_dir)
    dur = t.groupBy("rec_id").agg(F.max("end").alias("dur"))
    return tl.ends_from_starts(t.drop("end").join(dur, "rec_id"), F.col("dur")).select("rec_id", "idx", "start", "end", "speaker")


@query("r14_change_points", f"with {TL}, p as (select *, lag(sp) over (partition by rec_id order by st, idx) who from tl) select rec_id, idx, st \"at\" from p where who <> sp")
def r14_change_points(spark, sf_dir):
    return tl.change_points(timeline(spark, sf_dir))


@query("a29_normalised", f"""with {TL}, {renumber_sql('tl', 'rn')}, kept as (select * from rn where en - st >= 0.05e0)
select rec_id, sp speaker, count(*) n, sum(round((en - st) * 1000)::bigint) talk_ms from kept group by all""")
def a29_normalised(spark, sf_dir):
    t = tl.renumber(timeline(spark, sf_dir)).filter(F.col("end") - F.col("start") >= 0.05)
    return t.groupBy("rec_id", "speaker").agg(F.count("*").alias("n"), F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long")).alias("talk_ms"))


@query("a02_cluster_sizes", f"""with {TL}, n as (select rec_id, sp, count(*) c from tl group by all), top as (select rec_id, max(sp) m from tl group by all),
b as (select rec_id, unnest(range(0, m + 1))::int sp from top) select rec_id, sp speaker, coalesce(c, 0) n from b left join n using (rec_id, sp)""")
def a02_cluster_sizes(spark, sf_dir):
    t = timeline(spark, sf_dir)
    n = t.groupBy("rec_id", "speaker").agg(F.count("*").alias("n"))
    bins = n.groupBy("rec_id").agg(F.max("speaker").alias("m")).select("rec_id", F.explode(F.sequence(F.lit(0), "m")).alias("speaker"))
    return bins.join(n, ["rec_id", "speaker"], "left").fillna(0, ["n"])


@query("a10_cluster_duration", f"with {TL} select sp speaker, round_even(sum(round((en - st) * 1000)::bigint) / 1000e0, 1) total_sec from tl group by all")
def a10_cluster_duration(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return t.groupBy("speaker").agg(F.bround(F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long")) / 1000.0, 1).alias("total_sec"))


RASTER = """cells as (select rec_id, idx, sp, unnest(range(floor(st / {step})::bigint, greatest(floor(st / {step})::bigint + {one}, ceil(en / {step})::bigint))) cell from {src}),
{name} as (select rec_id, cell, arg_max(sp, idx) sp from cells group by all)"""


def raster_sql(src: str, name: str, step: str = "0.1e0", one: int = 1) -> str:
    return RASTER.format(src=src, name=name, step=step, one=one).replace("cells", f"{name}_cells")


@query("m17_raster", f"with {TL}, {raster_sql('tl', 'r')} select rec_id, cell, sp speaker from r")
def m17_raster(spark, sf_dir):
    return tl.raster(timeline(spark, sf_dir), 0.1)


@query("m19_label_track", f"with {TL}, {raster_sql('tl', 'r', '0.05e0', 0)} select rec_id, count(*) n, sum(sp) total, min(cell) first_cell from r group by all")
def m19_label_track(spark, sf_dir):
    """Cells per recording of the label track, which leaves out turns that cover no whole cell edge."""
    r = tl.raster_spans(timeline(spark, sf_dir), 0.05, at_least_one=False).withColumn("n", F.col("to") - F.col("from"))
    return r.groupBy("rec_id").agg(F.sum("n").alias("n"), F.sum(F.col("speaker") * F.col("n")).alias("total"), F.min("from").alias("first_cell"))


# The second timeline: other labels and times for some turns, by a rule on the turn's number, so that every branch of the scores is met.
HYP = "hyp as (select rec_id, idx, round_even((st + 0.3e0 * (idx % 3)) * 1000, 0) / 1000e0 st, en + 0.5e0 en, ((sp * 2 + case when idx % 7 = 0 then 2 else 0 end) % 9)::int sp from tl where idx % 11 <> 0)"


def hypothesis(t: DataFrame) -> DataFrame:
    i = F.col("idx")
    return t.filter(i % 11 != 0).select(
        "rec_id", "idx", (F.rint((F.col("start") + F.lit(0.3) * (i % 3)) * 1000) / 1000.0).alias("start"), (F.col("end") + 0.5).alias("end"),
        ((F.col("speaker") * 2 + F.when(i % 7 == 0, 2).otherwise(0)) % 9).cast("int").alias("speaker"),
    )


PAIR = f"""{TL}, {HYP}, {raster_sql('tl', 'ref')}, {raster_sql('hyp', 'hy')},
frames as (select coalesce(ref.rec_id, hy.rec_id) rec_id, coalesce(ref.cell, hy.cell) cell, coalesce(ref.sp, -1) r, coalesce(hy.sp, -1) h from ref full join hy on ref.rec_id = hy.rec_id and ref.cell = hy.cell),
overlap as (select rec_id, h, r, count(*) n from frames where h >= 0 and r >= 0 group by all)"""


def _frames(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return scoring.frames(t, hypothesis(t), 0.1)


@query("j12_frames", f"with {PAIR} select rec_id, r ref, h hyp, count(*) n from frames group by all")
def j12_frames(spark, sf_dir):
    return scoring.counts(_frames(spark, sf_dir))


@query("a04_overlap_matrix", f"with {PAIR} select rec_id, h hyp, r ref, n from overlap")
def a04_overlap_matrix(spark, sf_dir):
    return scoring.overlap(_frames(spark, sf_dir))


@query("j13_assignment")
def j13_assignment(spark, sf_dir):
    return scoring.assign(scoring.counts(_frames(spark, sf_dir)))


# The best total of any one-to-one mapping, by enumeration over subsets of reference speakers, hypothesis speaker by speaker.
BEST = f"""hs as (select rec_id, h, row_number() over (partition by rec_id order by h) k from (select distinct rec_id, h from overlap)),
rs as (select rec_id, r, (1 << (row_number() over (partition by rec_id order by r) - 1))::bigint bit from (select distinct rec_id, r from overlap)),
dp as (select distinct rec_id, 0::bigint k, 0::bigint used, 0::bigint total from overlap
union all select rec_id, k, used, max(total) from (
  select dp.rec_id, hs.k, dp.used, dp.total from dp join hs on hs.rec_id = dp.rec_id and hs.k = dp.k + 1
  union all select dp.rec_id, hs.k, dp.used | rs.bit, dp.total + o.n from dp join hs on hs.rec_id = dp.rec_id and hs.k = dp.k + 1
    join overlap o on o.rec_id = hs.rec_id and o.h = hs.h join rs on rs.rec_id = o.rec_id and rs.r = o.r where dp.used & rs.bit = 0) group by all),
best as (select rec_id, max(total) hit from dp group by all)"""


@query("score_pairs", f"""with recursive {PAIR}, {BEST}, c as (select rec_id, count_if(r >= 0 or h >= 0) speech, count_if(r >= 0 and h >= 0) both_, count_if(r >= 0 and h < 0) miss, count_if(r < 0 and h >= 0) fa from frames group by all)
select c.rec_id, speech n_speech, case when hit is null or both_ = 0 then 0e0 else hit::double / both_ end frame_acc, case when hit is null then 1e0 else miss::double / speech end miss,
case when hit is null then 1e0 else fa::double / speech end fa, case when hit is null then 1e0 else (both_ - hit)::double / speech end conf, case when hit is null then 1e0 else (miss + fa + both_ - hit)::double / speech end der from c left join best using (rec_id)""")
def score_pairs(spark, sf_dir):
    """The flagship: accuracy and error rates of a timeline against another under the best one-to-one mapping of speakers."""
    n = scoring.counts(_frames(spark, sf_dir))
    return scoring.score(n, scoring.assign(n))


@query("a08_mean_scores", f"""with recursive {PAIR}, {BEST}, c as (select rec_id, count_if(r >= 0 or h >= 0) speech, count_if(r >= 0 and h >= 0) both_, count_if(r >= 0 and h < 0) miss, count_if(r < 0 and h >= 0) fa from frames group by all)
select round(avg(case when hit is null or both_ = 0 then 0e0 else hit::double / both_ end), 6) frame_acc, round(avg(case when hit is null then 1e0 else (miss + fa + both_ - hit)::double / speech end), 6) der, count(*) n from c left join best using (rec_id)""")
def a08_mean_scores(spark, sf_dir):
    return score_pairs(spark, sf_dir).agg(F.round(F.avg("frame_acc"), 6).alias("frame_acc"), F.round(F.avg("der"), 6).alias("der"), F.count("*").alias("n"))


@query("a06_recall")
def a06_recall(spark, sf_dir):
    n = scoring.counts(_frames(spark, sf_dir))
    return scoring.recall(n, scoring.assign(n))


@query("a07_turn_majority")
def a07_turn_majority(spark, sf_dir):
    t = timeline(spark, sf_dir)
    f = scoring.frames(t, hypothesis(t), 0.1)
    return scoring.turn_majority(t, f, scoring.assign(scoring.counts(f)), 0.1)


@query("a07_majority_labels", f"""with {PAIR}, cells as (select rec_id, idx, unnest(range(floor(st / 0.1e0)::bigint, greatest(floor(st / 0.1e0)::bigint + 1, ceil(en / 0.1e0)::bigint))) cell from tl where en - st >= 1),
v as (select c.rec_id, idx, h, count(*) n from cells c join frames f on f.rec_id = c.rec_id and f.cell = c.cell where h >= 0 group by all)
select rec_id, idx, h majority from v qualify row_number() over (partition by rec_id, idx order by n desc, h) = 1""")
def a07_majority_labels(spark, sf_dir):
    return scoring.majority_labels(timeline(spark, sf_dir), _frames(spark, sf_dir), 0.1)


@query("j14_change_point_match")
def j14_change_point_match(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return scoring.match_change_points(tl.change_points(t), tl.change_points(hypothesis(t)), 0.5)


@query("a30_pair_report")
def a30_pair_report(spark, sf_dir):
    """One row per recording with every score."""
    t = timeline(spark, sf_dir)
    h = hypothesis(t)
    f = scoring.frames(t, h, 0.1)
    n = scoring.counts(f)
    m = scoring.assign(n)
    out = scoring.score(n, m).join(scoring.turn_majority(t, f, m, 0.1), "rec_id", "left")
    return out.join(scoring.match_change_points(tl.change_points(t), tl.change_points(h), 0.5), "rec_id", "left")
