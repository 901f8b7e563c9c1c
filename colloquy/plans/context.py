"""Queries over captured text blocks, boxes, statuses and payloads. Parts stand for blocks, orders for source statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import context as cx
from colloquy.operators import joins as jn
from colloquy.operators.scan import running
from colloquy.plans.registry import query, table
from colloquy.plans.texts import SEG, segments

BLOCKS = """bl as (select p_partkey % 50 capture, p_partkey seq, p_size % 3 priority, p_type txt, case when p_partkey % 9 > 0 then (p_partkey * 37 % 600)::double end x,
case when p_partkey % 9 > 0 then (p_partkey * 53 % 400)::double end y, case when p_partkey % 9 > 0 then (100 + p_size * 4)::double end w, case when p_partkey % 9 > 0 then 60e0 end h from part)"""
IOU = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


def blocks(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    put = lambda c: F.when(k % 9 > 0, c.cast("double"))
    return p.select(
        (k % 50).alias("capture"), k.alias("seq"), (F.col("p_size") % 3).alias("priority"), F.col("p_type").alias("text"),
        put(k * 37 % 600).alias("x"), put(k * 53 % 400).alias("y"), put(F.col("p_size") * 4 + 100).alias("width"), put(F.lit(60)).alias("height"),
    )


def _box():
    return F.when(F.col("x").isNotNull(), F.struct("x", "y", "width", "height"))


@query("j08_overlapping_boxes", f"""with {BLOCKS}, p as (select a.capture, a.seq l, b.seq r, {IOU} i, a.w * a.h + b.w * b.h u from bl a join bl b on a.capture = b.capture and a.seq < b.seq where a.x is not null and b.x is not null)
select capture, l "left", r "right" from p where i / (u - i) >= 0.5e0""")
def j08_overlapping_boxes(spark, sf_dir):
    return jn.overlapping_boxes(blocks(spark, sf_dir).withColumn("box", _box()), "capture", "seq", "box", 0.5)


@query("j09_first_accepted")
def j09_first_accepted(spark, sf_dir):
    return cx.first_accepted(blocks(spark, sf_dir), 0.25)


@query("c10_fused")
def c10_fused(spark, sf_dir):
    return cx.fuse(blocks(spark, sf_dir), 0.25)


@query("f23_iou", f"with {BLOCKS}, p as (select a.capture, a.seq, {IOU} i, a.w * a.h + b.w * b.h u from bl a join bl b on b.seq = a.seq + 50 where a.x is not null and b.x is not null) select capture, seq, round(i / (u - i), 9) iou from p")
def f23_iou(spark, sf_dir):
    b = blocks(spark, sf_dir).filter("x is not null").select("capture", "seq", _box().alias("box"))
    n = b.select((F.col("seq") - 50).alias("seq"), F.col("box").alias("other"))
    return b.join(n, "seq").select("capture", "seq", F.round(jn.intersection_over_union(F.col("box"), F.col("other")), 9).alias("iou"))


@query("f24_global_boxes", f"with {BLOCKS} select seq, round(100 + x / 600 * 400, 6) gx, round(200 + (1 - y / 600 - h / 600) * 300, 6) gy, round(w / 600 * 400, 6) gw, round(h / 600 * 300, 6) gh from bl where x is not null")
def f24_global_boxes(spark, sf_dir):
    b = blocks(spark, sf_dir).filter("x is not null")
    part = F.struct(*[(F.col(c) / 600).alias(c) for c in ("x", "y", "width", "height")])
    image = F.struct(F.lit(100.0).alias("x"), F.lit(200.0).alias("y"), F.lit(400.0).alias("width"), F.lit(300.0).alias("height"))
    g = cx.global_box(part, image)
    return b.select("seq", *[F.round(g[c], 6).alias(n) for c, n in (("x", "gx"), ("y", "gy"), ("width", "gw"), ("height", "gh"))])


@query("j10_display", f"""with {BLOCKS}, d as (select * from (values (0, 0e0, 0e0, 300e0, 300e0), (1, 300e0, 0e0, 300e0, 300e0), (2, 0e0, 300e0, 900e0, 300e0)) t(k, x, y, w, h)),
p as (select a.seq, b.k, {IOU} i from bl a, d b where a.x is not null) select seq, arg_max(k, (i, k)) display from p where i > 0 group by seq""")
def j10_display(spark, sf_dir):
    """The display that a block overlaps most, the last of equals; the displays are three constants."""
    each = []
    for k, (x, y, w, h) in enumerate([(0, 0, 300, 300), (300, 0, 300, 300), (0, 300, 900, 300)]):
        a = F.greatest(F.least(F.col("x") + F.col("width"), F.lit(float(x + w))) - F.greatest(F.col("x"), F.lit(float(x))), F.lit(0.0))
        b = F.greatest(F.least(F.col("y") + F.col("height"), F.lit(float(y + h))) - F.greatest(F.col("y"), F.lit(float(y))), F.lit(0.0))
        each.append(F.struct((a * b).alias("i"), F.lit(k).alias("k")))
    best = F.greatest(*each)
    return blocks(spark, sf_dir).filter("x is not null").withColumn("b", best).filter("b.i > 0").select("seq", F.col("b.k").alias("display"))


@query("k08_candidates", f"with {BLOCKS} select capture, seq, row_number() over (partition by capture order by priority, seq)::int place from bl")
def k08_candidates(spark, sf_dir):
    from pyspark.sql import Window

    return blocks(spark, sf_dir).select("capture", "seq", F.row_number().over(Window.partitionBy("capture").orderBy("priority", "seq")).alias("place"))


@query("r22_preorder_budget", f"""with {SEG}, c as (select transcript_id, pos, len(coalesce(txt, '')) n, row_number() over w k, coalesce(sum(len(coalesce(txt, ''))) over (partition by transcript_id order by pos rows between unbounded preceding and 1 preceding), 0) b from segs window w as (partition by transcript_id order by pos))
select transcript_id, pos, least(n, greatest(500 - b, 0)) taken from c where k <= 12""")
def r22_preorder_budget(spark, sf_dir):
    return cx.budgeted_preorder(segments(spark, sf_dir), "transcript_id", "pos", "text", 12, 500)


@query("r22_depth_budget", f"""with {SEG}, nodes as (select transcript_id, pos * 1000 + 0 ord, 1 depth, len(coalesce(txt, '')) n from segs union all select transcript_id, pos * 1000 + k, 2, 5 from (select transcript_id, pos, unnest(range(1, least(coalesce(n_words, 0), 900) + 1)) k from segs)
  union all select transcript_id, pos * 1000 + 999, 3, 7 from segs), c as (select *, row_number() over w k, coalesce(sum(n) over (partition by transcript_id order by ord rows between unbounded preceding and 1 preceding), 0) b from nodes where depth <= 2 window w as (partition by transcript_id order by ord))
select transcript_id, ord, least(n, greatest(400 - b, 0)) taken from c where k <= 40""")
def r22_depth_budget(spark, sf_dir):
    """The same over a tree with words below segments and one more level below, which is too deep to be visited."""
    s = segments(spark, sf_dir).select("transcript_id", "pos", "text", F.least(F.greatest(F.coalesce("n_words", F.lit(0)), F.lit(0)), F.lit(900)).alias("k"))
    node = lambda at, depth, text: F.struct(at.cast("long").alias("ord"), F.lit(depth).alias("depth"), text.alias("text"))
    words = F.transform(F.filter(F.sequence(F.lit(0), F.col("k")), lambda i: i > 0), lambda i: node(F.col("pos") * 1000 + i, 2, F.lit("words")))
    tree = F.concat(F.array(node(F.col("pos") * 1000, 1, F.col("text"))), words, F.array(node(F.col("pos") * 1000 + 999, 3, F.lit("toodeep"))))
    return cx.budgeted_preorder(s.select("transcript_id", F.inline(tree)), "transcript_id", "ord", "text", 40, 400, "depth", 2)


@query("r23_reading_order")
def r23_reading_order(spark, sf_dir):
    b = blocks(spark, sf_dir).filter("x is not null")
    return cx.reading_order(b.select(F.col("capture").alias("page"), (F.col("x") / 600).alias("x"), (F.col("y") / 460).alias("y"), F.lit(0.02).alias("h"), "text"))


PAY = "pay as (select o_custkey, o_orderkey, round(o_totalprice)::bigint n from orders)"


@query("r25_payload_budget", f"""with recursive {PAY}, o as (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from pay),
f as (select distinct o_custkey, 0::bigint rn, null::bigint o_orderkey, null::boolean kept, 1000000::bigint remaining from pay
union all select f.o_custkey, o.rn, o.o_orderkey, o.n <= f.remaining, f.remaining - case when o.n <= f.remaining then o.n else 0 end from f join o on o.o_custkey = f.o_custkey and o.rn = f.rn + 1)
select o_custkey, o_orderkey, kept, remaining "left" from f where rn > 0""")
def r25_payload_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("n"))
    return cx.within_budget(o, "o_custkey", "o_orderkey", "n", 1_000_000)


@query("a18_readiness", "select o_orderpriority source, count(*) n, max(round(o_totalprice)::bigint) top, quantile_disc(round(o_totalprice)::bigint, 0.5) p50, quantile_disc(round(o_totalprice)::bigint, 0.95) p95 from orders group by all")
def a18_readiness(spark, sf_dir):
    """Count, greatest and nearest-rank percentiles of the durations of each source."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.round("o_totalprice").cast("long").alias("ms"))
    return cx.nearest_rank(o, "source", "ms", [50, 95], 10_000.0)


@query("a18_states", """with o as (select lower(o_orderpriority) source, case o_orderstatus when 'F' then 'succeeded' when 'P' then 'timedout' else 'running' end state, o_orderdate > timestamp '1998-01-01' late from orders)
select source || '.' || state key, count(*) n, count(*) filter (state <> 'running') n_terminal, count(*) filter (late and state <> 'running') n_late from o group by all""")
def a18_states(spark, sf_dir):
    """The histogram of the readiness report: how many samples of each source are in each state, how many of them ended, and how many of those late."""
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "timedout").otherwise("running")
    o = table(spark, sf_dir, "orders").select(F.lower("o_orderpriority").alias("source"), state.alias("state"), (F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")).alias("late"))
    return cx.state_histogram(o, "source", "state", "late", ["running"])


@query("a19_percentiles", "select event_type, count(*) n, max(value) top, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.9) p90, quantile_disc(value, 0.99) p99 from events group by all")
def a19_percentiles(spark, sf_dir):
    return cx.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", [50, 90, 99], 5.0)


@query("a21_counters", "select lower('source.' || o_orderpriority || '.' || o_orderstatus) counter, count(*) n from orders group by all")
def a21_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.lower(F.concat_ws(".", F.lit("source"), "o_orderpriority", "o_orderstatus")).alias("counter")).agg(F.count("*").alias("n"))


@query("a22_payload_bytes", f"with {PAY} select o_custkey, sum(n) total from pay group by all")
def a22_payload_bytes(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round("o_totalprice").cast("long")).alias("total"))


@query("a23_mean_confidence", f"with {SEG} select transcript_id, round(coalesce(avg(conf) filter (conf > 0 and not isnan(conf)), 0), 9) mean, round(coalesce(max(conf) filter (not isnan(conf)), 0), 9) top from segs group by all")
def a23_mean_confidence(spark, sf_dir):
    c = F.when(~F.isnan("confidence"), F.col("confidence"))
    return segments(spark, sf_dir).groupBy("transcript_id").agg(F.round(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)), 9).alias("mean"), F.round(F.coalesce(F.max(c), F.lit(0.0)), 9).alias("top"))


@query("a27_greatest", f"with {SEG} select transcript_id, pos, greatest(conf, case when pos % 2 = 0 then 0.5e0 end) c from segs")
def a27_greatest(spark, sf_dir):
    return segments(spark, sf_dir).select("transcript_id", "pos", F.greatest("confidence", F.when(F.col("pos") % 2 == 0, 0.5)).alias("c"))


@query("a16_observation", f"with {SEG} select transcript_id, count(*) n_segments, count(txt) has_text, coalesce(sum(len(txt)), 0) n_chars, count_if(sp is not null and sp <> '') has_speaker, count_if(coalesce(n_words, 0) > 0) has_words from segs group by all")
def a16_observation(spark, sf_dir):
    """Presence and sizes of what was captured, none of its content."""
    return segments(spark, sf_dir).groupBy("transcript_id").agg(
        F.count("*").alias("n_segments"), F.count("text").alias("has_text"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n_chars"),
        F.count_if(F.col("speaker") != "").alias("has_speaker"), F.count_if(F.col("n_words") > 0).alias("has_words"),
    )


@query("r24_revisions", "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) revision from events")
def r24_revisions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e = running(e, ["user_id"], "t", ["ts", "event_id"], {"revision": ("sum", F.lit(1))}, inclusive=True, bucket=86_400.0)
    return e.select("user_id", "event_id", "revision")


EDGES = {"fusion": ["ocr", "browser", "ax"], "ocr": ["screenshot"], "screenshot": ["target"], "ax": ["editor"], "editor": ["target"], "browser": ["target"], "target": []}


@query("g01_closure", "with recursive e as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, x in EDGES.items() for b in x) + """) t(a, b)), r as (select o_orderkey id, case o_orderkey % 4 when 0 then 'fusion' when 1 then 'ocr' when 2 then 'ax' else 'browser' end k from orders),
c as (select * from r union select c.id, e.b from c join e on e.a = c.k) select id, list_sort(list(distinct k)) kinds from c group by all""")
def g01_closure(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "fusion").when(k == 1, "ocr").when(k == 2, "ax").otherwise("browser")
    return cx.closure(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(kind).alias("kinds")), EDGES)


@query("c11_last_write", "select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) status, list(o_orderkey order by o_orderdate, o_orderkey) every_key from orders group by all")
def c11_last_write(spark, sf_dir):
    """Manifest assembly: the last write wins for single values, lists are appended in order."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", at).alias("status"), F.transform(F.array_sort(F.collect_list(at)), lambda x: x["o_orderkey"]).alias("every_key"))


@query("j02_optional_document", "select o_orderkey, count(l_orderkey) n from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 45 group by all")
def j02_optional_document(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    n = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return o.select("o_orderkey").join(n, "o_orderkey", "left").fillna(0, ["n"])


@query("j03_dependent", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def j03_dependent(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(l.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("t06_snapshot", "select o_custkey, count_if(o_orderstatus <> 'O') terminal, count(*) n, max(o_orderdate) > timestamp '1997-01-01' late from orders group by all")
def t06_snapshot(spark, sf_dir):
    """Per capture: how many sources are terminal at the deadline, and whether any came late."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "O").alias("terminal"), F.count("*").alias("n"), (F.max("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")).alias("late"))
