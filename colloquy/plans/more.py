"""Queries over chunks, beams, trees and small lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import hashes
from colloquy.functions import vectors as vx
from colloquy.operators import chunks, clusters, ranking
from colloquy.operators import frames as fr
from colloquy.operators.delivery import first_delivery
from colloquy.plans.frames import pred03_energy_vad
from colloquy.plans.registry import query, table
from colloquy.plans.texts import SEG, segments
from colloquy.plans.timelines import TL, timeline
from colloquy.plans.vectors import CENTROIDS
from colloquy.sources.timelines import speaker_line


@query("m18_chunks")
def m18_chunks(spark, sf_dir):
    return chunks.chunk_bounds(timeline(spark, sf_dir))


@query("m13_speech_ranges", f"""with {TL}, s as (select rec_id, floor(st * 100)::bigint a, ceil(en * 100)::bigint b from tl), m as (select *, coalesce(a > max(b) over (partition by rec_id order by a, b rows between unbounded preceding and 1 preceding), true)::int fresh from s),
g as (select *, sum(fresh) over (partition by rec_id order by a, b rows unbounded preceding) k from m) select rec_id, min(a) from_sample, max(b) to_sample from g group by rec_id, k""")
def m13_speech_ranges(spark, sf_dir):
    return chunks.speech_ranges(timeline(spark, sf_dir), 100)


@query("k04_beam", """with recursive lg as (select l_orderkey, l_linenumber - 1 step, l_suppkey token, max(-(l_quantity::bigint % 10) - 1)::double lp from lineitem group by all),
c as (select *, row_number() over (partition by l_orderkey, step order by lp desc, token) k from lg), n as (select distinct l_orderkey from lg), b as (select l_orderkey, 0 step, []::bigint[] ids, 0e0 total from n
union all select l_orderkey, step + 1, ids, total from (select *, row_number() over (partition by l_orderkey order by total desc, ids) r from (
  select b.l_orderkey, b.step, list_concat(b.ids, case when c.token is null then []::bigint[] else [c.token] end) ids, b.total + coalesce(c.lp, 0) total from b left join c on c.l_orderkey = b.l_orderkey and c.step = b.step and c.k <= 4 where b.step < 7)) where r <= 2)
select l_orderkey, (row_number() over (partition by l_orderkey order by total desc, ids) - 1)::int rank, ids, total from b where step = 7""")
def k04_beam(spark, sf_dir):
    """The two best sequences over all steps, seven at most; line items stand for choices."""
    l = table(spark, sf_dir, "lineitem")
    lg = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("step"), F.col("l_suppkey").alias("token"), (-(F.col("l_quantity").cast("long") % 10) - 1).cast("double").alias("logprob"))
    return chunks.beam(lg, "l_orderkey", 2, 7)


@query("m05_absorbed_by_duration", f"""with {CENTROIDS}, n as (select label, sum((vec_id % 7) * 0.1e0) n from u group by all), big as (select cen.* from cen join n using (label) where n >= 15),
s as (select u.vec_id, big.label c, round(list_dot_product(u.v, big.c), 9) sc from u join n using (label), big where n < 15),
moved as (select vec_id, c from s qualify row_number() over (partition by vec_id order by sc desc, c) = 1 union all select u.vec_id, u.label from u join n using (label) where n >= 15 or not exists (select 1 from big)),
k as (select c, (row_number() over (order by c) - 1)::int label from (select distinct c from moved)) select vec_id, label from moved join k using (c)""")
def m05_absorbed_by_duration(spark, sf_dir):
    """Clusters whose members last less than 15 s in all go to the nearest of the others; a vector's number gives its duration."""
    e = table(spark, sf_dir, "embeddings").withColumn("sec", (F.col("vec_id") % 7) * 0.1)
    return clusters.absorb(e, "vec_id", "label", "embedding", 15.0, F.sum("sec"))


# of the survey: a cell of the grid is the pipeline run with its parameters; here threshold, gap filling and runs over frames of an hour
_GRID = """with fr as (select user_id, epoch_us(ts) // 3600000000 f, max(value) v from events where user_id is not null group by all),
g as (select a.v onset, b.v gap from (values (10e0), (50e0), (100e0)) a(v), (values (1), (6)) b(v)),
act as (select onset, gap, user_id, f, coalesce((f - lag(f) over w > gap + 1)::int, 1) fresh from fr, g where v >= onset window w as (partition by onset, gap, user_id order by f)),
run as (select *, sum(fresh) over (partition by onset, gap, user_id order by f rows unbounded preceding) k from act)
select onset, gap, count(*) n_turns, sum(len)::bigint n_frames, max(len) longest from (select onset, gap, max(f) - min(f) + 1 len from run group by onset, gap, user_id, k) group by all"""


@query("m16_variants", _GRID)
def m16_variants(spark, sf_dir):
    """A grid of parameters over one table of frames: each frame is set beside the parameters whose threshold it meets, and gaps are filled as each cell has it."""
    e = table(spark, sf_dir, "events").filter("user_id is not null").groupBy("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("f")).agg(F.max("value").alias("v"))
    grid = F.array(*[F.struct(F.lit(o).alias("onset"), F.lit(g).alias("gap")) for o in (10.0, 50.0, 100.0) for g in (1, 6)])
    on = e.select("user_id", "f", F.explode(F.filter(grid, lambda g: F.col("v") >= g["onset"])).alias("g")).select("user_id", "f", "g.onset", "g.gap")
    track = ["onset", "gap", "user_id"]
    turns = fr.fill_gaps(fr.runs(on, track, "f"), track, F.col("gap"))
    length = F.col("to") - F.col("from")
    return turns.groupBy("onset", "gap").agg(F.count("*").alias("n_turns"), F.sum(length).alias("n_frames"), F.max(length).alias("longest"))


@query("f22_hard_labels", """select vec_id, [[]::int[], [0], [1], [2], [3], [0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]][list_position(embedding[1:11], list_max(embedding[1:11]))] speakers from embeddings""")
def f22_hard_labels(spark, sf_dir):
    """The speakers of the likeliest of eleven classes, the first of equals."""
    classes = F.array(*[F.array(*map(F.lit, c)).cast("array<int>") for c in fr.powerset_classes(4, 2)])
    p = vx.doubles(F.slice("embedding", 1, 11))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(classes, F.array_position(p, F.array_max(p)).cast("int")).alias("speakers"))


@query("f38_argmax", "select vec_id, list_position(embedding, list_max(embedding)) - 1 state from embeddings")
def f38_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("state"))


@query("f25_group_ids", "select doc_id, 'dup:' || substring(sha256(coalesce(source, '') || '|' || coalesce(category, '')), 1, 12) gid from documents")
def f25_group_ids(spark, sf_dir):
    """Names of groups by a hash; the hash is SHA-256, so names differ from those of other systems while the groups agree."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("dup:"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("category", F.lit(""))), 256), 1, 12)).alias("gid"))


@query("f26_gray", "select p_partkey, (77 * (p_size % 256) + 150 * (p_partkey % 256) + 29 * (p_partkey * 7 % 256)) >> 8 gray from part")
def f26_gray(spark, sf_dir):
    r, g, b = F.col("p_size") % 256, F.col("p_partkey") % 256, F.col("p_partkey") * 7 % 256
    return table(spark, sf_dir, "part").select("p_partkey", F.shiftright(r * 77 + g * 150 + b * 29, 8).alias("gray"))


@query("f32_percent", "select l_orderkey, l_linenumber, l_partkey, printf('%.1f%%', l_discount * 100) shown from lineitem")
def f32_percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.format_string("%.1f%%", F.col("l_discount") * 100).alias("shown"))


@query("f19_projection")
def f19_projection(spark, sf_dir):
    """Vectors in a model's space: centred, then times its matrix."""
    rng = np.random.default_rng(11)
    mean, matrix = rng.normal(size=64) * 0.01, rng.normal(size=(64, 8))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(a: pa.Array) -> pa.Array:
        return pa.array(list((np.array(a.to_pylist(), dtype=float) - mean) @ matrix), type=pa.list_(pa.float64()))

    return table(spark, sf_dir, "embeddings").select("vec_id", project("embedding").alias("v"))


@query("pred04_vad_fallback", None)
def pred04_vad_fallback(spark, sf_dir):
    """Requests of which hardly anything is speech are taken as speech throughout."""
    s = pred03_energy_vad(spark, sf_dir)
    return s.select("request_id", (F.coalesce("speech", F.lit(0.0)) < 0.05).alias("fallback"))


@query("pred05_denied_domains", "select p_partkey, case when p_size % 2 = 0 then 'a.' else '' end || lower(split_part(p_type, ' ', 1)) || '.com' host from part where not (host = 'economy.com' or ends_with(host, '.economy.com') or host = 'small.com' or ends_with(host, '.small.com'))".replace("select p_partkey, case", "select * from (select p_partkey, case", 1).replace(" host from part where not (", " host from part) where not ("))
def pred05_denied_domains(spark, sf_dir):
    """Hosts that are none of a list of domains and lie under none: every suffix of a host is looked up by equality."""
    denied = [d.strip().lower().removeprefix("*.").rstrip(".") for d in ("*.ECONOMY.com", "small.com.")]
    host = F.concat(F.when(F.col("p_size") % 2 == 0, "a.").otherwise(""), F.lower(F.element_at(F.split("p_type", " "), 1)), F.lit(".com"))
    parts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return table(spark, sf_dir, "part").select("p_partkey", host.alias("host")).filter(~F.arrays_overlap(suffixes, F.array(*map(F.lit, denied))))


@query("j15_files_by_stem", """with r as (select distinct rec_id, regexp_replace(regexp_extract(media_path, '[^/]*$'), '\\.[^.]*$', '') stem from recordings where media_path is not null and rec_id is not null),
f as (select distinct rec_id own, (request_id % 2)::int inner_ from asr_requests where rec_id is not null and request_id is not null),
c as (select r.rec_id, stem, own || case when inner_ = 1 then '/diarization.json' else '.json' end file, case when own = stem then 0 else 2 end + inner_ priority from r join f on starts_with(own, stem) where stem <> '')
select rec_id, stem, file, priority from c qualify row_number() over (partition by rec_id, stem order by priority, file) = 1""")
def j15_files_by_stem(spark, sf_dir):
    """The file of each recording's stem: stem.json, else stem/diarization.json, else stem*.json, else stem*/diarization.json, of several the
    first by name. Requests stand for files, those of odd number for folders. A file is met under each of its prefixes, by equality."""
    stem = F.regexp_replace(F.regexp_extract("media_path", "[^/]*$", 0), r"\.[^.]*$", "")
    r = table(spark, sf_dir, "recordings").filter("media_path is not null and rec_id is not null").select("rec_id", stem.alias("stem")).filter("stem <> ''").distinct()
    f = table(spark, sf_dir, "asr_requests").filter("rec_id is not null and request_id is not null and rec_id <> ''")
    f = f.select(F.col("rec_id").alias("own"), (F.col("request_id") % 2).cast("int").alias("inner")).distinct()
    prefixes = f.select("*", F.explode(F.sequence(F.lit(1), F.char_length("own"))).alias("n")).select("own", "inner", F.expr("substring(own, 1, n)").alias("stem"))
    file = F.concat("own", F.when(F.col("inner") == 1, "/diarization.json").otherwise(".json"))
    priority = F.when(F.col("own") == F.col("stem"), 0).otherwise(2) + F.col("inner")
    best = prefixes.groupBy("stem").agg(F.min(F.struct(priority.cast("int").alias("priority"), file.alias("file"))).alias("best"))
    return r.join(best, "stem").select("rec_id", "stem", "best.file", "best.priority")


@query("pred16_audio_budget", """select request_id, case when coalesce(len(samples), 0) = 0 then 'empty' else 'too large' end error, 44 + 2 * coalesce(len(samples), 0) n_bytes
from (select * from asr_requests qualify row_number() over (partition by request_id order by ingested_at nulls last) = 1) where coalesce(len(samples), 0) = 0 or 44 + 2 * len(samples) > 4096""")
def pred16_audio_budget(spark, sf_dir):
    """The requests that an engine refuses: without samples, or over its budget of bytes as 16-bit WAV. The budget here is 4 KiB, as rates are low."""
    n = F.coalesce(F.when(F.col("samples").isNotNull(), F.size("samples")), F.lit(0)).cast("long")
    t = table(spark, sf_dir, "asr_requests").select("request_id", "ingested_at", n.alias("n"))
    t = first_delivery(t, "request_id", "ingested_at", ["n"]).withColumn("n_bytes", F.col("n") * 2 + 44)
    return t.filter("n = 0 or n_bytes > 4096").select("request_id", F.when(F.col("n") == 0, "empty").otherwise("too large").alias("error"), "n_bytes")


@query("j17_correlated", "select o_orderkey, case when l.k is null then 'stale' else 'ok' end state from orders left join (select distinct l_orderkey k from lineitem where l_linestatus = 'F') l on l.k = o_orderkey")
def j17_correlated(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("ok", F.lit(True))
    return table(spark, sf_dir, "orders").join(l, "o_orderkey", "left").select("o_orderkey", F.when(F.col("ok"), "ok").otherwise("stale").alias("state"))


@query("c08_single_segment", "select rec_id, 0e0 \"start\", duration_seconds \"end\" from (select * from recordings where rec_id is not null qualify row_number() over (partition by rec_id order by ingested_at nulls last) = 1) where duration_seconds > 0")
def c08_single_segment(spark, sf_dir):
    r = first_delivery(table(spark, sf_dir, "recordings").filter("rec_id is not null"), "rec_id", "ingested_at", ["duration_seconds"])
    return r.filter("duration_seconds > 0").select("rec_id", F.lit(0.0).alias("start"), F.col("duration_seconds").alias("end"))


@query("c09_text_fields", f"with {SEG}, f as (select transcript_id, pos, unnest([txt, sp]) v, unnest(['text', 'speaker']) field from segs) select transcript_id, pos, 'ax:' || pos || ':' || field ref from f where trim(v) <> ''")
def c09_text_fields(spark, sf_dir):
    """Every text field of every node, as one row with its source."""
    s = segments(spark, sf_dir)
    f = s.select("transcript_id", "pos", F.inline(F.array(*[F.struct(F.col(c).alias("v"), F.lit(c).alias("field")) for c in ("text", "speaker")])))
    return f.filter(F.trim("v") != "").select("transcript_id", "pos", F.concat_ws(":", F.lit("ax"), "pos", "field").alias("ref"))


@query("c13_candidates", f"with {SEG}, t as (select transcript_id, count(*) filter (txt is not null and trim(txt) <> '') n from segs group by all) select transcript_id, case when n > 0 then n else 1 end candidates from t")
def c13_candidates(spark, sf_dir):
    """Candidates of each document: its boxes with text or, without any, its whole text."""
    n = segments(spark, sf_dir).groupBy("transcript_id").agg(F.count(F.when(F.trim("text") != "", 1)).alias("n"))
    return n.select("transcript_id", F.when(F.col("n") > 0, F.col("n")).otherwise(1).alias("candidates"))


@query("a17_text_nodes", f"with {SEG} select transcript_id, count(txt) + count(sp) nodes, coalesce(sum(len(txt)), 0) + coalesce(sum(len(sp)), 0) chars from segs group by all")
def a17_text_nodes(spark, sf_dir):
    z = F.lit(0)
    return segments(spark, sf_dir).groupBy("transcript_id").agg((F.count("text") + F.count("speaker")).alias("nodes"), (F.coalesce(F.sum(F.char_length("text")), z) + F.coalesce(F.sum(F.char_length("speaker")), z)).alias("chars"))


@query("s14_markdown", f"""with {TL}, k as (select *, floor(st + 0.5e0)::bigint u from tl), l as (select rec_id, idx, st, en, '- Speaker' || (sp + 1) || '    ' || case when u >= 3600 then printf('%02d:%02d:%02d', u // 3600, u // 60 % 60, u % 60) else printf('%02d:%02d', u // 60, u % 60) end line from k)
select rec_id, md5('# Timeline' || chr(10) || chr(10) || string_agg(line, chr(10) order by st, en, idx)) digest from l group by all""")
def s14_markdown(spark, sf_dir):
    """A report of each recording's timeline; a report is one text, as long as its timeline."""
    t = timeline(spark, sf_dir).withColumn("line", F.concat(F.lit("- "), speaker_line(F.col("speaker"), F.col("start"))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "idx", "line"))), lambda x: x["line"])
    return t.groupBy("rec_id").agg(F.md5(F.concat(F.lit("# Timeline\n\n"), F.array_join(lines, "\n"))).alias("digest"))


_CAND = "c as (select p_brand engine, p_type path, p_partkey seen, p_size >= 25 ready, p_size % 3 = 0 shared, p_retailprice > 1200 env from part)"


def _candidates(spark, sf_dir):
    ready, shared, env = F.col("p_size") >= 25, F.col("p_size") % 3 == 0, F.col("p_retailprice") > 1200
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("engine"), F.col("p_type").alias("path"), F.col("p_partkey").alias("seen"), ready.alias("ready"), shared.alias("shared"), env.alias("env"))


@query("k05_ranked", f"""with {_CAND}, one as (select * from c qualify row_number() over (partition by engine, path order by seen) = 1), s as (select *, 10 * ready::int + 5 * shared::int + 8 * env::int score from one)
select engine, path, score, row_number() over (partition by engine order by score desc, path) - 1 place from s""")
def k05_ranked(spark, sf_dir):
    """Candidates, those seen first of each path, by what speaks for them; parts stand for them."""
    score = sum((F.col(c).cast("int") * w for c, w in (("ready", 10), ("shared", 5), ("env", 8))), F.lit(0))
    return ranking.ranked_candidates(_candidates(spark, sf_dir), ["engine", "path"], "seen", score, "path").select("engine", "path", "score", F.col("place").cast("long").alias("place"))


@query("k06_first_ready", f"with {_CAND} select engine, arg_min(path, (case when env then 0 when shared then 1 else 2 end, path)) filter (ready) path from c group by all")
def k06_first_ready(spark, sf_dir):
    return ranking.first_ready(_candidates(spark, sf_dir), "engine", "path", F.col("ready"), F.when(F.col("env"), 0).when(F.col("shared"), 1).otherwise(2))


@query("k09_queue", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority desc, o_orderdate, o_orderkey) - 1 turn from orders")
def k09_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ranking.queue_order(o, "o_custkey", F.col("o_orderpriority"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("turn").cast("long").alias("turn"))


@query("j16_aliases", """with e as (select n_name entry, [n_name, n_name[1:3], n_name || '-' || n_nationkey] al from nation), k as (select lower(trim(a)) a, min(entry) entry from (select entry, unnest(al) a from e) group by all)
select distinct s_name, entry from (select ' ' || case s_suppkey % 3 when 0 then upper(n_name) when 1 then n_name[1:3] else 'none' end s_name from supplier join nation on s_nationkey = n_nationkey) n join k on lower(trim(n.s_name)) = k.a""")
def j16_aliases(spark, sf_dir):
    """Names as they are written, in any case, to the entry that they or an alias stand for."""
    n = table(spark, sf_dir, "nation")
    e = n.select(F.col("n_name").alias("entry"), F.array(F.substring("n_name", 1, 3), F.concat("n_name", F.lit("-"), "n_nationkey")).alias("aliases"))
    written = F.when(F.col("s_suppkey") % 3 == 0, F.upper("n_name")).when(F.col("s_suppkey") % 3 == 1, F.substring("n_name", 1, 3)).otherwise("none")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(" "), written).alias("s_name"))
    return ranking.by_alias(s, "s_name", e, "entry", "aliases")


@query("f31_hashes")
def f31_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashes.splitmix64(F.col("doc_id")).alias("mixed"), hashes.fnv1a_64(F.col("source")).alias("fnv"))
