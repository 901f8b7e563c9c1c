"""Queries over text functions, token evidence and transcript documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import tokens as tk
from colloquy.operators.delivery import first_delivery
from colloquy.plans.registry import query, table

WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"


def squeeze_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}', ' ', 'g'))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, pos, start, end, text, speaker, confidence of every segment of each transcript, once."""
    t = table(spark, sf_dir, "transcripts").withColumn("s", F.transform("segments", lambda s: F.struct(s["start_sec"].alias("start"), s["end_sec"].alias("end"), s["text"].alias("text"), s["speaker"].alias("speaker"), s["confidence"].alias("confidence"), F.size(s["words"]).alias("n_words"))))
    t = first_delivery(t, "transcript_id", "ingested_at", ["s"])
    return t.select("transcript_id", F.posexplode("s")).select("transcript_id", "pos", "col.*")


SEG = """tr as (select * from transcripts qualify row_number() over (partition by transcript_id order by ingested_at nulls last) = 1),
seg as (select transcript_id, (generate_subscripts(segments, 1) - 1)::int pos, unnest(segments) g from tr),
segs as (select transcript_id, pos, g.start_sec st, g.end_sec en, g.text txt, g.speaker sp, g.confidence conf, len(g.words)::int n_words from seg)"""


@query("f01_normalized", f"select doc_id, md5(lower({squeeze_sql('text')})) digest from documents")
def f01_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query("f02_surface_keys", f"with {SEG} select transcript_id, pos, lower({squeeze_sql('sp')}) k from segs where sp not similar to '.*[^ -~].*'")
def f02_surface_keys(spark, sf_dir):
    s = segments(spark, sf_dir).filter(~F.col("speaker").rlike("[^ -~]"))
    return s.select("transcript_id", "pos", tx.surface_key(F.col("speaker")).alias("k"))


@query("f02_surface_keys_unicode")
def f02_surface_keys_unicode(spark, sf_dir):
    return segments(spark, sf_dir).select("transcript_id", "pos", tx.surface_key(F.col("text")).alias("k"))


@query("f03_tags_stripped", f"with {SEG} select transcript_id, pos, {squeeze_sql('txt')} clean from segs where txt is not null")
def f03_tags_stripped(spark, sf_dir):
    tagged = F.concat(F.lit("<|en|><|nospeech|> "), F.col("text"), F.lit("<|woitn|>"))
    return segments(spark, sf_dir).filter("text is not null").select("transcript_id", "pos", tx.strip_tags(tagged).alias("clean"))


@query("f04_blank_lines", r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g'), '\n{3,}', E'\n\n', 'g'), '^\n+|\n+$', '', 'g')) digest from documents where text is not null and not contains(text, chr(13))""")
def f04_blank_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & ~F.contains(F.col("text"), F.lit("\r")))
    return d.select("doc_id", F.md5(tx.collapse_blank_lines(F.col("text"))).alias("digest"))


@query("f05_text_confidence", f"with {SEG} select transcript_id, pos, md5(txt) digest, conf confidence from segs where txt is not null")
def f05_text_confidence(spark, sf_dir):
    s = segments(spark, sf_dir).filter("text is not null")
    text, value = tx.split_confidence(F.concat(F.col("text"), F.lit("\n---\n"), F.coalesce(F.col("confidence").cast("string"), F.lit("none"))))
    return s.select("transcript_id", "pos", F.md5(text).alias("digest"), value.alias("confidence"))


@query("f06_languages", "select doc_id, lower(split_part(replace(lang, '_', '-'), '-', 1)) primary_lang, case when lower(split_part(replace(lang, '_', '-'), '-', 1)) in ('zh', 'yue', 'ja', 'ko', 'en') then lower(split_part(replace(lang, '_', '-'), '-', 1)) else 'auto' end known from documents")
def f06_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.primary_language(F.col("lang")).alias("primary_lang"), tx.known_language(F.col("lang")).alias("known"))


_ENGINE_CASE = "case " + " ".join(f"when lower(trim(engine)) in ({', '.join(repr(x) for x in names)}) then '{e}'" for e, names in tx.ENGINES.items()) + " end"


@query("f07_engines", f"select rec_id, engine, {_ENGINE_CASE} family, case when contains(lower(coalesce(model_name, '')), 'qwen') or contains(lower(engine), 'dashscope') then 'qwen_asr' else 'openai_audio' end label from recordings where engine is not null")
def f07_engines(spark, sf_dir):
    """Engine families and, of the same rows, the label guessed for an HTTP engine."""
    r = table(spark, sf_dir, "recordings").filter("engine is not null")
    return r.select("rec_id", "engine", tx.engine_of(F.col("engine")).alias("family"), tx.http_label(F.col("engine"), F.coalesce("model_name", F.lit(""))).alias("label"))


@query("f09_model_identity", """select rec_id, case when channels = 1 then coalesce(app, 'none') || '/' || coalesce(engine, 'none') else 'rev-' || rec_id end model, case when channels = 1 then 'rev-' || rec_id end revision from recordings""")
def f09_model_identity(spark, sf_dir):
    path = F.concat(F.lit("/cache/models--"), F.coalesce("app", F.lit("none")), F.lit("--"), F.replace(F.coalesce("engine", F.lit("none")), F.lit("/"), F.lit("--")), F.when(F.col("channels") == 1, "/snapshots/").otherwise("/other/"), F.lit("rev-"), F.col("rec_id"))
    name, revision = tx.model_identity(path)
    return table(spark, sf_dir, "recordings").select("rec_id", name.alias("model"), revision.alias("revision"))


@query("f10_truncated", "select doc_id, md5(substring(text, 1, 64)) digest, length(text) n from documents")
def f10_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring("text", 1, 64)).alias("digest"), F.char_length("text").cast("long").alias("n"))


@query("f11_scripts", f"with {SEG} select transcript_id, pos, coalesce(regexp_matches(regexp_replace(txt, '[^\\p{{L}}]', '', 'g'), '^[A-Z]{{2,}}$'), false) upper_run, coalesce(regexp_matches(txt, '[\\x{{3400}}-\\x{{9fff}}]') and regexp_matches(txt, '[A-Za-z]'), false) mixed from segs")
def f11_scripts(spark, sf_dir):
    return segments(spark, sf_dir).select("transcript_id", "pos", tx.uppercase_run(F.col("text")).alias("upper_run"), tx.mixed_script(F.col("text")).alias("mixed"))


# Token evidence: line items stand for tokens of an order's text, with scores derived from their numbers.
EVIDENCE = """ev as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, -(l_quantity / 16e0) lp, l_discount * 50e0 ent, l_tax * 4e0 mar,
case when l_linenumber % 5 = 0 then 'ABC' || l_returnflag else 'tok' || l_returnflag end txt from lineitem),
scored as (select *, case when lp <= -1.5e0 then least(-lp, 8) + 4 else 0 end + case when ent >= 2.5e0 then least(ent, 8) / 8 + 3 else 0 end + case when mar <= 0.2e0 then 1 else 0 end
 + case when regexp_matches(regexp_replace(txt, '[^A-Za-z]', '', 'g'), '^[A-Z]{2,}$') then 2 else 0 end score from ev)"""


def evidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (-(F.col("l_quantity") / 16.0)).alias("lp"), (F.col("l_discount") * 50.0).alias("ent"), (F.col("l_tax") * 4.0).alias("mar"),
        F.concat(F.when(F.col("l_linenumber") % 5 == 0, "ABC").otherwise("tok"), F.col("l_returnflag")).alias("txt"),
    )


@query("f12_detector", f"with {EVIDENCE} select l_orderkey, l_linenumber, round(score, 6) score from scored")
def f12_detector(spark, sf_dir):
    return evidence(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(tx.detector_score(F.col("lp"), F.col("ent"), F.col("mar"), F.col("txt")), 6).alias("score"))


@query("k02_spans", f"""with {EVIDENCE}, s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(score, 6) score from scored where score > 0 qualify row_number() over (partition by l_orderkey order by round(score, 6) desc, l_linenumber, l_partkey, l_suppkey) <= 2)
select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc)::int place from s""")
def k02_spans(spark, sf_dir):
    """The two spans of highest priority of each text, from right to left."""
    at = ["l_linenumber", "l_partkey", "l_suppkey"]
    score = tx.detector_score(F.col("lp"), F.col("ent"), F.col("mar"), F.col("txt"))
    s = evidence(spark, sf_dir).select("l_orderkey", *at, F.round(score, 6).alias("score")).filter("score > 0")
    s = tk.top(s, ["l_orderkey"], [F.desc("score"), *map(F.col, at)], 2)
    return s.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*map(F.desc, at))))


@query("k03_top_tokens", f"with {EVIDENCE} select l_orderkey, l_linenumber, lp from ev qualify row_number() over (partition by l_orderkey order by lp desc, l_linenumber) <= 3")
def k03_top_tokens(spark, sf_dir):
    return tk.top(evidence(spark, sf_dir), ["l_orderkey"], [F.desc("lp"), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "lp")


@query("k07_evidence_limit", f"with {EVIDENCE} select l_orderkey, least(count(*), 4) kept, count(*) > 4 truncated from ev group by all")
def k07_evidence_limit(spark, sf_dir):
    """How much evidence of a text a limit of 4 keeps, and whether it cuts."""
    return evidence(spark, sf_dir).groupBy("l_orderkey").agg(F.least(F.count("*"), F.lit(4)).alias("kept"), (F.count("*") > 4).alias("truncated"))


@query("f13_logits", """with l as (select l_orderkey, list(l_quantity::double order by l_linenumber, l_partkey, l_suppkey, l_quantity) z from lineitem group by all), m as (select *, list_max(z) mx from l),
s as (select *, ln(list_sum(list_transform(z, lambda x: exp(x - mx)))) + mx lse from m)
select l_orderkey, round(list_max(z) - lse, 6) + 0e0 top_logprob, round(-list_sum(list_transform(z, lambda x: exp(x - lse) * (x - lse))), 6) + 0e0 entropy,
case when len(z) > 1 then list_reverse_sort(z)[1] - list_reverse_sort(z)[2] end margin from s""")
def f13_logits(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("z"))
    lp, entropy, margin = tk.logit_scores(F.transform("z", lambda x: x["l_quantity"].cast("double")))
    return l.select("l_orderkey", (F.round(lp, 6) + 0.0).alias("top_logprob"), (F.round(entropy, 6) + 0.0).alias("entropy"), margin.alias("margin"))


@query("f14_surface_scores", f"with {EVIDENCE} select l_orderkey, round(sum(lp), 6) total, round(avg(lp), 6) mean, min(lp) least from ev group by all")
def f14_surface_scores(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.sum("lp"), 6).alias("total"), F.round(F.avg("lp"), 6).alias("mean"), F.min("lp").alias("least"))


def _first(name: str, key: str) -> str:
    return f"(select * from {name} qualify row_number() over (partition by {key} order by ingested_at nulls last) = 1)"


@query("f15_finite", f"select turn_id, case when isfinite(start_sec) then start_sec end start_sec from {_first('turns', 'turn_id')}")
def f15_finite(spark, sf_dir):
    t = first_delivery(table(spark, sf_dir, "turns"), "turn_id", "ingested_at", ["start_sec"])
    return t.select("turn_id", tx.finite(F.col("start_sec")).alias("start_sec"))


@query("a11_known_sum", f"""select rec_id, case when bool_and(confidence is not null and isfinite(confidence)) then round(sum(confidence), 6) end total,
case when bool_and(confidence is not null and isfinite(confidence)) then max(confidence) end top from {_first('word_timings', 'word_id')} group by all""")
def a11_known_sum(spark, sf_dir):
    """Sum and greatest confidence of each recording's words, null where any is missing."""
    w = first_delivery(table(spark, sf_dir, "word_timings"), "word_id", "ingested_at", ["rec_id", "confidence"])
    return w.groupBy("rec_id").agg(F.round(tk.known(F.sum, F.col("confidence")), 6).alias("total"), tk.known(F.max, F.col("confidence")).alias("top"))


@query("a13_rollup", f"""with {SEG} select transcript_id, count(*) n_chunks, sum(len(coalesce(txt, ''))) n_chars, md5(string_agg(coalesce(txt, ''), ' ' order by pos)) digest, bool_and(conf is not null) complete, least(sum(coalesce(n_words, 0)), 20) n_evidence, sum(coalesce(n_words, 0)) > 20 truncated from segs group by all""")
def a13_rollup(spark, sf_dir):
    """Chunks to files: counts summed, text joined in order, evidence cut at a limit, completeness only if every chunk is complete."""
    return tk.rollup(segments(spark, sf_dir), "transcript_id", "pos", limit=20)


@query("a14_status", f"""with {EVIDENCE} select l_orderkey, case when count_if(ent > 4.5e0) > 0 then 'failed' when count_if(mar > 0.31e0) > 0 then 'disabled' when count_if(lp <= -1.5e0) > 0 then 'completed' else 'no_trigger' end status from ev group by all""")
def a14_status(spark, sf_dir):
    """The status of a whole from those of its parts, by precedence."""
    flags = [F.max(c) for c in (F.col("ent") > 4.5, F.col("mar") > 0.31, F.col("lp") <= -1.5)]
    status = F.when(flags[0], "failed").when(flags[1], "disabled").when(flags[2], "completed").otherwise("no_trigger")
    return evidence(spark, sf_dir).groupBy("l_orderkey").agg(status.alias("status"))


@query("a15_language", f"""with {SEG}, l as (select transcript_id, (generate_subscripts(segments, 1) - 1) pos, unnest(segments).lang lang from tr),
c as (select transcript_id, arg_min(lower(trim(lang)), pos) filter (trim(lang) <> '' and lower(trim(lang)) <> 'unknown') lang from l group by all),
h as (select rec_id, arg_min(lower(trim(language_hint)), request_id) forced from {_first('asr_requests', 'request_id')} where trim(language_hint) <> '' and rec_id is not null group by all)
select transcript_id, coalesce(forced, c.lang, 'unknown') lang from tr left join c using (transcript_id) left join h using (rec_id)""")
def a15_language(spark, sf_dir):
    """The language of each transcript: the one that the recording's first request forces, else the first known one of its chunks, else unknown."""
    t = first_delivery(table(spark, sf_dir, "transcripts").withColumn("langs", F.transform("segments", lambda s: F.lower(F.trim(s["lang"])))), "transcript_id", "ingested_at", ["rec_id", "langs"])
    r = first_delivery(table(spark, sf_dir, "asr_requests"), "request_id", "ingested_at", ["rec_id", "language_hint"]).filter("trim(language_hint) <> '' and rec_id is not null")
    forced = r.groupBy("rec_id").agg(F.min_by(F.lower(F.trim("language_hint")), "request_id").alias("forced"))
    return t.join(forced, "rec_id", "left").select("transcript_id", tk.output_language(F.col("forced"), F.col("langs")).alias("lang"))


@query("a24_token_overlap", f"""with {SEG}, p as (select transcript_id, pos, txt, lead(txt) over (partition by transcript_id order by pos) nx from segs), w as (select transcript_id, pos, list_distinct(list_filter(string_split(lower({squeeze_sql('txt')}), ' '), lambda x: x <> '')) a,
list_distinct(list_filter(string_split(lower({squeeze_sql('nx')}), ' '), lambda x: x <> '')) b from p where txt is not null and nx is not null)
select transcript_id, pos, case when len(list_distinct(list_concat(a, b))) = 0 then 1e0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end overlap from w""")
def a24_token_overlap(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("nx", F.lead("text").over(Window.partitionBy("transcript_id").orderBy("pos"))).filter("text is not null and nx is not null")
    return s.select("transcript_id", "pos", tx.token_overlap(F.col("text"), F.col("nx")).alias("overlap"))


WORDS = "w as (select word_id, rec_id, word, start_sec st, end_sec en from word_timings where start_sec is not null and not isnan(start_sec) qualify row_number() over (partition by word_id order by ingested_at nulls last) = 1)"


def words(spark, sf_dir):
    w = table(spark, sf_dir, "word_timings").filter(F.col("start_sec").isNotNull() & ~F.isnan("start_sec"))
    return first_delivery(w, "word_id", "ingested_at", ["rec_id", "word", "start_sec", "end_sec"]).select("word_id", "rec_id", "word", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"))


@query("r15_word_ends", f"""with {WORDS}, n as (select *, lead(st) over (partition by rec_id order by st, word_id) nx, case when word_id % 3 = 0 and isfinite(en) then en - st end dur from w)
select rec_id, word_id, case when dur is not null then st + greatest(dur, 0) when nx is not null then greatest(nx, st) else st end "end" from n where trim(word) <> ''""")
def r15_word_ends(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("dur", F.when(F.col("word_id") % 3 == 0, tx.finite(F.col("end")) - F.col("start")))
    return tk.word_ends(w).select("rec_id", "word_id", "end")


@query("r16_flips_smoothed", f"""with {WORDS}, k as (select *, (word_id % 4 % 3)::int sp from w), n as (select *, lag(sp) over x a, lead(sp) over x b from k window x as (partition by rec_id order by st, word_id))
select rec_id, word_id, case when a = b and a <> sp then a else sp end speaker from n""")
def r16_flips_smoothed(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("speaker", (F.col("word_id") % 4 % 3).cast("int"))
    return tk.smooth_flips(w).select("rec_id", "word_id", "speaker")


@query("r17_rebuilt_turns", f"""with {WORDS}, k as (select *, (word_id // 3 % 4 - 1)::int sp from w where word is not null), f as (select * from k where sp >= 0),
n as (select *, coalesce(sp = lag(sp) over x and st - round(lag(st) over x + 0.25e0, 3) <= 2, false) joins from f window x as (partition by rec_id order by st, word_id)),
g as (select *, sum((not joins)::int) over (partition by rec_id order by st, word_id rows unbounded preceding) run from n)
select rec_id, any_value(sp) speaker, round(min(st), 3) "start", round(max(st) + 0.25e0, 3) "end", string_agg(word, '' order by st, word_id) txt from g group by rec_id, run""")
def r17_rebuilt_turns(spark, sf_dir):
    w = words(spark, sf_dir).filter("word is not null").withColumn("speaker", (F.floor(F.col("word_id") / 3) % 4 - 1).cast("int"))
    return tk.rebuild_turns(w, 2.0, 0.25)


@query("r18_paragraphs", f"""with {SEG}, n as (select *, coalesce(sp is not distinct from lag(sp) over (partition by transcript_id order by pos) and pos > 0, false) joins from segs),
g as (select *, (sum((not joins)::int) over (partition by transcript_id order by pos rows unbounded preceding) - 1)::int pi from n)
select transcript_id, pos, 'p' || pi || 's' || (row_number() over (partition by transcript_id, pi order by pos) - 1) sid from g""")
def r18_paragraphs(spark, sf_dir):
    return tk.paragraphs(segments(spark, sf_dir)).select("transcript_id", "pos", "sid")


@query("r19_synthetic_times", "select event_id, epoch_us(ts) / 1000000e0 - min(epoch_us(ts)) over (partition by user_id) / 1000000e0 start_sec, value * 1000 / (16000 * 2) duration_sec from events")
def r19_synthetic_times(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("us", us)
    first = e.groupBy("user_id").agg(F.min("us").alias("first"))
    return e.join(first, "user_id").select("event_id", (F.col("us") / 1e6 - F.col("first") / 1e6).alias("start_sec"), (F.col("value") * 1000 / (16000 * 2)).alias("duration_sec"))


@query("c03_clamped", f"with {SEG} select transcript_id, pos, row_number() over (partition by transcript_id order by st, pos)::int place, greatest(en, st) \"end\" from segs where isfinite(st) and isfinite(en)")
def c03_clamped(spark, sf_dir):
    """Segments in time order, no end before its start."""
    s = segments(spark, sf_dir).filter(tx.finite(F.col("start")).isNotNull() & tx.finite(F.col("end")).isNotNull())
    return s.select("transcript_id", "pos", F.row_number().over(Window.partitionBy("transcript_id").orderBy("start", "pos")).alias("place"), F.greatest("end", "start").alias("end"))


@query("c04_duration", f"with {SEG}, m as (select transcript_id, max(case when isfinite(en) then en end) top from segs group by all) select transcript_id, coalesce(case when isfinite(media.duration_seconds) then media.duration_seconds end, top) duration from tr left join m using (transcript_id)")
def c04_duration(spark, sf_dir):
    t = table(spark, sf_dir, "transcripts").select("transcript_id", "ingested_at", F.coalesce(tx.finite(F.col("media.duration_seconds")), F.array_max(F.transform("segments", lambda s: tx.finite(s["end_sec"])))).alias("duration"))
    return first_delivery(t, "transcript_id", "ingested_at", ["duration"]).drop("ingested_at")


@query("c05_pseudo_words", f"with {SEG} select transcript_id, pos, case when coalesce(n_words, 0) > 0 then n_words else 1 end n, coalesce(n_words, 0) = 0 pseudo from segs")
def c05_pseudo_words(spark, sf_dir):
    """Words of each segment; one word that is the whole text where there are none."""
    t = table(spark, sf_dir, "transcripts")
    w = F.transform("segments", lambda s: F.struct(F.size(F.when(F.size(s["words"]) > 0, s["words"]).otherwise(F.array(F.struct(s["text"].alias("word"), s["start_sec"].alias("start_sec"), s["end_sec"].alias("end_sec"), s["confidence"].alias("confidence"))))).alias("n"), (~F.coalesce(F.size(s["words"]) > 0, F.lit(False))).alias("pseudo")))
    t = first_delivery(t.withColumn("w", w), "transcript_id", "ingested_at", ["w"])
    return t.select("transcript_id", F.posexplode("w")).select("transcript_id", "pos", "col.n", "col.pseudo")


@query("c06_translations", f"with {SEG}, m as (select transcript_id, pos, unnest(map_entries(g.translations)) e from seg) select transcript_id, pos, e.key lang, e.value sentence from m")
def c06_translations(spark, sf_dir):
    t = table(spark, sf_dir, "transcripts").withColumn("x", F.transform("segments", lambda s: F.map_entries(s["translations"])))
    t = first_delivery(t, "transcript_id", "ingested_at", ["x"]).select("transcript_id", F.posexplode("x"))
    return t.select("transcript_id", "pos", F.explode("col").alias("e")).select("transcript_id", "pos", F.col("e.key").alias("lang"), F.col("e.value").alias("sentence"))


@query("j04_display_names", f"""with {SEG}, d as (select transcript_id, unnest(speakers) s from tr), n as (select transcript_id, s.id id, any_value(s.display_name) dn from d group by all)
select segs.transcript_id, pos, coalesce(dn, sp) shown from segs left join n on n.transcript_id = segs.transcript_id and n.id = sp""")
def j04_display_names(spark, sf_dir):
    t = first_delivery(table(spark, sf_dir, "transcripts"), "transcript_id", "ingested_at", ["speakers"])
    names = t.select("transcript_id", F.inline("speakers")).groupBy("transcript_id", F.col("id").alias("speaker")).agg(F.any_value("display_name", True).alias("dn"))
    return segments(spark, sf_dir).join(names, ["transcript_id", "speaker"], "left").select("transcript_id", "pos", F.coalesce("dn", "speaker").alias("shown"))


@query("s19_violations", f"""with {SEG}, v as (select transcript_id, pos, unnest([case when st < 0 then 'start below 0' end, case when en < 0 then 'end below 0' end, case when st is null then 'start missing' end, case when txt is null then 'text missing' end, case when conf < 0 or conf > 1 then 'confidence outside 0..1' end, case when sp = '' then 'speaker empty' end]) m from segs)
select transcript_id, pos, m violation from v where m is not null""")
def s19_violations(spark, sf_dir):
    """Every violation of the segment rules, as path and message."""
    c = F.col
    rules = [
        (c("start") < 0, "start below 0"), (c("end") < 0, "end below 0"), (c("start").isNull(), "start missing"), (c("text").isNull(), "text missing"),
        ((c("confidence") < 0) | (c("confidence") > 1), "confidence outside 0..1"), (c("speaker") == "", "speaker empty"),
    ]
    return tk.violations(segments(spark, sf_dir), rules).select("transcript_id", "pos", "violation")


@query("c01_discriminator", "select transcript_id, ingested_at, coalesce(regexp_matches(schema_tag, '^[a-z]+-transcript[.]v1$'), false) accepted from transcripts")
def c01_discriminator(spark, sf_dir):
    return table(spark, sf_dir, "transcripts").select("transcript_id", "ingested_at", F.coalesce(F.col("schema_tag").rlike(r"^[a-z]+-transcript\.v1$"), F.lit(False)).alias("accepted"))


@query("a28_majority", "with c as (select rec_id, lang, count(*) n, min(request_id) f from (select rec_id, request_id, language_hint lang from asr_requests where language_hint is not null and rec_id is not null) group by all) select rec_id, arg_max(lang, (n, -f)) lang from c group by all")
def a28_majority(spark, sf_dir):
    """The most frequent language of a recording's requests, the first seen of equals."""
    r = table(spark, sf_dir, "asr_requests").filter("language_hint is not null and rec_id is not null")
    return tk.first_seen_mode(r, ["rec_id"], "language_hint", "request_id").select("rec_id", F.col("mode").alias("lang"))


@query("a25_mode", "with c as (select l_suppkey, l_partkey % 5 v, count(*) n, min(struct_pack(a := l_orderkey, b := l_linenumber)) f from lineitem group by all) select l_suppkey, v from c qualify row_number() over (partition by l_suppkey order by n desc, f) = 1")
def a25_mode(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 5).alias("v"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    return tk.first_seen_mode(l, ["l_suppkey"], "v", "at").select("l_suppkey", F.col("mode").alias("v"))


@query("f34_finish_reason", "select l_orderkey, l_linenumber, case when l_returnflag = 'A' then 'eos' when l_quantity > 45 then 'length' when l_linestatus = 'O' then 'repetition' end reason from lineitem")
def f34_finish_reason(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tk.finish_reason(F.col("l_returnflag") == "A", F.col("l_quantity") > 45, F.col("l_linestatus") == "O").alias("reason"))


@query("f35_deltas", "select c_custkey, greatest(c_acctbal - 1000, 0) * 1000 ms from customer")
def f35_deltas(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (F.greatest(F.col("c_acctbal") - 1000, F.lit(0)) * 1000).alias("ms"))


@query("f36_speaker_number", f"with {SEG} select transcript_id, pos, try_cast(nullif(regexp_extract(sp, '([0-9]+)', 1), '') as bigint) k from segs")
def f36_speaker_number(spark, sf_dir):
    return segments(spark, sf_dir).select("transcript_id", "pos", tx.first_number(F.col("speaker")).alias("k"))


@query("j11_dictionary", """with h as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) rnk, lower(o_orderpriority) || ' ' || o_orderstatus k from orders), t as (select distinct lower(o_orderpriority) term from orders)
select o_custkey, term, min(rnk)::int beam_rank from h join t on h.k = term or starts_with(h.k, term || ' ') group by all""")
def j11_dictionary(spark, sf_dir):
    """Dictionary terms against the hypotheses of each text: the rank of the first that is the term or begins with it as a word."""
    o = table(spark, sf_dir, "orders")
    h = o.select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rnk"), F.concat_ws(" ", F.lower("o_orderpriority"), "o_orderstatus").alias("k"))
    t = o.select(F.lower("o_orderpriority").alias("term")).distinct()
    return tk.dictionary_ranks(h, t, ["o_custkey"], "k", "rnk", "term")


@query("r21_term_budget")
def r21_term_budget(spark, sf_dir):
    """The terms of each part size that fit the budget of 12 terms, 8 characters each and 60 in all."""
    p = table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_name")
    return tk.term_budget(p, "p_size", "p_partkey", "p_name", 12, 8, 60)
