"""Operators over tokens, words, segments and their evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.scan import neighbours, running


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; the planner limits each group before and after the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def known(how: Callable[[Column], Column], c: Column) -> Column:
    """An aggregate that is null where any value is null or not finite."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(F.count("*") == F.count(F.when(ok, 1)), how(c))


def output_language(forced: Column, chunks: Column) -> Column:
    """The forced language, else the first of the chunks' (an array in order) that is known, else ``unknown``."""
    known = F.filter(chunks, lambda c: c.isNotNull() & (c != "") & (c != "unknown"))
    return F.coalesce(forced, F.try_element_at(known, F.lit(1)), F.lit("unknown"))


def logit_scores(z: Column) -> tuple[Column, Column, Column]:
    """Log-probability of the greatest logit, entropy of the distribution, and the margin of the greatest over the second."""
    most = F.array_max(z)
    lse = F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - most))) + most
    entropy = -F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - lse) * (x - lse))
    ranked = F.sort_array(z, False)
    return most - lse, entropy, F.when(F.size(z) > 1, F.element_at(ranked, 1) - F.try_element_at(ranked, F.lit(2)))


def rollup(segments: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")
    n = F.sum(F.greatest(F.coalesce("n_words", F.lit(0)), F.lit(0)))
    return segments.groupBy(key).agg(
        F.count("*").alias("n_chunks"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.md5(joined).alias("digest"),
        F.every(F.col("confidence").isNotNull()).alias("complete"), F.least(n, F.lit(limit)).alias("n_evidence"), (n > limit).alias("truncated"),
    )


def word_ends(w: DataFrame) -> DataFrame:
    """The end of each word: its start and duration (none below 0), else the next start (not before its own), else its start. Blank words
    are dropped after that. w: rec_id, word_id, word, start, dur."""
    w = neighbours(w, ["rec_id"], "start", ["start", "word_id"], after={"nx": "start"}).drop("end")
    end = F.coalesce(F.when(F.col("dur").isNotNull(), F.col("start") + F.greatest(F.col("dur"), F.lit(0.0))), F.when(F.col("nx").isNotNull(), F.greatest("nx", "start")), F.col("start"))
    return w.withColumn("end", end).filter(F.trim("word") != "")


def smooth_flips(w: DataFrame) -> DataFrame:
    """A label that differs from two equal neighbours takes theirs; neighbours as they were before."""
    w = neighbours(w, ["rec_id"], "start", ["start", "word_id"], before={"a": "speaker"}, after={"b": "speaker"})
    return w.withColumn("speaker", F.when((F.col("a") == F.col("b")) & (F.col("a") != F.col("speaker")), F.col("a")).otherwise(F.col("speaker"))).drop("a", "b")


def rebuild_turns(w: DataFrame, gap: float, tail: float) -> DataFrame:
    """Turns of consecutive tokens of one speaker (below 0 none) whose starts lie within ``gap`` of the turn's end so far, text joined."""
    w = neighbours(w.filter("speaker >= 0"), ["rec_id"], "start", ["start", "word_id"], before={"s0": "speaker", "t0": "start"})
    joins = F.coalesce((F.col("s0") == F.col("speaker")) & (F.col("start") - F.round(F.col("t0") + tail, 3) <= gap), F.lit(False))
    w = running(w.withColumn("fresh", F.when(joins, 0).otherwise(1)), ["rec_id"], "start", ["start", "word_id"], {"run": ("sum", F.col("fresh"))}, inclusive=True)
    ordered = F.array_sort(F.collect_list(F.struct("start", "word_id", "word")))
    return w.groupBy("rec_id", "run").agg(
        F.first("speaker").alias("speaker"), F.round(F.min("start"), 3).alias("start"), F.round(F.max("start") + tail, 3).alias("end"), F.array_join(F.transform(ordered, lambda x: x["word"]), "").alias("txt")
    ).drop("run")


def paragraphs(segments: DataFrame) -> DataFrame:
    """Consecutive segments of one speaker are a paragraph; sid names the paragraph and the sentence in it."""
    w = Window.partitionBy("transcript_id").orderBy("pos")
    joins = (F.lag("pos").over(w).isNotNull()) & F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))
    s = segments.withColumn("pi", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return s.withColumn("sid", F.concat(F.lit("p"), "pi", F.lit("s"), F.row_number().over(Window.partitionBy("transcript_id", "pi").orderBy("pos")) - 1))


def violations(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    return df.withColumn("violation", F.explode(F.filter(F.array(*[F.when(c, m) for c, m in rules]), lambda m: m.isNotNull())))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """keys..., mode: the most frequent value, the first seen of equals."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(at).alias("f"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), "f")).alias("mode"))


def finish_reason(eos: Column, length: Column, repetition: Column) -> Column:
    return F.when(eos, "eos").when(length, "length").when(repetition, "repetition")


def dictionary_ranks(hypotheses: DataFrame, terms: DataFrame, keys: list[str], text: str, rank: str, term: str) -> DataFrame:
    """keys..., term, beam_rank. Each hypothesis offers its leading words, so the terms are found by an equality join."""
    words = F.split(text, " ")
    heads = hypotheses.select(*keys, rank, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias(term))
    return heads.join(terms, term).groupBy(*keys, term).agg(F.min(rank).alias("beam_rank"))


def term_budget(df: DataFrame, key: str, order: str, term: str, most: int, longest: int, chars: int) -> DataFrame:
    """key, term_no, term: in order, each term trimmed and cut to ``longest``, until ``most`` terms or ``chars`` characters are taken; what
    the rest of the budget cuts is compared with the terms taken, so the walk is sequential, one key's kept terms in memory."""
    schema = pa.schema([(key, pa.string()), ("term_no", pa.int32()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, used = None, [], 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != at:
                    at, kept, used = k, [], 0
                if len(kept) >= most or used >= chars or t is None:
                    continue
                t = t.strip()[:longest][: chars - used]
                if t and t not in kept:
                    kept.append(t)
                    used += len(t)
                    out.append((k, len(kept) - 1, t))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(zip(*out), schema.types)], schema=schema)

    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(term).alias("t"))
    return rows.repartition("k").sortWithinPartitions("k", "o").select("k", "t").mapInArrow(run, f"`{key}` string, term_no int, term string")
