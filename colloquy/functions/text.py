"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tags that a recogniser writes into its text.
TAGS = ["<|zh|>", "<|en|>", "<|yue|>", "<|ja|>", "<|ko|>", "<|nospeech|>", "<|EMO_UNKNOWN|>", "<|Event_UNK|>", "<|woitn|>", "<|withitn|>"]
# The names under which each engine is known.
ENGINES = {
    "sensevoice": ["sensevoice", "sensevoice_sherpa", "sherpa", "local_sensevoice"],
    "whisper": ["whisper", "local_whisper"],
    "qwen": ["qwen", "qwen3_asr", "qwen3-asr", "local_qwen"],
    "paraformer": ["paraformer", "paraformer_offline", "paraformer-offline", "funasr"],
    "speech": ["speech", "macos_speech", "apple"],
    "openai_audio": ["openai_audio", "openai", "http", "cloud", "qwen_asr", "qwen-asr", "qwen_asr_0.8b"],
}
# Locales whose language the first engine knows.
KNOWN_LANGUAGES = ["zh", "yue", "ja", "ko", "en"]


def squeeze(c: Column) -> Column:
    """Any white space, Unicode's included, as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalize_text(c: Column) -> Column:
    return F.lower(squeeze(c))


@F.arrow_udf(T.StringType())
def _casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], type=pa.string())


def surface_key(c: Column) -> Column:
    """Squeezed and case-folded; only text beyond ASCII leaves the JVM for it."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, normalize_text(c)).otherwise(squeeze(_casefold(c)))


def strip_tags(c: Column) -> Column:
    return squeeze(reduce(lambda x, tag: F.replace(x, F.lit(tag), F.lit("")), TAGS, c))


def collapse_blank_lines(c: Column) -> Column:
    """Lines trimmed at their ends; runs of blank lines become one; none at the beginning or end."""
    lines = F.regexp_replace(c, r"(?m)[ \t\r]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def split_confidence(c: Column) -> tuple[Column, Column]:
    """Text and confidence of what is written as text, a line of three dashes, number; the last such line counts."""
    mark = "\n---\n"
    tail = F.substring_index(c, mark, -1)
    has = F.contains(c, F.lit(mark))
    value = F.when(has, tail.try_cast("double"))
    return F.when(has, F.left(c, F.char_length(c) - F.char_length(tail) - len(mark))).otherwise(c), value


def primary_language(locale: Column) -> Column:
    return F.lower(F.element_at(F.split(locale, "[-_]"), 1))


def known_language(locale: Column) -> Column:
    p = primary_language(locale)
    return F.when(p.isin(KNOWN_LANGUAGES), p).otherwise("auto")


def engine_of(name: Column) -> Column:
    key = F.lower(F.trim(name))
    return F.coalesce(*[F.when(key.isin(names), engine) for engine, names in ENGINES.items()])


def http_label(base: Column, model: Column) -> Column:
    return F.when(F.contains(F.lower(base), F.lit("dashscope")) | F.contains(F.lower(model), F.lit("qwen")), "qwen_asr").otherwise("openai_audio")


def model_identity(path: Column) -> tuple[Column, Column]:
    """Name and revision of a model by its path; of a snapshot directory the owner's name, with its hash as the revision."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    leaf, up, top = (F.try_element_at(parts, F.lit(-k)) for k in (1, 2, 3))
    snapshot = F.coalesce(up == "snapshots", F.lit(False))
    name = F.replace(F.regexp_replace(top, "^(models--)+", ""), F.lit("--"), F.lit("/"))
    return F.when(snapshot, name).otherwise(leaf), F.when(snapshot, leaf)


def uppercase_run(c: Column) -> Column:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return F.coalesce((F.char_length(letters) >= 2) & letters.rlike("^[A-Z]+$"), F.lit(False))


def mixed_script(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\x{3400}-\x{9fff}]") & c.rlike("[A-Za-z]"), F.lit(False))


def detector_score(logprob: Column, entropy: Column, margin: Column, text: Column) -> Column:
    parts = [
        F.when(logprob <= -1.5, F.least(-logprob, F.lit(8.0)) + 4.0), F.when(entropy >= 2.5, F.least(entropy, F.lit(8.0)) / 8.0 + 3.0), F.when(margin <= 0.2, 1.0),
        F.when(uppercase_run(text), 2.0), F.when(mixed_script(text), 2.5),
    ]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of the lower-cased words of two texts; 1 where neither has any."""
    words = lambda c: F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda w: w != ""))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def first_number(label: Column) -> Column:
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("long")
