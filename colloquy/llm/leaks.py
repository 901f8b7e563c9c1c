"""Evaluation texts that leaked into a corpus.

A test item leaks where ``window`` consecutive words of it stand in a document within ``budget`` word edits. By the pigeonhole
principle, one of budget + 1 pieces of such a window then stands there unchanged: the pieces of all windows go into one
automaton, each document's words are run through it once, and every hit is verified with Myers' bit-parallel edit distance
over words, the window against the words around the hit.

Words are runs of letters and digits in lower case; names of markup commands are none, their arguments are.

Defined results: null or wordless texts and items shorter than the window have no leaks; null ids are left out; a pair comes out
once however often its rows repeat; an empty table on either side gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrow import spread

WINDOW = 12
BUDGET = 1
BLOCK_ITEMS = 20_000  # items of one automaton; the bound of what is collected and broadcast at a time
BLOCK_CHARS = 8_000_000


def words_of(text: Column) -> Column:
    """The words of a text, each between single spaces, with a space at both ends."""
    plain = F.regexp_replace(F.lower(text), r"\\(?:[a-z]+|(?s:.))", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{Nd}]+", " ")), F.lit(" "))


def pieces(window: int, budget: int) -> list[tuple[int, int]]:
    """From and to of each of the budget + 1 pieces of a window."""
    cuts = [window * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of the pattern to any stretch of the text, a column of the matrix as two bit vectors."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        d0 = ((((eq & pv) + pv) ^ pv) | eq | mv) & full
        hp, hn = mv | (~(d0 | pv) & full), pv & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1, hn << 1
        pv, mv = (hn | ~(d0 | hp)) & full, hp & d0 & full
        best = min(best, score)
    return best


class Matcher:
    """The pieces of the windows of some items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int):
        self.window, self.budget = window, budget
        self.items = [(i, t.split()) for i, t in items]
        at: dict[str, list[tuple[int, int, int]]] = {}
        for n, (_, words) in enumerate(self.items):
            for s in range(len(words) - window + 1):
                for a, b in pieces(window, budget):
                    at.setdefault(f" {' '.join(words[s + a : s + b])} ", []).append((n, s, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def find(self, text: str) -> dict[tuple[int, int], int]:
        """Distance of each window (item number, first word) that the text holds within the budget."""
        out: dict[tuple[int, int], int] = {}
        if self.empty:
            return out
        words = spaces = None
        tried: set[tuple[int, int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            if words is None:
                words = text.split()
                spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 32)
            p = int(np.searchsorted(spaces, end - size + 1))  # the word that the piece begins with
            for n, s, a in places:
                if (n, s, p - a) in tried:
                    continue
                tried.add((n, s, p - a))
                begin = max(0, p - a - self.budget)
                around = words[begin : p - a + self.window + self.budget]
                d = myers(self.items[n][1][s : s + self.window], around)
                if d <= self.budget:
                    out[n, s] = min(d, out.get((n, s), d))
        return out


def leaked_windows(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """doc_id, item_id, n_windows (windows of the item found), n_exact (of these, unchanged) and distance (the least).

    The items are the stated query set: they are taken in blocks of at most BLOCK_ITEMS items and about BLOCK_CHARS characters,
    each collected, put into one automaton and broadcast for a pass over all documents.
    """
    if not 1 <= budget + 1 <= window:
        raise ValueError("a window needs a word for each piece")
    items = items.select(F.col(item).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("words"))
    items = items.filter(F.col("item_id").isNotNull() & (F.size(F.split(F.trim("words"), " ")) >= window))
    docs = spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("words")))
    docs = docs.withColumn("words", words_of(F.col("words"))).filter(F.col("doc_id").isNotNull() & (F.length("words") > 2 * window))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    blocks = max(1, -(-n // (BLOCK_ITEMS // 2)), -(-chars // (BLOCK_CHARS // 2)))
    schema = "doc_id long, item_id long, n_windows int, n_exact int, distance int"
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int32()), ("n_exact", pa.int32()), ("distance", pa.int32())])
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b)
        shared = docs.sparkSession.sparkContext.broadcast(sorted({(r.item_id, r.words.strip()) for r in part.collect()}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, window, budget)
            for batch in batches:
                rows: list[tuple[int, int, int, int, int]] = []
                for d, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                    by: dict[int, list[int]] = {}
                    for (n, _), distance in matcher.find(words.as_py()).items():
                        by.setdefault(matcher.items[n][0], []).append(distance)
                    rows += [(d, i, len(x), x.count(0), min(x)) for i, x in by.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(map(list, zip(*rows)), kind.types)], schema=kind)

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_exact").alias("n_exact"), F.min("distance").alias("distance"))


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id where at least ``window`` consecutive words of the item stand in the document unchanged."""
    return leaked_windows(docs, items, **options).filter("n_exact > 0").select("doc_id", "item_id")
