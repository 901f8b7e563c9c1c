"""Long exact spans shared between records.

Anchors route the work: of every ``min_len - gram + 1`` neighbouring grams of a text the one with the least hash is an anchor
(winnowing), so two texts that share ``min_len`` characters share an anchor inside them. Around an anchor that stands in
several texts with different surroundings lies a *region*, long enough to hold every shared stretch of ``min_len`` that
contains the anchor and one character more on each side, in which the texts differ at the stretch's end, or one of them ends; where two different texts share a stretch, the anchor nearest to the stretch's end has such regions. The
regions of an anchor meet in one shard, where they are put into an FM-index (:mod:`.fmindex`) and are streamed through it
again: backward search gives the matching statistics, and matches of at least ``min_len`` are the links.

An anchor with more than ``HOT`` regions, such as a phrase of a form, is refined before it is searched: its regions get anchors of their
own, whose grams are only ``FINE`` characters short of ``min_len``, so that only regions which share nearly a whole stretch stay together; what is
still large then is dealt out in pairs of blocks, each pair a group of its own. No task holds more than a block beside its block.

Two results come of the search. ``shared_pairs``: Exact copies of a whole text are one class, and only its representative (the least id) is searched. Up to
``COPIES_MOST`` members a class is written out in pairs; a larger one is given as pairs of its representative with each member, and its links to other
texts as links of the representative; ``copy_classes`` has the members and their number. Different texts that share a stretch are given in all
their pairs, however many they are, unless the caller names an ``expand``: then classes, and stretches, of more than so many texts are given by their
least id. ``shared_intervals``: of each record the maximal intervals covered by stretches that stand elsewhere. There the regions that an anchor has in common
count whole, the matches of different ones from their matching statistics, and copies from end to end.

Defined results: null texts and texts under ``min_len`` characters have no links; a null id is left out; rows that repeat an id
(and its text) count once in the output; an empty table gives an empty table. Length is in code points.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import code_points, slices_by_bytes, spread
from colloquy.llm.fmindex import FMIndex

GRAM = 128
SLICE_BYTES = 1 << 18
SEEN_MOST = 100_000
BLOCK = 400_000
COPIES_MOST = 64
PAIRS_AT_ONCE = 1 << 20
HOT = 1000
FINE = 10
BLOCK_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.uint64(_BASE if which == "up" else _INVERSE)
        grown = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        grown[0] = 1
        _powers[which] = have = np.multiply.accumulate(grown)
    return have[:n]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + w]."""
    span = 1
    while span * 2 <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(flat: np.ndarray, off: np.ndarray, min_len: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, place, hash of the gram, hash of the region, and the region's begin and end, of every anchor of the texts."""
    n, w = len(flat), min_len - gram + 1
    none = np.zeros(0, np.int64)
    nothing = (none, none, none.astype(np.uint64), none.astype(np.uint64), none, none)
    if n < min_len:
        return nothing
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xC2B2AE3D27D4EB4F) * _power("up", n), out=total[1:])
    h = _scramble((total[gram:] - total[:-gram]) * _power("down", n - gram + 1))
    low = _slide(h, w, np.minimum)  # low[i]: over the grams of flat[i : i + min_len]
    lens = np.diff(off)
    last = np.repeat(off[1:], lens)[: len(low)] - min_len  # the last window that ends within its text
    low[np.arange(len(low)) > last] = 0
    edge = np.zeros(w - 1, dtype=np.uint64)
    chosen = _slide(np.concatenate([edge, low, edge]), w, np.maximum) == h
    at = np.flatnonzero(chosen & (h != 0))
    if not len(at):
        return nothing
    # in a run of one repeated gram the first, the last and every w-th are enough
    same_left = np.zeros(len(at), bool)
    same_left[1:] = (at[1:] == at[:-1] + 1) & (h[at[1:]] == h[at[:-1]])
    same_right = np.append(same_left[1:], False)
    first = np.maximum.accumulate(np.where(same_left, 0, np.arange(len(at))))
    at = at[~(same_left & same_right) | ((np.arange(len(at)) - first) % w == 0)]
    doc = np.searchsorted(off, at, side="right") - 1
    begin, end = np.maximum(at + gram - min_len - 1, off[doc]), np.minimum(at + min_len + 1, off[doc + 1])
    around = (total[end] - total[begin]) * _power("down", n + 1)[begin]
    around = _scramble(around + (end - begin).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + (at - begin).astype(np.uint64))
    return doc, at - off[doc], h[at], around, begin - off[doc], end - off[doc]


def _anchor_rows(min_len: int, gram: int):
    kind = pa.schema([("fp", pa.int64()), ("around", pa.int64()), ("doc", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, None] = OrderedDict()  # copies within a task are left to the classes of copies
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in slices_by_bytes(texts, SLICE_BYTES):
                keep, bodies = [], []
                for r, t in zip(range(i, j), texts.slice(i, j - i).to_pylist()):
                    key = xxhash.xxh3_128_digest(t)
                    if key in seen:
                        continue
                    seen[key] = None
                    if len(seen) > SEEN_MOST:
                        seen.popitem(last=False)
                    keep.append(r)
                    bodies.append(t)
                if not bodies:
                    continue
                flat, off = code_points(bodies)
                doc, _, fp, around, begin, end = anchors(flat, off, min_len, gram)
                own = np.asarray(ids.take(pa.array(keep)))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(around.view(np.int64)), pa.array(own[doc]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], schema=kind)

    return run


_REGION = pa.schema([("fp", pa.int64()), ("doc", pa.int64()), ("begin", pa.int32()), ("region", pa.string())])
_REGION_SHAPE = "fp long, doc long, begin int, region string"


def _refine(min_len: int, gram: int):
    """Regions (fp, doc, begin, region) to the smaller regions around the anchors of longer grams in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices_by_bytes(batch.column(3), SLICE_BYTES):
                fp, doc, at = (np.asarray(batch.column(k).slice(i, j - i)) for k in range(3))
                texts = batch.column(3).slice(i, j - i).to_pylist()
                row, _, h, _, begin, end = anchors(*code_points(texts), min_len, gram)
                if len(row):
                    key = _scramble(h ^ fp[row].view(np.uint64))
                    parts = [texts[r][x:y] for r, x, y in zip(row.tolist(), begin.tolist(), end.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[row]), pa.array((at[row] + begin).astype(np.int32)), pa.array(parts)], schema=_REGION)

    return run


def _block_pairs(texts: list[np.ndarray], region: np.ndarray, doc: np.ndarray, stream: list[int], min_len: int, expand: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one index block, in parts. region[i], doc[i]: which documents hold which region; stream: the regions searched for."""
    index = FMIndex(texts)
    hit, _, _, at = index.matching_statistics([texts[i] for i in stream], np.array(stream, dtype=np.int64), min_len)
    if not len(hit):
        return
    stretch = index.runs(min_len)[at]
    seen = np.unique(np.stack([stretch, np.asarray(stream)[hit]]), axis=1)
    order = np.argsort(region, kind="stable")
    first = np.searchsorted(region[order], np.arange(len(texts) + 1))
    count = (first[1:] - first[:-1])[seen[1]]
    rows = np.repeat(first[seen[1]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    members = np.unique(np.stack([np.repeat(seen[0], count), doc[order][rows]]), axis=1)
    if expand is None:
        yield from every_pair(members[0], members[1])
    else:
        yield linked(members[0], members[1], expand)


def every_pair(group: np.ndarray, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the members of each group (sorted by group, member), each pair once. They are made member by member, so that about
    ``PAIRS_AT_ONCE`` are held, or those of one member, whatever the size of a group."""
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    alike: dict[bytes, int] = {}  # neighbouring stretches stand in the same texts
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        alike.setdefault(xxhash.xxh3_128_digest(np.ascontiguousarray(member[i:j])), k)
    kept = np.array(sorted(alike.values()), dtype=np.int64)
    first, last = edges[kept], edges[kept + 1]
    size = last - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    after = np.repeat(last, size) - at - 1  # the later members of the group
    order = np.argsort(member[at], kind="stable")
    at, after = at[order], after[order]
    total = np.cumsum(after)
    ends = np.append(np.flatnonzero(np.diff(member[at])) + 1, len(at))  # whole members only
    i = 0
    while i < len(at):
        done = total[i - 1] if i else 0
        fit = ends[(ends > i) & (total[ends - 1] - done <= PAIRS_AT_ONCE)]
        j = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, i, side="right")])
        n = after[i:j]
        right = np.repeat(at[i:j] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.unique(np.stack([np.repeat(member[at[i:j]], n), member[right]]), axis=1)
        if pair.shape[1]:
            yield pair[0], pair[1]
        i = j


def linked(group: np.ndarray, member: np.ndarray, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the members of each group (sorted by group, member); a group over ``expand`` gives pairs with its least member."""
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    size = np.diff(edges)
    start = np.repeat(edges[:-1], size)
    left, right = [member[start]], [member]
    for d in range(1, min(int(size.max(initial=0)), expand)):
        small = np.flatnonzero(np.repeat(size <= expand, size))
        small = small[small - d > start[small]]
        left.append(member[small - d])
        right.append(member[small])
    a, b = np.concatenate(left), np.concatenate(right)
    ok = a < b
    pair = np.unique(np.stack([a[ok], b[ok]]), axis=1)
    return pair[0], pair[1]


def _block_spans(texts: list[np.ndarray], region: np.ndarray, doc: np.ndarray, begin: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, from, to of the matches with a region of another document in one index block, those of a region joined where they meet. Regions of several
    documents are shared whole and not searched."""
    first = np.full(len(texts), np.iinfo(np.int64).max)
    last = np.full(len(texts), np.iinfo(np.int64).min)
    np.minimum.at(first, region, doc)
    np.maximum.at(last, region, doc)
    alone = first == last
    _, code = np.unique(doc, return_inverse=True)
    owners = np.arange(len(texts)) + len(doc)  # of a text with several documents: nobody's
    owners[region[alone[region]]] = code[alone[region]]
    stream = np.flatnonzero(alone)
    hit, at, length, _ = FMIndex(texts, owners).matching_statistics([texts[i] for i in stream], owners[stream], min_len)
    hit = stream[hit]
    whole = np.flatnonzero(~alone & (np.array([len(t) for t in texts]) >= min_len))
    hit, at, length = np.concatenate([hit, whole]), np.concatenate([at, whole * 0]), np.concatenate([length, np.array([len(texts[i]) for i in whole], dtype=np.int64)])
    order = np.lexsort((at, hit))
    r, a, b = joined(hit[order], at[order], at[order] + length[order])
    rows = np.argsort(region, kind="stable")
    first = np.searchsorted(region[rows], np.arange(len(texts) + 1))
    count = (first[1:] - first[:-1])[r]
    own = rows[np.repeat(first[r] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    return doc[own], begin[own] + np.repeat(a, count), begin[own] + np.repeat(b, count)


def joined(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of the intervals [a, b) of each key that overlap or touch; they are sorted by key, a."""
    if not len(key):
        return key, a, b
    code = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    top = np.maximum.accumulate(b + code * (int(b.max()) + 1)) - code * (int(b.max()) + 1)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (a[1:] > top[:-1])
    at = np.flatnonzero(fresh)
    return key[at], a[at], top[np.append(at[1:], len(key)) - 1]


def _search(min_len: int, expand: int | None, spans: bool = False):
    """Of regions (fp, doc, begin, region) sorted by fp the pairs of documents, or with ``spans`` the shared intervals. Blocks are filled with whole
    anchors; an anchor that is larger than a block is indexed in blocks and streamed through each."""
    kind = pa.schema([("doc", pa.int64()), ("from_char", pa.int64()), ("to_char", pa.int64())] if spans else [("doc_id_a", pa.int64()), ("doc_id_b", pa.int64())])

    def emit(groups: list[tuple[list[str], list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        region, doc, begin = [], [], []
        for bodies, docs, at in groups:
            region += [number.setdefault(t, len(number)) for t in bodies]
            doc += docs
            begin += at
        texts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.int32) for t in number]
        region, doc, begin = (np.array(x, dtype=np.int64) for x in (region, doc, begin))
        size = np.cumsum([len(t) + 1 for t in texts])
        if len(size) and size[-1] > 2 * BLOCK:
            part = (size - 1) // BLOCK
            parts = [np.flatnonzero(part == p) for p in range(int(part[-1]) + 1)]
            pools = [np.concatenate([x, y]) if x is not y else x for k, x in enumerate(parts) for y in parts[k:]]
        else:
            pools = [np.arange(len(texts))]
        for pool in pools:
            local = np.full(len(texts), -1)
            local[pool] = np.arange(len(pool))
            held = local[region] >= 0
            block = [texts[i] for i in pool]
            if spans:
                found = iter([_block_spans(block, local[region[held]], doc[held], begin[held], min_len)])
            else:
                found = _block_pairs(block, local[region[held]], doc[held], list(range(len(pool))), min_len, expand)
            for columns in found:
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[list[str], list[int], list[int]]] = []
        chars, last = 0, None
        for batch in batches:
            fps, docs, begins, bodies = (batch.column(k).to_pylist() for k in range(4))
            for fp, d, at, t in zip(fps, docs, begins, bodies):
                if fp != last:
                    if chars > BLOCK:
                        yield from emit(groups)
                        groups, chars = [], 0
                    groups.append(([], [], []))
                    last = fp
                groups[-1][0].append(t)
                groups[-1][1].append(d)
                groups[-1][2].append(at)
                chars += len(t) + 1
        if groups:
            yield from emit(groups)

    return run


def copy_classes(docs: DataFrame) -> DataFrame:
    """doc_id, rep, n, len of every document whose text stands in two or more documents; docs has doc_id and text."""
    keyed = docs.select("doc_id", F.md5("text").alias("key"), F.length("text").alias("len"))
    sizes = keyed.groupBy("key", "len").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n")).filter("n > 1")
    return keyed.join(sizes, ["key", "len"]).select("doc_id", "rep", "n", "len").distinct()


def _long_enough(docs: DataFrame, text: str, key: str, min_len: int, gram: int) -> DataFrame:
    if not 1 <= gram <= min_len:
        raise ValueError("gram must lie between 1 and min_len")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_len))


def _anchored(docs: DataFrame, min_len: int, gram: int) -> DataFrame:
    return spread(docs).mapInArrow(_anchor_rows(min_len, gram), "fp long, around long, doc long, begin int, end int")


def _search_all(docs: DataFrame, rows: DataFrame, copies: DataFrame, min_len: int, expand: int | None, spans: bool, hot: int) -> DataFrame:
    """What the regions of all anchors with different surroundings give, duplicates included.

    The anchors are computed twice, for the counts of each and for the join with those wanted, rather than stored: their rows are nearly as large as the texts.
    Counts are taken map-side first, and a hot anchor's side of the join can be split.
    """
    shared = rows.groupBy("fp").agg(F.min("around").alias("a0"), F.max("around").alias("a1"), F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.count("*").alias("n"))
    shared = shared.filter("a0 <> a1 and d0 <> d1").select("fp", (F.col("n") > hot).alias("hot"))
    rep = copies.select("doc_id", "rep")
    wanted = rows.join(shared, "fp").join(rep, F.col("doc") == F.col("doc_id"), "left").withColumn("doc", F.coalesce("rep", "doc"))
    wanted = wanted.groupBy("doc").agg(F.collect_set(F.struct("fp", "begin", "end", "hot")).alias("at"))
    regions = wanted.join(docs, F.col("doc") == F.col("doc_id")).select("doc", F.explode("at").alias("at"), "text")
    size = F.col("at.end") - F.col("at.begin")
    cut = lambda df: df.select(F.col("at.fp").alias("fp"), "doc", F.col("at.begin").alias("begin"), F.substring("text", F.col("at.begin") + 1, size).alias("region"))
    shape = "doc long, from_char long, to_char long" if spans else "doc_id_a long, doc_id_b long"
    search = lambda df: df.repartition("fp").sortWithinPartitions("fp").mapInArrow(_search(min_len, expand, spans), shape)

    fine = cut(regions.filter("at.hot")).mapInArrow(_refine(min_len, max(1, min_len - FINE)), _REGION_SHAPE)
    group = Window.partitionBy("fp")
    fine = fine.withColumns({"block": F.expr(f"(row_number() over (partition by fp order by doc, begin) - 1) div {BLOCK_ROWS}"), "last": F.floor((F.count("*").over(group) - 1) / BLOCK_ROWS), "d0": F.min("doc").over(group), "d1": F.max("doc").over(group)})
    fine = fine.filter("d0 <> d1").withColumn("other", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), "last"), lambda k: (k != F.col("block")) | (F.col("last") == 0))))
    fine = fine.select(F.xxhash64("fp", F.least("block", "other"), F.greatest("block", "other")).alias("fp"), "doc", "begin", "region")
    return search(cut(regions.filter("not at.hot"))).unionByName(search(fine))


def shared_intervals(docs: DataFrame, text: str = "text", key: str = "doc_id", min_len: int = 250, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, from_char, to_char (0-based, end exclusive) of the maximal intervals of each document that stretches of at least ``min_len``
    characters cover which stand in another document too."""
    docs = _long_enough(docs, text, key, min_len, gram)
    rows, copies = _anchored(docs, min_len, gram), copy_classes(docs)
    same = rows.groupBy("fp", "around").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).filter("d0 <> d1").select("fp", "around")
    alike = rows.join(same, ["fp", "around"]).select("doc", F.col("begin").cast("long").alias("from_char"), F.col("end").cast("long").alias("to_char"))
    parts = alike.unionByName(_search_all(docs, rows, copies, min_len, None, True, hot))
    parts = parts.join(copies.select(F.col("doc_id").alias("doc")), "doc", "left_anti").unionByName(copies.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("from_char"), F.col("len").cast("long").alias("to_char")))
    return parts.repartition("doc").sortWithinPartitions("doc", "from_char").mapInArrow(_unions, "doc_id long, from_char long, to_char long")


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals sorted by document and begin to their unions; the last one is held until the next batch."""
    kind = pa.schema([("doc_id", pa.int64()), ("from_char", pa.int64()), ("to_char", pa.int64())])
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = joined(*(np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns)))
        if len(held[0]) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in held], schema=kind)
            held = [c[-1:] for c in held]
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=kind)


def shared_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_len: int = 250, gram: int = GRAM, expand: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id_a, doc_id_b (the smaller first) of documents that share a stretch of at least ``min_len`` characters."""
    docs = _long_enough(docs, text, key, min_len, gram)
    copies = copy_classes(docs)
    found = _search_all(docs, _anchored(docs, min_len, gram), copies, min_len, expand, False, hot).distinct()

    most = COPIES_MOST if expand is None else expand
    small = copies.filter(F.col("n") <= most).select(F.col("rep").alias("r"), F.col("doc_id").alias("member"))
    for side in ("doc_id_a", "doc_id_b"):
        found = found.join(small.withColumnRenamed("r", side), side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    found = found.select("doc_id_a", "doc_id_b")
    within = small.join(small.withColumnRenamed("member", "other"), "r").filter("member < other").select(F.col("member").alias("doc_id_a"), F.col("other").alias("doc_id_b"))
    star = copies.filter((F.col("n") > most) & (F.col("doc_id") != F.col("rep"))).select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
    pair = found.unionByName(within).unionByName(star)
    return pair.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")).distinct()
