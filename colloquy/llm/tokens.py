"""Encoding of a corpus with a public byte-level BPE vocabulary, in two tiers.

Pre-tokens are cut for a whole slice of texts at once, on arrays of character classes. Tier one looks each pre-token up in a
minimal perfect hash over the vocabulary (hash and displace, with a direct slot for lone keys) and compares its bytes, so a
pre-token that is itself in the vocabulary needs one probe. Tier two merges the bytes of a miss with a heap over a linked
list; its result is kept for the next occurrence in the task.

Defined results: null and empty texts have an empty list; special tokens are never produced, their strings are ordinary text; a
null id keeps its row; an empty table gives an empty table. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrow import slices_by_bytes, spread

SLICE_BYTES = 1 << 19
LONGEST = 32  # bytes of a pre-token that tier one takes
MEMO_MOST = 300_000
VOCABULARY_MOST = 1_000_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that an apostrophe begins.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kinds[c] = LETTER
        elif first == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def pre_tokens(c: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the texts begin; c: the code points of all texts, off: where the texts begin and the last ends."""
    n = len(c)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[c]
    opens = np.zeros(n + 1, dtype=bool)  # the first character of a text, and the end
    opens[off] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begins = run & space  # white space: its first character
    last = np.zeros(n, dtype=bool)  # and its last, before anything else in the text
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
    begins |= last
    joined = np.zeros(n, dtype=bool)  # after a space, a run has begun already
    joined[1:] = last[:-1] & (c[:-1] == 0x20)
    solid = run & ~space & ~joined
    begins |= solid
    mark = np.flatnonzero(solid & (c == 0x27))
    if len(mark):
        limit = off[np.searchsorted(off, mark, side="right")]
        far = np.concatenate([c, np.zeros(3, dtype=c.dtype)])
        for ending in ENDINGS:
            fits = mark + 1 + len(ending) <= limit
            for k, letter in enumerate(ending):
                fits &= far[mark + 1 + k] == ord(letter)
            at = mark[fits]
            begins[at + 1] = False
            after = at + 1 + len(ending)
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


def _mix(words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, w in enumerate(words):
        h = (h ^ w) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        h ^= h >> np.uint64(31)
    return h


def _words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The bytes of each piece as four numbers, zero beyond its end; data has 32 bytes more than the pieces need."""
    view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    out = []
    for k in range(LONGEST // 8):
        if k < 2:
            out.append(view[start + 8 * k] & masks[np.clip(size - 8 * k, 0, 8)])
        else:
            w = np.zeros(len(start), dtype=np.uint64)
            far = np.flatnonzero(size > 8 * k)
            w[far] = view[start[far] + 8 * k] & masks[np.minimum(size[far] - 8 * k, 8)]
            out.append(w)
    return out


@dataclass
class PerfectHash:
    """A minimal perfect hash of the vocabulary's entries of up to LONGEST bytes, with their bytes and ids in slot order."""

    pilots: np.ndarray
    words: list[np.ndarray]
    size: np.ndarray
    ids: np.ndarray

    @staticmethod
    def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
        x = (h ^ (pilot.astype(np.uint64) * np.uint64(0x94D049BB133111EB))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> "PerfectHash":
        keys = [k for k in ranks if len(k) <= LONGEST]
        n = len(keys)
        size = np.array([len(k) for k in keys], dtype=np.int64)
        data = np.frombuffer(b"".join(keys) + bytes(LONGEST + 8), dtype=np.uint8)
        words = _words(data, np.cumsum(size) - size, size)
        h = _mix(words, size)
        n_buckets = max(1, n // 4)
        bucket = ((h >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        pilots, taken, slot = np.zeros(n_buckets, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        lone = []
        tries = np.arange(256)
        for b in np.argsort(-np.diff(edges), kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) <= 1:
                lone += [(b, k) for k in own]
                continue
            for base in range(0, 1 << 24, len(tries)):
                at = cls._slot(h[own][None, :], (base + tries)[:, None], n)
                sorted_at = np.sort(at, axis=1)
                ok = ~taken[at].any(axis=1) & (sorted_at[:, 1:] != sorted_at[:, :-1]).all(axis=1)
                if ok.any():
                    first = int(ok.argmax())
                    pilots[b], slot[own] = base + first, at[first]
                    taken[at[first]] = True
                    break
            else:
                raise ValueError("no displacement found")
        for (b, k), free in zip(lone, np.flatnonzero(~taken)):
            pilots[b], slot[k] = -1 - free, free
        back = np.empty(n, dtype=np.int64)
        back[slot] = np.arange(n)
        return cls(pilots, [w[back] for w in words], size[back], np.array([ranks[k] for k in keys], dtype=np.int32)[back])

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the pieces of data, -1 for one that is no entry."""
        words = _words(data, start, size)
        h = _mix(words, size)
        pilot = self.pilots[((h >> np.uint64(20)) % np.uint64(len(self.pilots))).astype(np.int64)]
        at = np.where(pilot < 0, -1 - pilot, self._slot(h, np.maximum(pilot, 0), len(self.ids)))
        same = self.size[at] == size
        for mine, theirs in zip(words, self.words):
            same &= mine == theirs[at]
        return np.where(same, self.ids[at], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one piece: the pair of least rank first, the left one of equal pairs; a heap over linked parts."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # a part begins at its number; 0 marks one that was merged away
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:
            continue
        end[i], end[mid] = to, 0
        if to < n:
            left[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := left[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], table: PerfectHash):
        self.ranks, self.table = ranks, table
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.memo_ids: list[int] = []
        self.memo_off: list[int] = [0]
        self.arrays = (np.zeros(0, np.int32), np.zeros(1, np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offsets of the texts in them."""
        whole = "".join(texts)
        raw = whole.encode("utf-8")
        off = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        ascii_only = len(raw) == len(whole)
        data = np.frombuffer(raw + bytes(LONGEST + 8), dtype=np.uint8)
        c = data[: len(raw)] if ascii_only else np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        begin = pre_tokens(c, off)
        owner = np.searchsorted(begin, off)
        if not ascii_only:
            place = np.zeros(len(c) + 1, dtype=np.int64)
            np.cumsum(1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000), out=place[1:])
            begin = place[begin]
        size = np.diff(np.append(begin, len(raw)))
        ids = np.full(len(begin), -1, dtype=np.int64)
        short = size <= LONGEST
        if short.all():
            ids = self.table.find(data, begin, size)
        else:
            ids[short] = self.table.find(data, begin[short], size[short])
        miss = np.flatnonzero(ids < 0)
        count = np.ones(len(begin), dtype=np.int64)
        if len(miss):
            if len(self.memo) > MEMO_MOST:
                self._forget()
            memo, known = self.memo, np.empty(len(miss), dtype=np.int64)
            for k, (s, e) in enumerate(zip(begin[miss].tolist(), (begin[miss] + size[miss]).tolist())):
                piece = raw[s:e]
                at = memo.get(piece)
                if at is None:
                    at = memo[piece] = len(memo)
                    self.memo_ids += merge(piece, self.ranks)
                    self.memo_off.append(len(self.memo_ids))
                known[k] = at
            flat, starts = self.arrays
            if len(starts) < len(self.memo_off):
                flat = np.concatenate([flat, np.array(self.memo_ids[len(flat) :], dtype=np.int32)])
                starts = np.concatenate([starts, np.array(self.memo_off[len(starts) :], dtype=np.int64)])
                self.arrays = flat, starts
            count[miss] = starts[known + 1] - starts[known]
        to = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(int(to[-1]), dtype=np.int32)
        hit = ids >= 0
        out[to[:-1][hit]] = ids[hit]
        if len(miss):
            n = count[miss]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[:-1][miss], n) + step] = flat[np.repeat(starts[known], n) + step]
        return out, to[owner]


_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \t\n]")


def _parts(text: str) -> list[str]:
    """A very long text in parts; before white space that follows anything else a pre-token always ends."""
    parts, at = [], 0
    while len(text) - at > SLICE_BYTES:
        cut = _CUT.search(text, at + SLICE_BYTES)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    ranks = load_ranks(path)
    return Encoder(ranks, PerfectHash.build(ranks))


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file of the installed package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, name: str = "ids") -> DataFrame:
    """The key and, in column ``name``, the token ids of each text; path: a file of ranks.

    The file is read and its perfect hash built on the driver; both are broadcast. Their size is that of the vocabulary, at most
    VOCABULARY_MOST entries, whatever the corpus.
    """
    source = encoder(path or vocabulary())
    if len(source.ranks) > VOCABULARY_MOST:
        raise ValueError(f"a vocabulary has at most {VOCABULARY_MOST} entries")
    shared = docs.sparkSession.sparkContext.broadcast((source.ranks, source.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(*shared.value)
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1)
            for i, j in slices_by_bytes(bodies, SLICE_BYTES):
                texts = [t or "" for t in bodies.slice(i, j - i).to_pylist()]
                if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
                    ids = np.concatenate([own.encode([p])[0] for p in _parts(texts[0])])
                    off = np.array([0, len(ids)])
                else:
                    ids, off = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists], names=[key, name])

    frame = spread(docs.select(F.col(key).alias(key), F.col(text).alias("__text")))
    return frame.mapInArrow(run, f"`{key}` {frame.schema[0].dataType.simpleString()}, `{name}` array<int>")
