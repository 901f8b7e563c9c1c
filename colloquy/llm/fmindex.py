"""A compressed FM-index over a block of short texts, in numpy.

The index keeps the Burrows-Wheeler transform as a wavelet matrix (a wavelet tree stored level by level) of bit vectors with
block counts, and answers backward search for many patterns at a time: every step is a vectorised rank over all patterns.
``matching_statistics`` streams patterns through the index from right to left and keeps, for each position, the longest
match that also occurs in a text other than the pattern's own; a failed step falls back to the parent interval, found on
the array of longest common prefixes.
"""

from __future__ import annotations

import numpy as np

INDEX_BITS = 20
BLOCK_CHARS = (1 << INDEX_BITS) - 1  # the most symbols, separators included, that one index may hold


class BitVector:
    """Bits with a count before each 64-bit word: a rank costs two look-ups and a population count."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.zeros(len(counts), dtype=np.int32)
        np.cumsum(counts[:-1], out=self.before[1:])
        self.zeros = n - int(counts.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, width: int):
        self.width, self.levels, cur = width, [], symbols
        start = np.zeros(1 << width, dtype=np.int32)
        alphabet = np.arange(1 << width, dtype=np.int32)
        self.starts = []
        for k in range(width - 1, -1, -1):
            bit = (cur >> k) & 1
            level = BitVector(bit.astype(np.uint8))
            self.levels.append(level)
            ones = level.rank1(start)
            start = np.where((alphabet >> k) & 1 == 1, level.zeros + ones, start - ones).astype(np.int32)
            mask = bit.astype(bool)
            cur = np.concatenate([cur[~mask], cur[mask]])
        self.start = start  # where each symbol's occurrences begin on the last level

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of c[i] before lo[i] and before hi[i]."""
        at, n = np.concatenate([lo, hi]), len(c)
        cc = np.concatenate([c, c])
        for k, level in zip(range(self.width - 1, -1, -1), self.levels):
            ones = level.rank1(at)
            at = np.where((cc >> k) & 1 == 1, ones + level.zeros, at - ones)
        at = at - self.start[cc]
        return at[:n], at[n:]


class FMIndex:
    """Index of the given texts (arrays of code points). A match never runs over the end of a text. ``owners``: whose each text is, its own unless given."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray | None = None):
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        n = int(lens.sum()) + len(texts)
        if n > BLOCK_CHARS:
            raise ValueError(f"a block holds at most {BLOCK_CHARS} symbols")
        ends = np.cumsum(lens + 1) - 1  # places of the separators
        body = np.ones(n, dtype=bool)
        body[ends] = False
        raw = np.concatenate(texts).astype(np.int32) if len(texts) else np.zeros(0, np.int32)
        self.alphabet, coded = np.unique(raw, return_inverse=True)
        s = np.zeros(n, dtype=np.int32)
        s[body] = coded + 1
        self.text, self.n = s, n
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), lens + 1)
        self.starts = ends - lens
        self.end_of = ends[self.owner].astype(np.int32)
        self.width = max(1, int(len(self.alphabet)).bit_length())
        self._sort(int(lens.max(initial=0)) + 1)
        self._lcp()
        bwt = np.where(self.sa > 0, s[self.sa - 1], 0)
        self.wavelet = WaveletMatrix(bwt, self.width)
        counts = np.bincount(s, minlength=(1 << self.width) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])[: 1 << self.width].astype(np.int32)
        self.sa_owner = self.owner[self.sa] if owners is None else owners[self.owner[self.sa]]
        change = np.flatnonzero(self.sa_owner[1:] != self.sa_owner[:-1]) + 1
        edges = np.concatenate([[0], change, [n]])
        self.other_at = np.repeat(edges[1:], np.diff(edges)).astype(np.int32)  # next place with another owner

    def _shifted(self, a: np.ndarray, h: int, idx: np.ndarray) -> np.ndarray:
        return a[np.minimum(idx + h, self.end_of)]

    def _sort(self, depth: int) -> None:
        """Prefix doubling; the key of a suffix, its two ranks and its place, is one 64-bit number and is sorted as such."""
        n, idx = self.n, np.arange(self.n, dtype=np.int32)
        first = max(1, (62 - INDEX_BITS) // self.width)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(first):
            key = (key << np.uint64(self.width)) | self._shifted(self.text, k, idx).astype(np.uint64)
        self.ranks: list[tuple[int, np.ndarray]] = []
        h = first
        low = np.uint64((1 << INDEX_BITS) - 1)
        while True:
            order = np.sort((key << np.uint64(INDEX_BITS)) | idx.astype(np.uint64))
            sa = (order & low).astype(np.int32)
            head = order >> np.uint64(INDEX_BITS)
            fresh = np.empty(n, dtype=np.int32)
            fresh[0] = 0
            np.cumsum(head[1:] != head[:-1], out=fresh[1:])
            rank = np.empty(n, dtype=np.int32)
            rank[sa] = fresh
            self.ranks.append((h, rank))
            if h >= depth or fresh[-1] == n - 1:
                break
            key = (rank.astype(np.uint64) << np.uint64(INDEX_BITS)) | self._shifted(rank, h, idx).astype(np.uint64)
            h *= 2
        self.sa = sa

    def _lcp(self) -> None:
        """lcp[k]: what the suffixes at k - 1 and k share; -1 at both ends."""
        a, b = self.sa[:-1], self.sa[1:]
        ea, eb = self.end_of[a], self.end_of[b]
        got = np.zeros(self.n - 1, dtype=np.int32)
        for h, rank in reversed(self.ranks):
            same = rank[np.minimum(a + got, ea)] == rank[np.minimum(b + got, eb)]
            got += np.where(same, h, 0).astype(np.int32)
        for _ in range(self.ranks[0][0] - 1):
            pa, pb = np.minimum(a + got, ea), np.minimum(b + got, eb)
            got += ((self.text[pa] == self.text[pb]) & (pa < ea) & (pb < eb)).astype(np.int32)
        got = np.minimum(got, np.minimum(ea - a, eb - b))
        self.lcp = np.concatenate([[-1], got, [-1]]).astype(np.int32)
        table = [self.lcp]
        while (1 << len(table)) <= len(self.lcp):
            t, w = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(t[:-w], t[w:]))
        self.low_table = table  # table[k][i]: the least of lcp[i : i + 2**k]

    def widen(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest interval around [lo, hi) in which neighbours share at least depth."""
        left, right = lo.astype(np.int64), hi.astype(np.int64)  # invariant: everything between, lcp[left+1 .. right-1], is deep enough
        for k in range(len(self.low_table) - 1, -1, -1):
            t, w = self.low_table[k], 1 << k
            at = left - w + 1
            ok = (at >= 0) & (t[np.maximum(at, 0)] >= depth)
            left = np.where(ok, left - w, left)
            ok = (right + w <= len(self.lcp)) & (t[np.minimum(right, len(t) - 1)] >= depth)
            right = np.where(ok, right + w, right)
        return left, right

    def runs(self, depth: int) -> np.ndarray:
        """For each place of the suffix array, the number of its class of suffixes that share depth symbols."""
        return np.cumsum(self.lcp[:-1] < depth) - 1

    def matching_statistics(self, patterns: list[np.ndarray], own: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """Streams the patterns from right to left. own[i]: the owner of pattern i, the index's text that it is itself unless owners were given, or -1.

        Returns pattern, position, match length and a suffix-array place of every match of at least ``least`` symbols
        with a text of another owner.
        """
        m = len(patterns)
        lens = np.array([len(p) for p in patterns], dtype=np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        flat = np.concatenate(patterns) if m else np.zeros(0, np.int32)
        code = np.searchsorted(self.alphabet, flat)
        known = (code < len(self.alphabet)) & (self.alphabet[np.minimum(code, len(self.alphabet) - 1)] == flat) if len(self.alphabet) else np.zeros(len(flat), bool)
        sym = np.where(known, code + 1, 0).astype(np.int32)
        j, lo, hi = lens.copy(), np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        length = np.zeros(m, np.int64)
        live = np.flatnonzero(j + length >= least)
        out: list[tuple[np.ndarray, ...]] = []
        while len(live):
            jj, l0, h0, ln = j[live], lo[live], hi[live], length[live]
            c = sym[off[live] + jj - 1]
            a, b = self.wavelet.rank(c, l0, h0)
            a, b = a + self.before[c], b + self.before[c]
            o = own[live]
            at = np.minimum(a, self.n - 1)
            good = (c > 0) & (b > a) & ((self.sa_owner[at] != o) | (self.other_at[at] < b))
            g = live[good]
            lo[g], hi[g], length[g] = a[good], b[good], ln[good] + 1
            j[g] -= 1
            hit = g[length[g] >= least]
            if len(hit):
                out.append((hit, j[hit], length[hit], lo[hit]))
            bad = ~good
            root = live[bad & (ln == 0)]
            j[root] -= 1
            up = live[bad & (ln > 0)]
            if len(up):
                depth = np.maximum(np.maximum(self.lcp[lo[up]], self.lcp[hi[up]]), 0)
                lo[up], hi[up] = self.widen(lo[up], hi[up], depth)
                length[up] = depth
            live = live[(j[live] > 0) & (j[live] + length[live] >= least)]
        if not out:
            e = np.zeros(0, np.int64)
            return e, e, e, e
        return tuple(np.concatenate(x) for x in zip(*out))
