"""Runs of periodically repeated words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least ``max(MIN_LENGTH, MIN_PERIODS * q)`` long, which no neighbouring word extends.

Texts are laid side by side and sorted by prefix doubling, which gives their suffix array (texts
kept apart) and, on the way, a name for every stretch of 2^k words.  Every text is cut into
dyadic blocks of L = 2^k words; a wavelet matrix over the suffix array answers "where is the
next (the last) occurrence of this block" as a range successor (predecessor) in the block's
interval.  In a run of period q <= L < 2q that is four periods long, some block has its nearest
occurrence on one side inside the run, and that at distance exactly q: a stretch of q or more
words of a primitive repetition occurs again only multiples of q further.  So the nearest
occurrences in the neighbouring windows, the first terms of the progressions that the
occurrences form, are candidate periods; names give the longest extension both ways.

Defined results: a null or empty text has no words and no run; texts are never cut, and a text's
cost is near linear in its words (some 200 bytes of memory for each); repeated rows repeat their
result; an empty table gives an empty table; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import byte_slices, ready

MIN_LENGTH, MIN_PERIODS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"         # fixed value: what a word is
_words = re.compile(WORD).findall


class Suffixes:
    """Suffix array of several sequences side by side, with the names of all dyadic stretches.

    ``names[k][i]`` is the place of the first suffix that agrees with suffix i on 2^k words, so
    equal names mean equal stretches, and the interval of a stretch starts at its name."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.end = ends                                     # per position: end of its sequence
        order = np.lexsort((words, ends))
        w, e = words[order], ends[order]
        head = np.ones(n, bool)
        head[1:] = (w[1:] != w[:-1]) | (e[1:] != e[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.names, self.sizes = [], []
        span = 1
        while True:
            size = np.bincount(rank, minlength=n)
            self.names.append(rank.astype(np.int32))
            self.sizes.append(size.astype(np.int32))
            tied = np.flatnonzero(size[rank] > 1)           # only these can still be told apart
            if not len(tied):
                break
            far = tied + span
            inside = far < ends[tied]
            second = np.where(inside, rank[np.minimum(far, n - 1)], -1)
            if not inside.any():
                break
            order = np.lexsort((second, rank[tied]))
            r, s, at = rank[tied][order], second[order], tied[order]
            group = np.ones(len(at), bool)
            group[1:] = r[1:] != r[:-1]
            first = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
            head = group.copy()
            head[1:] |= s[1:] != s[:-1]
            place = r + np.arange(len(at)) - first
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(head, place, 0))
            span *= 2
        self.array = np.argsort(rank, kind="stable")

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on agree (of one sequence)."""
        i, j = i.copy(), j.copy()
        start, n = i.copy(), len(self.end)
        k = len(self.names) - 1
        while k >= 0:
            name = self.names[k]
            same = (j < n) & (name[np.minimum(i, n - 1)] == name[np.minimum(j, n - 1)])
            i[same] += 1 << k
            j[same] += 1 << k
            if not same.any() or k < len(self.names) - 1:
                k -= 1
        return i - start

    def common_back(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i agree, not going back beyond ``begin``."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        k = len(self.names) - 1
        while k >= 0:
            name, w = self.names[k], 1 << k
            ok = i - w >= begin
            same = ok & (name[np.maximum(i - w, 0)] == name[np.maximum(j - w, 0)])
            i[same] -= w
            j[same] -= w
            if not same.any() or k < len(self.names) - 1:
                k -= 1
        return start - i


class Wavelet:
    """Wavelet matrix over a permutation: rank and quantile of an interval's values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split = [], []
        cur = values.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            one = (cur >> b & 1).astype(bool)
            z = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(~one, out=z[1:])
            self.zeros.append(z)
            self.split.append(int(z[-1]))
            cur = np.concatenate([cur[~one], cur[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are less than x."""
        lo, hi, got = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for d, (z, s) in enumerate(zip(self.zeros, self.split, strict=True)):
            one = (x >> (self.bits - 1 - d) & 1).astype(bool)
            a, b = z[lo], z[hi]
            got += np.where(one, b - a, 0)
            lo, hi = np.where(one, s + lo - a, a), np.where(one, s + hi - b, b)
        return got

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in [lo, hi)."""
        lo, hi, k, got = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for d, (z, s) in enumerate(zip(self.zeros, self.split, strict=True)):
            a, b = z[lo], z[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            got |= np.where(one, 1 << (self.bits - 1 - d), 0)
            lo, hi = np.where(one, s + lo - a, a), np.where(one, s + hi - b, b)
        return got


def runs(words: np.ndarray, off: np.ndarray, min_length: int = MIN_LENGTH,
         min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(sequence, start, length, period) of every run in the sequences words[off[i]:off[i+1]],
    by sequence, start, period.  ``words`` are integers; at least four periods make a run."""
    if min_periods < 4:
        raise ValueError("blocks find runs of four periods or more")
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return none
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)
    begin, end = off[:-1][doc], off[1:][doc]
    suf = Suffixes(words, end)
    n = len(words)
    # the nearest equal words before and after: a block without one in the window needs no search
    by = np.argsort(suf.names[0], kind="stable")
    same = suf.names[0][by][1:] == suf.names[0][by][:-1]
    after, before = np.full(n, 2 * n), np.full(n, -2 * n)
    after[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    tree = None
    found = []
    at = np.arange(n)
    for k, (name, count) in enumerate(zip(suf.names, suf.sizes, strict=True)):
        span = 1 << k
        s = at[((at - begin) % span == 0) & (at + span <= end)]
        s = s[(count[name[s]] > 1) & ((after[s] - s <= span) | (s - before[s] <= span))]
        if not len(s):
            continue
        tree = tree or Wavelet(suf.array)
        lo = name[s].astype(np.int64)
        hi = lo + count[lo]
        mine = tree.below(lo, hi, s)
        nxt = mine + 1 < hi - lo
        far = tree.nth(lo[nxt], hi[nxt], mine[nxt] + 1)
        q = far - s[nxt]
        ok = (q <= span) & (2 * q > span)
        found.append(np.column_stack([s[nxt][ok], q[ok]]))
        prv = mine > 0
        near = tree.nth(lo[prv], hi[prv], mine[prv] - 1)
        q = s[prv] - near
        ok = (q <= span) & (2 * q > span)
        found.append(np.column_stack([near[ok], q[ok]]))
    found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(found):
        return none
    i, q = found[:, 0], found[:, 1]
    left = suf.common_back(i, i + q, begin[i])
    right = suf.common(i, i + q)
    start, length = i - left, left + right + q
    long = length >= np.maximum(min_length, min_periods * q)
    got = np.unique(np.column_stack([doc[i], start - begin[i], length, q])[long], axis=0)
    # one stretch, several multiples of its period: the smallest is its own
    first = np.ones(len(got), bool)
    first[1:] = (got[1:, :3] != got[:-1, :3]).any(axis=1)
    got = got[first]
    return got[np.lexsort((got[:, 3], got[:, 1], got[:, 0]))]


def _batch(texts: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Runs of a slice of texts, and the texts without repeated rounds."""
    split = [_words(t) if t else [] for t in texts.to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    ids: dict[str, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for d in split for w in d), np.int64, int(off[-1]))
    got = runs(words, off)
    # a word is dropped if a run holds it after its first period
    level = np.zeros(len(words) + 1, np.int64)
    np.add.at(level, off[got[:, 0]] + got[:, 1] + got[:, 3], 1)
    np.add.at(level, off[got[:, 0]] + got[:, 1] + got[:, 2], -1)
    drop = np.cumsum(level)[:-1] > 0
    has = np.zeros(len(split), bool)
    has[got[:, 0]] = True
    kept = [" ".join(w for w, d in zip(ws, drop[a:b].tolist(), strict=True) if not d) if h else " ".join(ws)
            for ws, h, a, b in zip(split, has.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return got, kept


def find_runs(docs: DataFrame, text: str = "text", out: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add ``out``: every run (start word, length, period) by start, then period; and ``collapsed``:
    the text's words without what repeats a run's first period, joined by one space."""
    ready(docs.sparkSession)

    @F.arrow_udf("struct<r array<struct<start bigint, length bigint, period bigint>>, c string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            rows, each, kept = [], [], []
            for part in byte_slices(arr):
                got, texts = _batch(part)
                rows.append(got)
                each.append(np.bincount(got[:, 0], minlength=len(part)))
                kept += texts
            got = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(each) if each else [])]).astype(np.int32)
            item = pa.StructArray.from_arrays([pa.array(got[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), item), pa.array(kept, pa.string())], ["r", "c"])

    own = [c for c in docs.columns if c not in (out, collapsed)]
    return (docs.select(*own, find(F.col(text)).alias("__runs"))
                .select(*own, F.col("__runs.r").alias(out), F.col("__runs.c").alias(collapsed)))
