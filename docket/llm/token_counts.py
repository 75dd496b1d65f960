"""Token counts that follow edits without encoding the whole text again.

Each document keeps a segment tree over its pre-tokens; nodes hold the sums of
characters and of tokens.  An edit is located by descending the character sums,
pre-tokens are cut anew from just before the edit (the pattern looks at most two
characters past a pre-token) until a cut falls on an old boundary behind the edit,
only those are encoded, and the sums above them are updated.

Defined results: a null text counts like an empty one (0 tokens) and can be edited
like one; positions outside the text are moved to its nearest end; null edits,
and null fields of an edit, change nothing (a null replacement deletes); repeated
rows repeat their result; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.bpe import Codec, shared_codec

CACHE = 400_000         # distinct pre-tokens remembered: edits meet the same ones again
RUN = 64            # pre-tokens per leaf
LOOK = 2            # characters past its end that decide a pre-token
EDITS = "array<struct<start bigint, end bigint, replacement string>>"


class TokenTree:
    """One document's pre-tokens: leaves of about ``RUN`` pre-tokens, sums in a binary tree."""

    def __init__(self, codec: Codec, text: str, tokens: list[str] | None = None, ids: list[bytes] | None = None):
        self.codec, self.text = codec, text
        if tokens is None:
            tokens, ids = next(codec.pieces([text]))
        self.pre = len(tokens)
        self.again = 0                      # pre-tokens encoded because of edits
        self._build(np.fromiter(map(len, tokens), np.int64, len(tokens)),
                    np.fromiter(map(len, ids), np.int64, len(ids)) // 4)

    def _build(self, chars: np.ndarray, toks: np.ndarray) -> None:
        n = max(1, -(-len(chars) // RUN))
        self.width = 1 << (n - 1).bit_length()
        self.leaves = [(chars[i * RUN:(i + 1) * RUN], toks[i * RUN:(i + 1) * RUN]) for i in range(n)]
        self.leaves += [(chars[:0], toks[:0])] * (self.width - n)
        tree = np.zeros((2 * self.width, 2), np.int64)
        for i, (c, t) in enumerate(self.leaves):
            tree[self.width + i] = c.sum(), t.sum()
        level = self.width
        while level > 1:
            half = level // 2
            tree[half:level] = tree[level:2 * level:2] + tree[level + 1:2 * level:2]
            level = half
        self.tree = tree

    @property
    def tokens(self) -> int:
        return int(self.tree[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the text's end), and its first character."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.tree[2 * node, 0])
            if char - before < left or not self.tree[2 * node + 1, 0]:
                node = 2 * node
            else:
                before += left
                node = 2 * node + 1
        return node - self.width, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace text[start:end]."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        new = self.text[:start] + replacement + self.text[end:]
        shift, fresh_end = len(new) - size, start + len(replacement)
        leaf, at = self.leaf_at(max(0, start - LOOK))
        chars, toks = self.leaves[leaf]
        ends = at + np.cumsum(chars)
        keep = int(np.searchsorted(ends, start - LOOK, side="right"))
        pos = int(ends[keep - 1]) if keep else at
        # old boundaries from here on, leaf by leaf
        last, old_end = leaf, (int(ends[-1]) if len(ends) else at)
        bounds = {at, *ends.tolist()}
        found: list[str] = []
        stop = None
        if pos >= fresh_end and pos - shift >= end and pos - shift in bounds:
            stop = pos - shift
        while stop is None and pos < len(new):
            token = self.codec.match(new, pos).group()
            found.append(token)
            pos += len(token)
            if pos >= fresh_end and pos - shift >= end:
                while pos - shift > old_end and last + 1 < self.width:
                    last += 1
                    for c in self.leaves[last][0].tolist():
                        old_end += c
                        bounds.add(old_end)
                if pos - shift in bounds:
                    stop = pos - shift
        if stop is None:                    # cut anew up to the text's end
            stop = size
            while last + 1 < self.width:
                last += 1
                old_end += int(self.leaves[last][0].sum())
        self.codec.fill(dict.fromkeys(found))
        self.again += len(found)
        self.pre += len(found)
        # leaves leaf..last become: kept head + found + tail behind ``stop``; all of it in the first
        tail_c, tail_t = [], []
        base = at
        for i in range(leaf, last + 1):
            c, t = self.leaves[i]
            e = base + np.cumsum(c)
            # pre-tokens that begin at or behind ``stop``
            k = int(np.searchsorted(e - c, stop, side="left"))
            tail_c.append(c[k:])
            tail_t.append(t[k:])
            self.pre -= k
            base = int(e[-1]) if len(e) else base
        self.pre += keep
        cache = self.codec.cache
        c = np.concatenate([chars[:keep], np.array([len(t) for t in found], np.int64), *tail_c])
        t = np.concatenate([toks[:keep], np.array([len(cache[t]) // 4 for t in found], np.int64), *tail_t])
        self.text = new
        for i in range(leaf, last + 1):
            self._set(i, c[:0], t[:0])
        self._set(leaf, c, t)
        if len(c) > 8 * RUN:                # a leaf grew too long: cut all leaves anew
            self._build(np.concatenate([x[0] for x in self.leaves]), np.concatenate([x[1] for x in self.leaves]))

    def _set(self, i: int, c: np.ndarray, t: np.ndarray) -> None:
        self.leaves[i] = (c, t)
        node = self.width + i
        self.tree[node] = c.sum(), t.sum()
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] + self.tree[2 * node + 1]


def count_with_edits(docs: DataFrame, edits: str = "edits", text: str = "text", codec=None) -> DataFrame:
    """Add ``n_tokens`` (before), ``n_tokens_edited``, ``n_pretokens`` (before), ``n_reencoded`` and
    ``edited`` (the text after all edits); ``edits`` is an array of (start, end, replacement)
    applied in order, each to the text the former ones left."""
    codec = codec or shared_codec(docs.sparkSession)
    kind = "struct<n_tokens bigint, n_tokens_edited bigint, n_pretokens bigint, n_reencoded bigint, edited string>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c = codec()
        c.limit = CACHE
        for texts, changes in batches:
            rows = []
            each = zip(c.pieces(x.as_py() for x in texts), texts, changes, strict=True)
            for (tokens, ids), t, change in each:
                tree = TokenTree(c, t.as_py() or "", tokens, ids)
                before, pre = tree.tokens, tree.pre
                for e in change.as_py() or ():
                    if e is not None and e["start"] is not None and e["end"] is not None:
                        tree.edit(e["start"], e["end"], e["replacement"] or "")
                rows.append((before, tree.tokens, pre, tree.again, tree.text))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.StructArray.from_arrays(
                [pa.array(v, pa.int64()) for v in cols[:4]] + [pa.array(cols[4], pa.string())],
                ["n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", "edited"])

    new = ("n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", "edited")
    own = [c for c in docs.columns if c not in new]
    return (docs.select(*own, run(F.col(text), F.col(edits).cast(EDITS)).alias("__count"))
                .select(*own, *[F.col(f"__count.{c}").alias(c) for c in new]))


def edits_of(edits: DataFrame, doc_id: str = "doc_id", seq: str = "seq") -> DataFrame:
    """A table of edits (doc_id, seq, start, end, replacement) as one array per document."""
    row = F.struct(F.col(seq), F.struct("start", "end", "replacement").alias("e"))
    return (edits.filter(F.col(doc_id).isNotNull()).groupBy(doc_id)
                 .agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["e"]).alias("edits")))
