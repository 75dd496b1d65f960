"""Secret scanning with one combined deterministic automaton over bytes.

Each rule is a regular expression (optionally with a longer form that a match
must also reach to be reported).  Every rule becomes an NFA, then by subset
construction a machine that finds its leftmost, longest, non-overlapping matches
and starts anew where a match ends; the product of all machines is minimised
into one transition array.  One pass over a text's UTF-8 bytes advances all
rules; a transition says which rules' matches ended just before its byte.

For speed many pieces of text advance side by side in numpy.  A piece ends after
a byte that leads every state back to the start ("reset" byte), so cutting never
changes a result; a text without such bytes is one piece.  When few long pieces are
left, each is read on alone in a plain loop, which costs the same per byte.  Only pieces
in which a reported match ended are read again to find where it started.  Texts are
taken in slices of about a megabyte, so memory does not grow with Spark's batches.

Defined results: null and empty texts have no spans; texts may be of any length (nothing
is cut); repeated rows repeat their spans; an empty table gives an empty table; a column
named like the added one is replaced.  Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser as rx

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import byte_slices, ready, utf8

# The base rules.  ``strong`` is what a match must be to count.
_ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)" r"""["']?\x20*[:=]\x20*["']?""")
RULES = (
    ("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _ASSIGN + r"[A-Za-z0-9+/_.=-]{12,}"),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14,}"),
    ("hex", r"[0-9a-f]+", r"[0-9a-f]{16,}"),
    # added by this method
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", None),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None),
)
BASE = ("assign", "access", "hex")
PIECE = 256
FEW = 24            # at most so many pieces left: they go on one by one


# -- regular expression -> NFA ----------------------------------------------------------------

class _Nfa:
    """States with epsilon edges and byte-set edges, built from the standard parse tree."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def new(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def bytes_of(self, op, arg, fold: bool) -> frozenset:
        if op is C.LITERAL:
            got = {arg}
        elif op is C.NOT_LITERAL:
            got = set(range(256)) - {arg}
        elif op is C.ANY:
            got = set(range(256)) - {10}
        elif op is C.IN:
            got, neg = set(), False
            for k, v in arg:
                if k is C.NEGATE:
                    neg = True
                elif k is C.RANGE:
                    got |= set(range(v[0], v[1] + 1))
                else:
                    got |= self.bytes_of(k, v, False)
            got = set(range(256)) - got if neg else got
        else:
            raise ValueError(f"unsupported in a rule: {op}")
        if fold:
            got |= {b ^ 32 for b in got if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(got)

    def add(self, tree, at: int, fold: bool) -> int:
        for op, arg in tree:
            if op is C.SUBPATTERN:
                _, on, off, sub = arg
                at = self.add(sub, at, (fold or bool(on & 2)) and not off & 2)
            elif op is C.BRANCH:
                end = self.new()
                for sub in arg[1]:
                    first = self.new()
                    self.eps[at].append(first)
                    self.eps[self.add(sub, first, fold)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, sub = arg
                for _ in range(low):
                    at = self.add(sub, at, fold)
                if high is C.MAXREPEAT:
                    loop = self.new()
                    self.eps[at].append(loop)
                    self.eps[self.add(sub, loop, fold)].append(loop)
                    at = self.new()              # a state has one byte edge: go on from a fresh one
                    self.eps[loop].append(at)
                else:
                    end = self.new()
                    for _ in range(high - low):
                        self.eps[at].append(end)
                        at = self.add(sub, at, fold)
                    self.eps[at].append(end)
                    at = end
            else:
                nxt = self.new()
                self.step[at] = (self.bytes_of(op, arg, fold), nxt)
                at = nxt
        return at

    def close(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def move(self, states: frozenset, byte: int) -> frozenset:
        return self.close({e[1] for s in states if (e := self.step[s]) and byte in e[0]})


@dataclass
class _Rule:
    """One rule's leftmost machine: states are tuples of thread groups, oldest start first."""

    kind: str
    weak: str
    strong: str | None
    nfa: _Nfa = field(default_factory=_Nfa)

    def __post_init__(self):
        start, self.accept, self.good = self.nfa.new(), set(), set()
        for pattern, ends in ((self.weak, (self.accept,) if self.strong else (self.accept, self.good)),
                              (self.strong, (self.accept, self.good))):
            if pattern:
                first = self.nfa.new()
                self.nfa.eps[start].append(first)
                end = self.nfa.add(rx.parse(pattern.encode()), first, False)
                for e in ends:
                    e.add(end)
        self.start = self.nfa.close({start})
        if self.start & self.accept:
            raise ValueError(f"rule {self.kind} matches the empty text")

    def matched(self, state: tuple) -> bool:
        return bool(state) and bool(state[0] & self.accept)

    def ok(self, state: tuple) -> bool:
        return self.matched(state) and bool(state[0] & self.good)

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended (and is to be reported) before ``byte``."""
        if self.matched(state):
            head = self.nfa.move(state[0], byte)
            if head:
                if not head & self.accept:
                    raise ValueError(f"rule {self.kind}: a match may only be prolonged byte by byte")
                return (head,), False
            return self.step((), byte)[0], self.ok(state)
        seen: set = set()
        out = []
        for group in (*state, self.start):
            moved = self.nfa.move(group, byte) - seen
            if moved:
                seen |= moved
                out.append(moved)
                if moved & self.accept:
                    if len(out) > 1:
                        raise ValueError(f"rule {self.kind}: an older start is still open at a match")
                    return (moved,), False
        return tuple(out), False


# -- the product, minimised -------------------------------------------------------------------

@dataclass
class Automaton:
    """``nxt[state * classes + cls[byte]]``: next state, with a set sign bit where ``out`` is not 0."""

    kinds: tuple
    cls: np.ndarray
    classes: int
    nxt: np.ndarray
    out: np.ndarray
    final: np.ndarray
    reset: np.ndarray
    anchored: list

    def plain(self) -> list:
        """The transition array as a list (made once per worker)."""
        if not hasattr(self, "_plain"):
            self._plain = self.nxt.tolist()
        return self._plain


def compile_rules(rules=RULES) -> Automaton:
    machines = [_Rule(*r) for r in rules]
    # bytes that no rule tells apart share a class
    sets = [e[0] for m in machines for e in m.nfa.step if e]
    key = [tuple(b in s for s in sets) for b in range(256)]
    ids = {k: i for i, k in enumerate(dict.fromkeys(key))}
    cls = np.array([ids[k] for k in key], np.uint8)
    rep = [int(np.flatnonzero(cls == c)[0]) for c in range(len(ids))]
    nc = len(ids)

    memo: list[dict] = [{} for _ in machines]

    def one(i: int, s: tuple, c: int):
        got = memo[i].get((s, c))
        if got is None:
            got = memo[i][(s, c)] = machines[i].step(s, rep[c])
        return got

    first = tuple(() for _ in machines)
    index, todo, rows, outs = {first: 0}, [first], [], []
    for state in todo:
        row, res = [], []
        for c in range(nc):
            parts = [one(i, s, c) for i, s in enumerate(state)]
            nxt = tuple(p[0] for p in parts)
            if nxt not in index:
                index[nxt] = len(todo)
                todo.append(nxt)
            row.append(index[nxt])
            res.append(sum(1 << i for i, p in enumerate(parts) if p[1]))
        rows.append(row)
        outs.append(res)
    nxt, out = np.array(rows), np.array(outs)
    fin = np.array([sum(1 << i for i, m in enumerate(machines) if m.ok(s[i])) for s in todo])

    # Moore's refinement: states stay together while outputs and successors' blocks agree
    block = np.unique(np.column_stack([out, fin]), axis=0, return_inverse=True)[1].ravel()
    while True:
        new = np.unique(np.column_stack([block, block[nxt]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    order = np.full(block.max() + 1, -1)
    seen = 0
    for b in block:                      # number blocks by first state: the start is 0
        if order[b] < 0:
            order[b] = seen
            seen += 1
    block = order[block]
    pick = np.array([int(np.flatnonzero(block == b)[0]) for b in range(seen)])
    nxt, out, fin = block[nxt[pick]], out[pick], fin[pick]
    reset = np.array([(nxt[:, c] == 0).all() for c in range(nc)])
    code = (nxt * nc).astype(np.int32)
    code = np.where(out != 0, -code - 1, code).astype(np.int32)
    return Automaton(tuple(r[0] for r in rules), cls, nc, code.ravel(), out.ravel().astype(np.int32),
                     fin.astype(np.int32), reset[cls], [_anchored(m, rep, cls) for m in machines])


def _anchored(m: _Rule, rep: list, cls: np.ndarray) -> tuple[list, list, list]:
    """Subset construction of one rule from a fixed start: transitions, accepting, reported."""
    index, todo, table = {m.start: 0}, [m.start], []
    for s in todo:
        row = []
        for b in rep:
            t = m.nfa.move(s, b)
            if not t:
                row.append(-1)
                continue
            if t not in index:
                index[t] = len(todo)
                todo.append(t)
            row.append(index[t])
        table.append(row)
    return table, [bool(s & m.accept) for s in todo], [bool(s & m.good) for s in todo]


def _spans(dfa: tuple, piece: list) -> list[tuple[int, int]]:
    """Reported leftmost non-overlapping matches of one rule in a piece (of byte classes)."""
    table, accept, good = dfa
    got, at, n = [], 0, len(piece)
    while at < n:
        s, i, end, fine = 0, at, -1, False
        while i < n and (s := table[s][piece[i]]) >= 0:
            i += 1
            if accept[s]:
                end, fine = i, good[s]
        if end < 0:
            at += 1
        else:
            if fine:
                got.append((at, end))
            at = end
    return got


def _alone(a: Automaton, s: int, classes: np.ndarray) -> tuple[int, int]:
    """The state after the rest of one piece, and the rules whose matches ended in it."""
    nxt, mask = a.plain(), 0
    for c in classes.tobytes():
        t = nxt[s + c]
        if t < 0:
            mask |= int(a.out[s + c])
            t = -t - 1
        s = t
    return s, mask


def scan(a: Automaton, buf: np.ndarray, off: np.ndarray, lanes: int = 8192) -> list[tuple[int, int, int, int]]:
    """Reported matches in the texts buf[off[i]:off[i+1]]: (text, start byte, rule, end byte)."""
    if not len(buf):
        return []
    size = np.diff(off)
    # cut after the first reset byte of each stretch of PIECE bytes
    r = np.flatnonzero(a.reset[buf])
    doc = np.searchsorted(off, r, side="right") - 1
    stretch = (r - off[doc]) // PIECE
    keep = np.ones(len(r), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1])
    keep &= stretch > 0
    cuts = r[keep] + 1
    full = np.flatnonzero(size)
    start = np.unique(np.concatenate([off[:-1][full], cuts[cuts < off[1:][doc[keep]]]]))
    end = np.append(start[1:], len(buf))
    owner = np.searchsorted(off, start, side="right") - 1
    # empty texts share their offset with the next one: the owner is the text that holds the byte
    order = np.argsort(start - end, kind="stable")
    classes = a.cls[buf]
    hits: dict[int, int] = {}
    for lo in range(0, len(order), lanes):
        k = order[lo:lo + lanes]
        at, left = start[k].copy(), (end - start)[k]
        state = np.zeros(len(k), np.int32)
        live = len(k)
        for t in range(int(left[0])):
            while live and left[live - 1] <= t:
                live -= 1
            if live <= FEW:
                break
            # lanes are sorted by length: the first ``live`` ones still have bytes
            idx = state[:live] + classes[at[:live]]
            nxt = a.nxt[idx]
            if nxt.min() < 0:
                for j in np.flatnonzero(nxt < 0):
                    p = int(k[j])
                    hits[p] = hits.get(p, 0) | int(a.out[idx[j]])
                nxt = np.where(nxt < 0, -nxt - 1, nxt)
            state[:live] = nxt
            at[:live] += 1
        for j in range(live):                # the few pieces left: one plain loop each
            p = int(k[j])
            state[j], mask = _alone(a, int(state[j]), classes[at[j]:end[p]])
            if mask:
                hits[p] = hits.get(p, 0) | mask
        done = a.final[state // a.classes]
        for j in np.flatnonzero(done):
            p = int(k[j])
            hits[p] = hits.get(p, 0) | int(done[j])
    found = []
    for p in sorted(hits):
        lo, piece = int(start[p]), classes[start[p]:end[p]].tolist()
        for i in range(len(a.kinds)):
            if hits[p] >> i & 1:
                found += [(int(owner[p]), lo + s, i, lo + e) for s, e in _spans(a.anchored[i], piece)]
    found.sort()
    return found


def _slice(a: Automaton, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rule, start, end) in code points of every span of a slice of texts, and spans per text."""
    buf, off = utf8(arr)
    got = np.array(scan(a, buf, off), np.int64).reshape(-1, 4)
    each = np.bincount(got[:, 0], minlength=len(arr))
    out = np.empty((len(got), 3), np.int64)
    out[:, 0] = got[:, 2]
    for i in np.unique(got[:, 0]):              # code points are counted in texts with spans only
        at = got[:, 0] == i
        points = np.cumsum(np.concatenate([[0], (buf[off[i]:off[i + 1]] & 0xC0) != 0x80]))
        out[at, 1], out[at, 2] = points[got[at, 1] - off[i]], points[got[at, 3] - off[i]]
    return out, each


# -- on tables --------------------------------------------------------------------------------

SPAN = "array<struct<kind string, start bigint, end bigint>>"


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", rules=RULES) -> DataFrame:
    """Add ``out``: the spans found in every text, by start, then rule order; all rows kept."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(compile_rules(rules))

    @F.arrow_udf(SPAN)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = shared.value
        kinds = pa.array(a.kinds)
        for arr in batches:
            rows = [_slice(a, x) for x in byte_slices(arr)]
            got = np.concatenate([r for r, _ in rows]) if rows else np.zeros((0, 3), np.int64)
            each = np.concatenate([n for _, n in rows]) if rows else np.zeros(0, np.int64)
            item = pa.StructArray.from_arrays(
                [kinds.take(pa.array(got[:, 0])), pa.array(got[:, 1]), pa.array(got[:, 2])], ["kind", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), item)

    own = [c for c in docs.columns if c != out]
    return docs.select(*own, find(F.col(text)).alias(out))


def redact(text: str | Column, spans: str | Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones merged) replaced by ``mark``; null stays null.

    One Arrow pass that joins the stretches between spans, linear in the text."""
    t = F.col(text) if isinstance(text, str) else text
    s = F.col(spans) if isinstance(spans, str) else spans

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, ends in batches:
            yield pa.array([_redact(x.as_py(), a.as_py(), b.as_py(), mark)
                            for x, a, b in zip(texts, starts, ends, strict=True)], pa.string())

    some = F.size(s) > 0                        # only texts with spans travel
    return F.when(some, cut(F.when(some, t), s["start"], s["end"])).otherwise(t)


def _redact(text: str | None, starts: list | None, ends: list | None, mark: str) -> str | None:
    if text is None or not starts:
        return text
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def span_text(spans: str | Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
