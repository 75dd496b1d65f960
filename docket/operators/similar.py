"""Bigram Dice similarity (N1) and the most similar candidate file per question.

Dice of two strings, after removing all whitespace: equal strings give 1; a
string shorter than 2 gives 0; otherwise 2 * |shared bigrams| / (len a + len b - 2),
shared bigrams counted as a multiset.

J2 plan: every distinct question asks one list of files: those of its module, semester
and subject, or the whole index where these pass nothing.  The names of a list, sorted, are
cut into tiles of bounded size, the questions of a list into blocks, and a block meets the
tiles of its list by an equi-join on the list and a group of few tiles; so a hot list (the
whole index) is many groups, and neither side reaches the driver.

A question's best score so far bounds what is compared: the names of a tile are ordered so that names of
like bigrams are neighbours, and the bigrams that a run of ``RUN`` names holds at all, with its shortest
and longest name, limit the score of each of them.  The run of highest limit seeds the best
score; then names are compared only in runs that can still beat, or tie with, it, and the best
score goes on to the next tile.  Each block and group gives one row per question; an aggregate picks the
best, ties to the first file in index order.

Defined results: a null question counts as an empty one, a null path as an empty one; an
empty index gives no rows.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.route import SUBJECTS
from docket.functions.text import WS
from docket.operators.packs import packed
from docket.operators.route import ANY_NUM, ANY_SUBJ, exploded_file_keys, question_keys
from docket.session import materialize

QUESTION_ROWS, TILE_ROWS = 512, 2048
TILES, HELD, RUN = 8, 16, 4         # tiles that a block meets in one group; blocks held in a task; names per run
LIST = ["_mk", "_sk", "_jk"]


def _occ_tokens(s: str):
    seen: dict[str, int] = {}
    out = []
    for i in range(len(s) - 1):
        bg = sys.intern(s[i:i + 2])         # held by many names and questions
        c = seen.get(bg, 0) + 1
        seen[bg] = c
        out.append((bg, c))
    return out


def dice(a: str, b: str) -> float:
    """N1 on two strings (whitespace is removed here)."""
    a = re.sub(r"\s+", "", a)
    b = re.sub(r"\s+", "", b)
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    inter = len(set(_occ_tokens(a)) & set(_occ_tokens(b)))
    return 2.0 * inter / (len(a) + len(b) - 2)


def strip_ws(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"[{WS}]+", "")


def _bigrams(c: Column) -> Column:
    n = F.length(c) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(2)))
                  ).otherwise(F.array().cast("array<string>"))


def bigram_dice(a, b) -> Column:
    """N1 as a column over given pairs: per shared bigram the smaller of its two counts."""
    pair = F.array(F.struct(strip_ws(a).alias("a"), strip_ws(b).alias("b")))
    grams = F.transform(pair, lambda p: F.struct(
        p["a"].alias("a"), p["b"].alias("b"), _bigrams(p["a"]).alias("ga"), _bigrams(p["b"]).alias("gb")))
    times = lambda g, x: F.size(g) - F.size(F.array_remove(g, x))

    def score(p: Column) -> Column:
        shared = F.aggregate(F.array_intersect(p["ga"], p["gb"]), F.lit(0),
                             lambda acc, x: acc + F.least(times(p["ga"], x), times(p["gb"], x)))
        short = (F.size(p["ga"]) == 0) | (F.size(p["gb"]) == 0)
        return (F.when(p["a"] == p["b"], 1.0).when(p["a"].isNull() | p["b"].isNull(), F.lit(None))
                 .when(short, 0.0).otherwise(2.0 * shared / (F.size(p["ga"]) + F.size(p["gb"]))))

    return F.transform(grams, score)[0]


def _key(file: tuple) -> tuple:
    """(pos, path), a null path first: the order among files of one score."""
    return file[0], file[1] is not None, file[1] or ""


def _tokens(s: str) -> list[str]:
    """The bigrams of a string, each later occurrence marked by its number."""
    return [g if c == 1 else f"{g}\0{c}" for g, c in _occ_tokens(s)]


def _ordered(names: list[str]) -> list[int]:
    """An order of names that puts names of like bigrams side by side: halved again and again at the
    median along the direction of widest spread, down to runs of ``RUN``."""
    if len(names) <= RUN:
        return list(range(len(names)))
    M, _ = _matrix(names)
    done, todo = [], [np.arange(len(names))]
    while todo:
        at = todo.pop()
        if len(at) <= RUN:
            done.append(at)
            continue
        Z = M[at].astype(np.float32)
        Z -= Z.mean(0)
        v = Z[(Z * Z).sum(1).argmax()]
        for _ in range(4):
            v = Z.T @ (Z @ v)
            v /= np.linalg.norm(v) or 1.0
        order = np.argsort(Z @ v, kind="stable")
        half = max(RUN, len(at) // 2 // RUN * RUN)
        todo += [at[order[half:]], at[order[:half]]]
    return np.concatenate(done).tolist()


def _matrix(names: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """Names x bigrams (``_tokens``) as 0 and 1, and the number of each bigram."""
    code = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    name = np.repeat(np.arange(len(names)), [len(s) for s in names])
    at = np.flatnonzero(name[1:] == name[:-1])
    gram, row = code[at] << 21 | code[at + 1], name[at]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    place = np.arange(len(gram))
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])[:len(gram)]
    again = place - np.maximum.accumulate(np.where(new, place, 0))         # occurrences of the bigram before this one
    distinct, col = np.unique(gram << 21 | again, return_inverse=True)
    M = np.zeros((len(names), len(distinct)), np.uint8)
    M[row, col] = 1
    parts = zip((distinct >> 42).tolist(), (distinct >> 21 & 0x1FFFFF).tolist(), (distinct & 0x1FFFFF).tolist(), strict=True)
    return M, {chr(a) + chr(b) + (f"\0{c + 1}" if c else ""): i for i, (a, b, c) in enumerate(parts)}


class Asked:
    """The questions of a block, each distinct bigram of theirs under one number."""

    def __init__(self, qs: list[str]):
        known: dict[str, int] = {}
        held = [[known.setdefault(t, len(known)) for t in _tokens(q)] for q in qs]
        self.qs, self.words = qs, list(known)
        self.n = np.array([len(h) for h in held])
        self.row, self.word = np.repeat(np.arange(len(qs)), self.n), np.array([x for h in held for x in h], np.int64)


class Tile:
    """Names of a list, like ones side by side, with the bigrams that each run of them holds."""

    def __init__(self, names: list[str], keys: list[tuple]):
        self.at, self.keys = {s: i for i, s in enumerate(names)}, keys      # key: (pos, path), the order of ties
        self.M, self.known = _matrix(names)
        self.n = np.array([max(len(s) - 1, 0) for s in names])
        starts = np.arange(0, len(names), RUN)
        self.low, self.high = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)
        self.held = np.maximum.reduceat(self.M, starts, axis=0).astype(np.float32)
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=keys.__getitem__)] = np.arange(len(names))
        self.runs = [lo + np.argsort(rank[lo:lo + RUN]) for lo in starts]    # ties fall to the first of a run
        self.rank, self.head = rank, int(rank.argmin())

    def best(self, block: Asked, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For every question its best name of the tile (its number and score; -1 where none reaches
        ``floor``, the score it has elsewhere), and how many pairs were compared."""
        qs, n = block.qs, block.n
        Q = np.zeros((len(qs), len(self.known)), np.float32)
        col = np.array([self.known.get(w, -1) for w in block.words], np.int64)[block.word]
        Q[block.row[col >= 0], col[col >= 0]] = 1
        limit = _limit(n[:, None], (Q @ self.held.T).astype(np.float64), self.low, self.high)
        win, score = np.full(len(qs), self.head), np.zeros(len(qs))
        seen = 0

        def compare(run: int, rows: np.ndarray) -> None:
            nonlocal seen
            names = self.runs[run]
            S = 2.0 * (Q[rows] @ self.M[names].T.astype(np.float32)).astype(np.float64) / np.maximum(n[rows, None] + self.n[names], 1)
            seen += S.size
            i = S.argmax(1)
            d, at = S[np.arange(len(rows)), i], names[i]
            new = (d > score[rows]) | ((d == score[rows]) & (self.rank[at] < self.rank[win[rows]]))
            win[rows[new]], score[rows[new]] = at[new], d[new]

        first = limit.argmax(1)
        asked = limit.max(1) >= np.maximum(floor, 1e-300)
        for run in np.unique(first[asked]).tolist():
            compare(run, np.flatnonzero(asked & (first == run)))
        left = (limit >= np.maximum(np.maximum(floor, score), 1e-300)[:, None])
        left[np.arange(len(qs)), first] = False
        for run in np.flatnonzero(left.any(0)).tolist():
            rows = np.flatnonzero(left[:, run])
            rows = rows[limit[rows, run] >= score[rows]]        # some have risen meanwhile
            if len(rows):
                compare(run, rows)
        for j, q in enumerate(qs):
            if q in self.at:
                win[j], score[j] = self.at[q], 1.0
        win[score < floor] = -1
        return win, score, seen


def _limit(n, shared, low, high):
    """The highest Dice of ``n`` bigrams with a name of ``low`` to ``high`` ones, ``shared`` of them at most shared."""
    m = np.minimum(np.maximum(shared, low), high)
    return 2.0 * np.minimum(shared, m) / np.maximum(n + m, 1)


def fuzzy_best_file(questions: DataFrame, index: DataFrame, q_id: str = "qid",
                    q_col: str = "question", pos: str = "pos", path: str = "path",
                    link: str = "link", subjects=SUBJECTS,
                    question_rows: int = QUESTION_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(qid, path, link, rating)``, one row per question when the index is not empty."""
    text = F.coalesce(F.col(q_col), F.lit(""))
    asked = (question_keys(questions.select(F.col(q_id).alias("qid"), text.alias("question")), "question", subjects)
             .select("qid", strip_ws(F.lower("question")).alias("_qs"),
                     F.col("_mk").alias("_qm"), F.col("_sk").alias("_qse"), F.col("_jk").alias("_qj")))
    own = ["_qs", "_qm", "_qse", "_qj"]
    asked = materialize(asked, "asked")
    distinct = asked.select(*own).distinct()

    name = F.coalesce(F.col(path), F.lit(""))
    idx = index.select(F.col(pos).cast("bigint").alias("pos"), F.col(path).alias("path"), F.col(link).alias("link"),
                       name.alias("_name"))
    every = idx.select("*", F.lit(ANY_NUM).cast("bigint").alias("_mk"), F.lit(ANY_NUM).cast("bigint").alias("_sk"),
                       F.lit(ANY_SUBJ).alias("_jk"))
    listed = exploded_file_keys(idx, "_name", subjects).select(*every.columns).unionByName(every)
    wanted = (distinct.select(F.col("_qm").alias("_mk"), F.col("_qse").alias("_sk"), F.col("_qj").alias("_jk"))
                      .unionByName(distinct.sparkSession.createDataFrame(
                          [(ANY_NUM, ANY_NUM, ANY_SUBJ)], "_mk bigint, _sk bigint, _jk string")).distinct())
    listed = listed.join(wanted, LIST, "left_semi").select(*LIST, "pos", "path", "link", strip_ws(F.lower("_name")).alias("_fs"))

    # the files of a list by name: distinct names, cut into tiles
    named = listed.groupBy(*LIST, "_fs").agg(F.min_by(F.struct("pos", "path", "link"), F.struct("pos", "path")).alias("_f"))
    order = [*LIST, "_fs"]
    # written before they are ordered: a task holds one Python worker at a time
    cut = materialize(packed(named.select(*order, "_f.*").repartitionByRange(*order).sortWithinPartitions(*order),
                             LIST, ["_fs", "pos", "path", "link"], tile_rows, "tile"), "cut")

    def like(batches):
        """Tiles with their names in the order of likeness."""
        for b in batches:
            for i in range(b.num_rows):
                at = pa.array(_ordered(b.column("_fs")[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), b.column(c)[i].values.take(at))
                     if c in ("_fs", "pos", "path", "link") else b.column(c).slice(i, 1) for c in b.schema.names], b.schema.names)

    tiles = materialize(cut.mapInArrow(like, cut.schema), "tiles")
    sizes = tiles.groupBy(*LIST).agg(F.ceil(F.count(F.lit(1)) / TILES).alias("_groups"))
    has = sizes.select(F.col("_mk").alias("_qm"), F.col("_sk").alias("_qse"), F.col("_jk").alias("_qj"), F.lit(True).alias("_has"))
    routed = distinct.join(has, ["_qm", "_qse", "_qj"], "left").select(
        *own, F.when(F.col("_has"), F.col("_qm")).otherwise(ANY_NUM).cast("bigint").alias("_mk"),
        F.when(F.col("_has"), F.col("_qse")).otherwise(ANY_NUM).cast("bigint").alias("_sk"),
        F.when(F.col("_has"), F.col("_qj")).otherwise(ANY_SUBJ).alias("_jk"))
    blocks = packed(routed.repartitionByRange(*LIST, "_qs").sortWithinPartitions(*LIST, "_qs"), LIST, own, question_rows, "block")
    asked_of = blocks.join(sizes, LIST).withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups") - 1))) \
                     .drop("_groups")
    dealt = tiles.join(sizes, LIST).withColumn("_group", F.pmod(F.xxhash64("tile"), F.col("_groups"))).drop("_groups")
    schema = "_qs string, _qm bigint, _qse bigint, _qj string, score double, pos bigint, path string, link string"

    def meet(batches):
        cache: dict[str, tuple] = {}
        held: dict[str, dict] = {}          # block -> its questions and the best file of each so far

        def give():
            for h in held.values():
                cols = [h["qs"], *h["keys"], h["score"], *zip(*h["file"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
            held.clear()

        for b in batches:
            for i, head in enumerate(b.select(["block", "tile"]).to_pylist()):
                if head["tile"] not in cache:
                    if len(cache) >= TILES:
                        cache.pop(next(iter(cache)))
                    files = list(zip(*[b.column(c)[i].as_py() for c in ("pos", "path", "link")], strict=True))
                    cache[head["tile"]] = (Tile(b.column("_fs")[i].as_py(), [_key(f) for f in files]), files)
                tile, files = cache[head["tile"]]
                if head["block"] not in held:
                    if len(held) >= HELD:
                        yield from give()
                    qs = b.column("_qs")[i].as_py()
                    held[head["block"]] = {"qs": qs, "keys": [b.column(c)[i].as_py() for c in own[1:]], "asked": Asked(qs),
                                           "score": np.full(len(qs), -1.0), "file": [None] * len(qs)}
                h = held[head["block"]]
                win, score, _ = tile.best(h["asked"], h["score"])
                for j in np.flatnonzero(win >= 0).tolist():
                    f = files[win[j]]
                    if score[j] > h["score"][j] or _key(f) < _key(h["file"][j]):
                        h["score"][j], h["file"][j] = score[j], f
        yield from give()

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]
    met = asked_of.join(dealt, [*LIST, "_group"]).mapInArrow(meet, schema)
    best = met.groupBy(*own).agg(F.min_by(F.struct("path", "link", "score"),
                                          F.struct(-F.col("score"), "pos", "path")).alias("_w"))
    return asked.join(best, own).select(F.col("qid").alias(q_id), F.col("_w.path").alias("path"), F.col("_w.link").alias("link"),
                                        F.round("_w.score", 6).alias("rating"))


__all__ = ["dice", "bigram_dice", "fuzzy_best_file", "strip_ws"]
