"""Hard negatives by slots of score between the positives' upper limits.

An anchor's positives are its best-scoring other rows of the same label.  A positive of score u
asks for the best rows of another label with a score in [floor_pct u / 100, u]: windows that
overlap.  The anchor's limits u, sorted downwards, cut the scores into disjoint slots (from one
limit down to the next); every task keeps the top k of each slot, which combine, and the answer
to a window is the first k of its own and all lower slots one after the other: every window of
an anchor is answered from one pass over the rows.

Rows are packed into tiles, anchors into blocks, both bounded in rows; blocks meet tiles by an
equi-join on dealt groups of tiles and of blocks, so no label, copy or anchor makes a hot key.  A
task scores a block against a tile by one product and holds at most k rows per anchor and slot.

Defined results: rows with a null id, a null label, or a vector that is null, empty or holds null
or non-finite components take no part; vectors of different lengths have no score with each other;
rows that repeat each count, as do rows with one id but another label or vector, and rows with
the anchor's id are never its positives or negatives; equal scores rank by smaller id; an anchor without positives has no rows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.llm.common import Scratch, vectors, whole

POSITIVES, NEGATIVES, FLOOR_PCT, SCALE = 5, 5, 80, 256
TILE, BLOCK = 4096, 512             # rows per tile, anchors per block
TILES, BLOCKS = 4, 64               # tiles and blocks that meet under one key
HELD = 64                           # blocks whose best rows a task keeps before it gives them out
NONE = np.iinfo(np.int64).min


def _raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.int64).tobytes()


def _packer(size: int, names: list[str]) -> Callable:
    """mapInArrow function: rows (v array<bigint> and bigint columns) as binary packs of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(cols[0])], pa.int32())]
                + [pa.array([_raw(c)], pa.binary()) for c in cols], ["dim", "n", *names, "v"])

        def take(dim: int, last: bool) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held.pop(dim), strict=True)]
            n = len(cols[0])
            whole_packs = n if last else n - n % size
            for lo in range(0, whole_packs, size):
                yield out(dim, [c[lo:lo + size] for c in cols])
            if whole_packs < n:
                held[dim] = [[c[whole_packs:] for c in cols]]

        for b in batches:
            length = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(length).tolist():
                part = b.filter(pa.array(length == dim))
                held.setdefault(dim, []).append([part.column(c).to_numpy(zero_copy_only=False) for c in names]
                                                + [vectors(part.column("v"), dim, np.int64)])
                if sum(len(r[0]) for r in held[dim]) >= size:
                    yield from take(dim, False)
        for dim in list(held):
            yield from take(dim, True)
    return run


def _pack_schema(names: list[str]) -> str:
    return ", ".join(["dim int", "n int", *[f"{c} binary" for c in names], "v binary"])


def _meet(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every block with every tile of its length, by an equi-join on dealt groups of both."""
    n_tiles, n_blocks = tiles.count(), blocks.count()
    tg, bg = max(1, -(-n_tiles // TILES)), max(1, -(-n_blocks // BLOCKS))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = tiles.select("dim", F.col("ids").alias("t_ids"), F.col("labels").alias("t_labels"), F.col("v").alias("t_v"),
                     F.pmod(F.xxhash64("ids"), F.lit(tg)).cast("int").alias("tg"), upto(bg).alias("bg"))
    b = (blocks.withColumn("bg", F.pmod(F.xxhash64("keys"), F.lit(bg)).cast("int"))
               .withColumn("tg", upto(tg)))
    return b.join(t, ["dim", "tg", "bg"]).drop("tg", "bg")


def _scores(A: np.ndarray, X: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point while every partial sum is below 2^53."""
    top = float(np.abs(A).max(initial=0)) * float(np.abs(X).max(initial=0)) * A.shape[1]
    return (A.astype(np.float64) @ X.astype(np.float64).T).astype(np.int64) if top < 2 ** 52 else A @ X.T


def _top(S: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (NONE: no row) of the k best columns of every row where ``ok``, ties to the
    smaller id."""
    n = S.shape[1]
    by = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    far = int(np.abs(S).max(initial=0)) >= 1 << 48
    order = np.unique(S, return_inverse=True)[1].reshape(S.shape) if far else S
    key = np.where(ok, order * n + (n - 1 - place), NONE)
    if n > k:
        key = np.partition(key, n - k, axis=1)[:, n - k:]
    col = by[(n - 1 - key % n)]
    empty = key == NONE
    got = np.where(empty, NONE, np.take_along_axis(S, col, 1))
    return np.where(empty, 0, ids[col]), got


class _Best:
    """The k best rows per key seen so far in a task, merged pack by pack, given out in batches."""

    def __init__(self, k: int, names: list[str]):
        self.k, self.names, self.held = k, names, {}

    def add(self, name: bytes, keys: list[np.ndarray], ids: np.ndarray, scores: np.ndarray) -> None:
        if name in self.held:
            old = self.held[name]
            ids, scores = np.concatenate([old[1], ids], 1), np.concatenate([old[2], scores], 1)
            o = _order(ids, scores)
            ids, scores = np.take_along_axis(ids, o, 1)[:, :self.k], np.take_along_axis(scores, o, 1)[:, :self.k]
        self.held[name] = (keys, ids, scores)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for keys, ids, scores in self.held.values():
            r, c = np.nonzero(scores != NONE)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(x[r]) for x in keys] + [pa.array(ids[r, c]), pa.array(scores[r, c])],
                                                 [*self.names, "vec_id", "score"])
        self.held = {}


def _order(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Column order per row: by score downwards, then id."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(scores, by_id, 1)
    return np.take_along_axis(by_id, np.argsort(-np.maximum(s, NONE + 1), axis=1, kind="stable"), 1)


def _numbered(df: DataFrame, label: str, scratch: Scratch) -> DataFrame:
    """``df`` with its label as bigint ``l`` (labels of other types are numbered in a written table)."""
    kind = df.schema[label].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return df.withColumn("l", F.col(label).cast("bigint"))
    names = scratch.table(df.select(label).distinct().withColumn("l", F.monotonically_increasing_id()))
    return df.join(names, label)


def mine(df: DataFrame, is_anchor: Callable[[Column], Column], ids: str = "vec_id", label: str = "label",
         vec: str = "ints", positives: int = POSITIVES, negatives: int = NEGATIVES, floor_pct: int = FLOOR_PCT,
         tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``df`` that satisfy ``is_anchor`` (a condition on the id).  ``vec`` is array<bigint>."""
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = df.filter(F.col(ids).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)
                     & F.forall(vec, lambda x: x.isNotNull()))
    rows = _numbered(rows.select(F.col(ids).cast("bigint").alias("ids"), F.col(label).alias("__label"), F.col(vec).alias("v")),
                     "__label", scratch).select("ids", F.col("l").alias("labels"), "v")
    tiles = scratch.table(rows.mapInArrow(_packer(tile, ["ids", "labels"]), _pack_schema(["ids", "labels"])))
    anchors = scratch.table(rows.filter(F.coalesce(is_anchor(F.col("ids")), F.lit(False)))
                                .withColumn("keys", F.monotonically_increasing_id()))
    parts = max(1, -(-anchors.count() // block))

    def blocks_of(df: DataFrame, more: list[str]) -> DataFrame:
        names = ["keys", "ids", "labels", *more]
        packed = df.select(*names, "v").repartition(parts).mapInArrow(_packer(block, names), _pack_schema(names))
        return scratch.table(packed)

    def read(r: dict, more: list[str]) -> tuple:
        i64 = lambda c: np.frombuffer(r[c], np.int64)
        A, X = i64("v").reshape(-1, r["dim"]), i64("t_v").reshape(-1, r["dim"])
        same = i64("labels")[:, None] == i64("t_labels")[None]
        other = i64("ids")[:, None] != i64("t_ids")[None]
        return i64("keys"), i64("t_ids"), _scores(A, X), same, other, [i64(c) for c in more]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for j in range(b.num_rows):
                yield {c: b.column(c)[j].as_py() for c in b.schema.names}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(positives, ["keys"])
        for r in each(batches):
            keys, t_ids, S, same, other, _ = read(r, [])
            best.add(r["keys"], [keys], *_top(S, same & other, t_ids, positives))
            if len(best.held) > HELD:
                yield from best.flush()
        yield from best.flush()

    first = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    found = _meet(blocks_of(anchors, []), tiles).mapInArrow(nearest, "keys bigint, vec_id bigint, score bigint")
    found = found.withColumn("nth", F.row_number().over(first("keys"))).filter(F.col("nth") <= positives)
    limits = scratch.table(found.groupBy("keys").agg(F.sort_array(F.collect_list(
        F.struct("nth", F.col("vec_id").alias("id"), "score"))).alias("pos")))       # at most ``positives`` each

    slots = [f"u{j}" for j in range(positives)]
    bounded = anchors.join(limits, "keys").select("*", *[
        F.coalesce(F.get("pos", F.lit(j))["score"], F.lit(NONE)).alias(u) for j, u in enumerate(slots)])

    def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(negatives, ["keys", "slot"])
        for r in each(batches):
            keys, t_ids, S, same, other, u = read(r, slots)
            ok = ~same & other
            for j in range(positives):
                low = u[j + 1] if j + 1 < positives else np.full(len(keys), NONE)
                # below the slot's own window floor a score is below that of every window above it
                least = np.array([-(-floor_pct * x // 100) if x != NONE else 0 for x in u[j].tolist()], np.int64)
                go = ok & (u[j] != NONE)[:, None] & (S <= u[j][:, None]) & (S > low[:, None]) & (S >= least[:, None])
                if go.any():
                    best.add(r["keys"] + bytes([j]), [keys, np.full(len(keys), j)], *_top(S, go, t_ids, negatives))
            if len(best.held) > HELD:
                yield from best.flush()
        yield from best.flush()

    held = _meet(blocks_of(bounded, slots), tiles).mapInArrow(
        by_slot, "keys bigint, slot bigint, vec_id bigint, score bigint")
    held = held.withColumn("nth", F.row_number().over(first("keys", "slot"))).filter(F.col("nth") <= negatives)
    # slots from a window's limit downwards, one after the other: its first rows are the window's
    merged = held.groupBy("keys").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id")))).alias("neg"))
    big = lambda c: c.cast("decimal(38,0)")
    window = F.slice(F.filter("neg", lambda x: (-x["s"] <= F.col("p.score"))
                              & (big(F.col("p.score")) * floor_pct <= big(-x["s"]) * 100)), 1, negatives)
    return (limits.join(merged, "keys").join(anchors.select("keys", F.col("ids").alias("anchor_id")), "keys")
                  .select("anchor_id", "neg", F.explode("pos").alias("p"))
                  .select("anchor_id", "p", F.posexplode(window).alias("i", "x"))
                  .select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("i") + 1).alias("rank"),
                          F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"),
                          (-F.col("x.s")).alias("negative_score")))


def prepare(df: DataFrame, vec: str = "embedding", scale: int = SCALE, out: str = "ints") -> DataFrame:
    """Rows with a usable vector, and floor(scale * x) of its components in ``out``."""
    return df.filter(whole(vec)).withColumn(out, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))
