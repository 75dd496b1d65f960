"""A stored index of a collection's vectors, nested in two levels, for nearest chunks.

The index is a table beside the collection.  A tree of median cuts (at most ``LEAVES`` leaves,
fitted on a bounded sample) gives every chunk a leaf; the rows of a leaf, in order of their distance
to the leaf's centre, are cut into tiles of at most ``TILE`` rows, so tiles grow with the
collection and each is a shell ``[near, far]`` around its leaf's centre.  The tree and one row per
leaf (its extent) are all that reaches the driver.  ``extend`` adds the tiles of new rows under the
stored tree; nothing stored is written again.

A search packs questions in blocks, and blocks of near leaves in groups.  Each question first meets one
tile of its nearest leaf, which bounds the distance of its k-th hit; the tiles whose shell at least one
question of a part can reach are then sent to it, and a task lets a slab of them pass by a group's blocks,
whose bounds shrink as they go.  Tiles travel once per group, questions once per slab; the numbers of groups
and slabs follow from the sizes, so what is shuffled grows with the input while parts fit ``GROUP``.  Pairs are
sifted by products in single precision, whose rounding is allowed for.

All metrics search in a space where the triangle inequality holds: vectors as they are (l2sq),
normalised (cosine), or with one more component that makes all norms equal (ip).  Distances of
possible hits are computed by direct differences and rounded, ties broken by chunk id: the result
equals an exhaustive search.

Defined results: chunks with a null id, and chunks or questions whose vector is null or holds null or
non-finite components, take no part, nor do zero vectors under cosine; rows that repeat a chunk's
id and vector count once; every row of ``questions`` is answered for itself; a question with
fewer than k chunks gets them all; vectors of unequal length are an error; an empty
collection answers nothing.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docket.functions.vectors import METRICS
from docket.operators.knn import _hits, _matrix, _place, _reach, _single, _usable, top_k_per_group
from docket.session import delete_path, materialize, path_exists, scratch_path

LEAVES, LEAF_ROWS, PER_LEAF = 2048, 256, 16      # sample rows: 16 per leaf or more, at most LEAVES * PER_LEAF
TILE, BLOCK = 2048, 512
GROUP, HELD = 65536, 1 << 27        # questions that pass a tile together, and bytes of their vectors
SLAB, PASS = 1 << 27, 1 << 22       # bytes of vectors in the tiles of one task, and in those that pass a block at once


@dataclass
class Tree:
    """Median cuts along leading directions, as a heap of nodes; leaf centres in the search space."""

    metric: str
    dim: int
    m2: float                   # largest squared norm of the fitted rows (ip only)
    cuts: np.ndarray            # nodes x width
    at: np.ndarray              # nodes
    centres: np.ndarray         # leaves x width

    def leaf(self, X: np.ndarray) -> np.ndarray:
        node = np.zeros(len(X), np.int64)
        for _ in range(len(self.centres).bit_length() - 1):
            node = 2 * node + 1 + ((X * self.cuts[node]).sum(1) > self.at[node])
        return node - (len(self.centres) - 1)

    def place(self, V: np.ndarray, stored: bool) -> np.ndarray:
        return _place(V, self.metric, self.m2 if stored else None)

    def distances(self, X: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows to leaf centres, and how far each may be off."""
        C = self.centres[leaves]
        size = (X * X).sum(1)[:, None] + (C * C).sum(1)
        return np.sqrt(np.maximum(size - 2 * X @ C.T, 0)), np.sqrt(4e-16 * X.shape[1] * size) + 1e-9

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, metric=self.metric, dim=self.dim, m2=self.m2, cuts=self.cuts, at=self.at, centres=self.centres)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        z = np.load(io.BytesIO(raw))
        return Tree(str(z["metric"]), int(z["dim"]), float(z["m2"]), z["cuts"], z["at"], z["centres"])


def _fit(S: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of a sample: at every node the median along the direction of widest spread."""
    nodes = 2 ** depth - 1
    cuts, at = np.zeros((nodes, width)), np.full(nodes, np.inf)
    parts: dict[int, np.ndarray] = {0: np.arange(len(S))}
    middle = {0: S.mean(0) if len(S) else np.zeros(width)}
    for i in range(nodes):
        rows = S[parts[i]]
        left, right = parts[i], parts[i][:0]
        if len(rows) > 1:
            Z = rows - rows.mean(0)
            v = Z[(Z * Z).sum(1).argmax()]
            for _ in range(8):                          # power iteration
                v = Z.T @ (Z @ v)
                n = np.linalg.norm(v)
                if not n:
                    break
                v = v / n
            p = rows @ v
            cut = np.median(p)
            if (p > cut).any():
                cuts[i], at[i] = v, cut
                left, right = parts[i][p <= cut], parts[i][p > cut]
        for j, part in ((2 * i + 1, left), (2 * i + 2, right)):
            parts[j] = part
            middle[j] = S[part].mean(0) if len(part) else middle[i]
    return cuts, at, np.array([middle[nodes + j] for j in range(nodes + 1)])


@dataclass
class VectorIndex:
    """An opened index: its tree, its folder, and the extent of every leaf that holds rows."""

    spark: SparkSession
    path: str
    id_type: str
    tree: Tree | None = None
    extent: dict[int, tuple[float, float, str]] = field(default_factory=dict)    # leaf -> near, far, its first tile
    tiles: int = 0
    rows: int = 0

    def read(self) -> DataFrame:
        return self.spark.read.schema(_tile_schema(self.id_type) + ", batch string").parquet(os.path.join(self.path, "tiles"))

    def refresh(self) -> VectorIndex:
        """Read the leaves' extents anew (after tiles were added)."""
        if self.tree is not None:
            got = self.read().groupBy("leaf").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.min("tile").alias("tile"),
                                                  F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("n")).collect()
            self.extent = {r["leaf"]: (r["near"], r["far"], r["tile"]) for r in got}         # at most LEAVES rows
            self.tiles, self.rows = sum(r["tiles"] for r in got), sum(r["n"] for r in got)
        return self


def _tile_schema(id_type: str) -> str:
    return f"tile string, leaf int, near double, far double, n int, ids array<{id_type}>, v binary"


def _chunks(chunks: DataFrame, c_id: str, c_vec: str, metric: str) -> DataFrame:
    rows = chunks.select(F.col(c_id).alias("id"), F.col(c_vec).cast("array<double>").alias("v"))
    return _usable(rows.filter(F.col("id").isNotNull()), "v", metric)


def _sizes(rows: DataFrame):
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dim"),
                    F.max(norm).alias("m2")).first()


def _write_tiles(rows: DataFrame, tree: Tree, path: str, batch: str) -> None:
    """Tiles of ``(id, v)`` rows in the folder of ``batch`` (a batch written again replaces itself)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                X = tree.place(_matrix(b.column("v"), tree.dim), True)
                leaf = tree.leaf(X)
                far = np.sqrt(((X - tree.centres[leaf]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf.astype(np.int32)), pa.array(far)],
                                                 ["id", "v", "leaf", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []                  # ids, vectors, leaf, far: rows not yet in a tile
        part, made, before = TaskContext.get().partitionId(), 0, (None, b"")

        def tile(ids: pa.Array, V: np.ndarray, leaf: int, far: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{batch}-{part:06d}-{made:06d}"]), pa.array([leaf], pa.int32()), pa.array([far[0]]), pa.array([far[-1]]),
                 pa.array([len(ids)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([np.ascontiguousarray(V).tobytes()], pa.binary())], ["tile", "leaf", "near", "far", "n", "ids", "v"])

        def tiles(last: bool) -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([h[0] for h in held])
            V, leaf, far = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            held.clear()
            edges = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                while lo < hi and (last or hi < len(leaf) or hi - lo >= TILE):
                    to = min(lo + TILE, hi)
                    yield tile(ids[lo:to], V[lo:to], int(leaf[lo]), far[lo:to])
                    lo = to
                if lo < hi:
                    held.append((ids[lo:hi], V[lo:hi], leaf[lo:hi], far[lo:hi]))

        for b in batches:
            if not b.num_rows:
                continue
            ids, V = b.column("id"), _matrix(b.column("v"), tree.dim)
            # rows that repeat an id and vector are neighbours in this order
            values = ids.to_pylist()
            again = np.array([values[0] == before[0] and V[0].tobytes() == before[1],
                              *(x == y and bool((V[i] == V[i + 1]).all()) for i, (x, y) in enumerate(zip(values[:-1], values[1:], strict=True)))])
            before = (values[-1], V[-1].tobytes())
            keep = np.flatnonzero(~again)
            if len(keep):
                at = pa.array(keep)
                held.append((ids.take(at), V[keep], b.column("leaf").to_numpy()[keep], b.column("far").to_numpy()[keep]))
            if sum(len(h[0]) for h in held) >= TILE:
                yield from tiles(False)
        if held:
            yield from tiles(True)

    order = ["leaf", "far", "id"]
    routed = rows.mapInArrow(route, f"id {id_type}, v array<double>, leaf int, far double")
    packed = routed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _tile_schema(id_type))
    packed.write.mode("overwrite").parquet(os.path.join(path, "tiles", f"batch={batch}"))


def _sample(rows: DataFrame, n: int, want: int) -> pa.ChunkedArray:
    """The vectors of the ``want`` least hashes of an id.  Of many rows only those of low hashes are
    sorted: the one task that merges what tasks send would else read nearly all."""
    hashed = rows.select("v", F.xxhash64("id").alias("h"))
    least = lambda df: df.orderBy("h").limit(want).select("v").toArrow().column("v")
    if n > 4 * want:
        some = least(hashed.filter(F.col("h") < F.lit(2 * want * (1 << 64) // n - (1 << 63))))
        if len(some) == want:
            return some
    return least(hashed)


def build_index(chunks: DataFrame, path: str | None = None, metric: str = "l2sq", c_id: str = "id", c_vec: str = "vector",
                batch: str = "0", leaf_rows: int | None = None) -> VectorIndex:
    """Fit and write the index of a collection at ``path`` (a scratch table without it): a leaf per
    ``LEAF_ROWS`` rows beyond the first tile, or per ``leaf_rows``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")
    spark = chunks.sparkSession
    path = path or scratch_path(spark, "vectors")
    rows = _chunks(chunks, c_id, c_vec, metric)
    index = VectorIndex(spark, path, rows.schema["id"].dataType.simpleString())
    for part in ("tree", "tiles"):                  # a former index there, the tree that makes it whole first
        delete_path(spark, os.path.join(path, part))
    size = _sizes(rows)
    if not size["n"] or not size["dim"]:
        return index
    if size["low"] != size["dim"]:
        raise ValueError(f"vector lengths differ from {size['dim']}")
    leaves = max(1, min(LEAVES, size["n"] // leaf_rows if leaf_rows else (size["n"] - TILE) // LEAF_ROWS))
    depth = (leaves - 1).bit_length()
    shell = Tree(metric, size["dim"], size["m2"] if metric == "ip" else 0.0, np.zeros((0, 0)), np.zeros(0), np.zeros((1, 0)))
    width = size["dim"] + (metric == "ip")
    want = 2 ** depth * max(PER_LEAF, min(256, LEAVES * PER_LEAF >> depth))
    S = shell.place(_matrix(_sample(rows, size["n"], want), size["dim"]), True)
    index.tree = Tree(metric, size["dim"], shell.m2, *_fit(S, depth, width))
    _write_tiles(rows, index.tree, path, batch)
    spark.createDataFrame([(bytearray(index.tree.dump()), index.id_type)], "tree binary, id_type string").coalesce(1) \
         .write.mode("overwrite").parquet(os.path.join(path, "tree"))       # last: an index with a tree is whole
    return index.refresh()


def index_exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, os.path.join(path, "tree", "_SUCCESS"))


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    row = spark.read.parquet(os.path.join(path, "tree")).first()
    return VectorIndex(spark, path, row["id_type"], Tree.load(bytes(row["tree"]))).refresh()


def extend(index: VectorIndex, chunks: DataFrame, batch: str, c_id: str = "id", c_vec: str = "vector") -> VectorIndex:
    """Add the tiles of new chunks under the stored tree; nothing stored is read or written again.

    ``batch`` names the rows: the same batch sent again replaces itself.  Under ``ip`` a row longer than
    all the index was fitted on does not fit its space: build anew then."""
    if index.tree is None:
        raise ValueError("the index holds nothing yet: build it")
    rows = _chunks(chunks, c_id, c_vec, index.tree.metric)
    size = _sizes(rows)
    if size["n"]:
        if (size["low"], size["dim"]) != (index.tree.dim, index.tree.dim):
            raise ValueError(f"vector lengths differ from {index.tree.dim}")
        if index.tree.metric == "ip" and size["m2"] > index.tree.m2:
            raise ValueError("a vector is longer than those the index was built on: build it anew")
        _write_tiles(rows, index.tree, index.path, batch)
    return index.refresh()


def _group(dim: int) -> int:
    return max(1, min(GROUP, HELD // (8 * dim)))


def _grid(n: int, rows: int, dim: int, cores: int, block: int = BLOCK) -> tuple[int, int]:
    """Parts of ``n`` questions and slabs of ``rows`` chunks: tiles travel once per part, questions once per slab, so where
    cores ask for more cells than memory does, the side of more rows is cut."""
    parts, slabs = max(1, -(-n // _group(dim))), max(1, -(-rows * dim * 8 // SLAB))
    if rows >= n:
        slabs = max(slabs, min(-(-2 * cores // parts), -(-rows // TILE)))
    parts = max(parts, min(-(-2 * cores // slabs), -(-n // block)))
    if rows < n:
        slabs = max(slabs, min(-(-2 * cores // parts), -(-rows // TILE)))
    return parts, slabs


def search(index: VectorIndex, questions: DataFrame, k: int = 5, q_id: str = "qid", q_vec: str = "vector",
           block: int = BLOCK) -> DataFrame:
    """``(qid, id, dist, rk)``: the ``k`` chunks nearest each question vector."""
    spark, tree = index.spark, index.tree
    q_type, c_type = questions.schema[q_id].dataType.simpleString(), index.id_type
    if tree is None or not index.extent:
        return spark.createDataFrame([], f"qid {q_type}, id {c_type}, dist double, rk bigint")
    live = np.array(sorted(index.extent))
    shells = np.array([index.extent[i][:2] for i in live.tolist()])
    home_tile = pa.array([index.extent[i][2] for i in live.tolist()])
    dim, metric = tree.dim, tree.metric
    at_once = max(TILE, PASS // (8 * dim))
    qs = _usable(questions.select(F.col(q_id).alias("qid"), F.col(q_vec).cast("array<double>").alias("v")), "v", metric)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Questions with their nearest leaf."""
        for b in batches:
            if b.num_rows:
                V = _matrix(b.column("v"), dim)
                home = np.concatenate([tree.distances(tree.place(V[lo:lo + block], False), live)[0].argmin(1)
                                       for lo in range(0, len(V), block)])
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("v"), pa.array(home.astype(np.int32))], ["qid", "v", "home"])

    routed = materialize(qs.mapInArrow(route, f"qid {q_type}, v array<double>, home int"), "routed")
    # the grid of the search: slabs of tiles x parts of questions, no more of either than memory or cores ask for
    parts, slabs = _grid(routed.count(), index.rows, dim, spark.sparkContext.defaultParallelism, block)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of questions of near leaves; a part's blocks are groups of at most ``GROUP`` questions."""
        part, made, held = TaskContext.get().partitionId(), 0, []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, V, home = (pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))
            held.clear()
            for lo in range(0, len(home), block):
                if lo + block > len(home) and not last:
                    held.append((ids[lo:], V[lo:], home[lo:]))
                    return
                hi = min(lo + block, len(home))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{made}"]), pa.array([part % parts], pa.int32()), pa.array([made // max(1, _group(dim) // block)], pa.int32()),
                     pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids[lo:hi]),
                     pa.array([np.ascontiguousarray(V[lo:hi]).tobytes()], pa.binary()), pa.array([home[lo:hi].tobytes()], pa.binary())],
                    ["block", "part", "grp", "qids", "qv", "home"])
                made += 1

        for b in batches:
            if b.num_rows:
                held.append((b.column("qid"), _matrix(b.column("v"), dim), b.column("home").to_numpy()))
                if sum(len(h[0]) for h in held) >= block:
                    yield from out(False)
        if held:
            yield from out(True)

    order = ["home", F.xxhash64("v")]
    blocks = materialize(routed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        pack, f"block string, part int, grp int, qids array<{q_type}>, qv binary, home binary"), "questions")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The questions of a block by home leaf, each sent to that leaf's first tile."""
        for b in batches:
            for r in b.to_pylist():
                home, V = np.frombuffer(r["home"], np.int32), np.frombuffer(r["qv"]).reshape(-1, dim)
                for leaf in np.unique(home):
                    at = np.flatnonzero(home == leaf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["block"]]), home_tile.take(pa.array([leaf])), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                         pa.array([[r["qids"][i] for i in at]], ids_type), pa.array([V[at].tobytes()], pa.binary())],
                        ["block", "tile", "nth", "qids", "qv"])

    ids_type = pa.list_(to_arrow_type(questions.schema[q_id].dataType))
    found = f"block string, nth int, qid {q_type}, id {c_type}, dist double"

    def best_of(block_: str, V: np.ndarray, nth: np.ndarray, qids: pa.Array, lim: np.ndarray, C: np.ndarray, ids: pa.Array,
                rank: np.ndarray, q: tuple | None = None, c: tuple | None = None) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """The k best of some chunks for some questions, as rows, and again as (question, distance)."""
        r, c, d = _hits(V, C, rank, lim, k, metric, q, c)
        return pa.RecordBatch.from_arrays([pa.array([block_] * len(r), pa.string()), pa.array(nth[r]), qids.take(pa.array(r)),
                                           ids.take(pa.array(c)), pa.array(d)], ["block", "nth", "qid", "id", "dist"]), r, d

    def ranks(ids: pa.Array) -> np.ndarray:
        return np.argsort(np.argsort(np.asarray(ids.to_numpy(zero_copy_only=False)), kind="stable"), kind="stable")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                V, C = np.frombuffer(b.column("qv")[i].as_py()).reshape(-1, dim), np.frombuffer(b.column("v")[i].as_py()).reshape(-1, dim)
                ids = b.column("ids")[i].values
                yield best_of(b.column("block")[i].as_py(), V, np.frombuffer(b.column("nth")[i].as_py(), np.int32),
                              b.column("qids")[i].values, np.full(len(V), np.inf), C, ids, ranks(ids))[0]

    one = ["block", "nth"]
    rank_order = [F.col("dist"), F.col("id")]
    # payloads compress well on disk: without the hint Spark would take them for small and send them through the driver
    near = (blocks.mapInArrow(at_home, f"block string, tile string, nth binary, qids array<{q_type}>, qv binary")
                  .join(index.read().select("tile", "ids", "v").hint("merge"), "tile").mapInArrow(meet, found))
    if index.tiles > 1:
        bound = (near.groupBy(*one).agg(F.max("dist").alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
                     .groupBy("block").agg(F.collect_list(F.struct("nth", "m")).alias("lims")))      # at most a block's questions
        asked = materialize(blocks.join(bound.hint("merge"), "block", "left"), "bounds")

        def limits(lims: list | None, n: int) -> np.ndarray:
            lim = np.full(n, np.inf)
            for x in lims or ():
                lim[x["nth"]] = x["m"]
            return lim

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The leaves a block visits, with the interval of distances that matters in each."""
            for b in batches:
                for r in b.select(["part", "qv", "lims"]).to_pylist():
                    V = np.frombuffer(r["qv"]).reshape(-1, dim)
                    d, err = tree.distances(tree.place(V, False), live)
                    reach = (_reach(limits(r["lims"], len(V)), V, metric, tree.m2) * (1 + 1e-9))[:, None] + err
                    lo, hi = d - reach, d + reach
                    see = (lo <= shells[:, 1]) & (hi >= shells[:, 0])
                    go = np.flatnonzero(see.any(0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["part"]] * len(go), pa.int32()), pa.array(live[go].astype(np.int32)),
                         pa.array(np.where(see, lo, np.inf).min(0)[go]), pa.array(np.where(see, hi, -np.inf).max(0)[go])],
                        ["part", "leaf", "lo", "hi"])

        class Block:
            """A block's questions with the distances of the k best chunks each has met so far."""

            def __init__(self, b: pa.RecordBatch, i: int):
                self.name, self.qids = b.column("block")[i].as_py(), b.column("qids")[i].values
                self.V = np.frombuffer(b.column("qv")[i].as_py()).reshape(-1, dim)
                self.lim = limits(b.column("lims")[i].as_py(), len(self.V))
                self.best = np.full((len(self.V), k), np.inf)
                self.single = _single(self.V, metric, False)

            def meet(self, leaf: np.ndarray, near_: np.ndarray, far: np.ndarray, of: np.ndarray, C: np.ndarray, ids: pa.Array,
                     rank: np.ndarray, single: tuple | None) -> pa.RecordBatch | None:
                """Against some tiles (``of``: the tile of each chunk): those that a question can reach."""
                d, err = tree.distances(tree.place(self.V, False), leaf)
                reach = (_reach(self.lim, self.V, metric, tree.m2) * (1 + 1e-9))[:, None] + err
                go = (d - reach <= far) & (d + reach >= near_)
                at, tiles = np.flatnonzero(go.any(1)), go.any(0)
                if not len(at):
                    return None
                if not tiles.all():
                    cs = np.flatnonzero(tiles[of])
                    C, ids, rank, single = C[cs], ids.take(pa.array(cs)), rank[cs], single and (single[0][cs], single[1][cs])
                rows, r, dist = best_of(self.name, self.V[at], at.astype(np.int32), self.qids.take(pa.array(at)), self.lim[at], C, ids, rank,
                                        self.single and (self.single[0][at], self.single[1][at]), single)
                new = np.full((len(at), k), np.inf)
                new[r, np.arange(len(r)) - np.searchsorted(r, r)] = dist
                self.best[at] = np.sort(np.concatenate([self.best[at], new], 1), 1)[:, :k]
                self.lim = np.minimum(self.lim, self.best[:, -1])
                return rows

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A slab's tiles, one after the other, past the blocks of a group, which come first."""
            held: list[Block] = []
            tiles: list[tuple] = []
            group = None

            def pass_by() -> Iterator[pa.RecordBatch]:
                leaf, near_, far = (np.array([t[j] for t in tiles]) for j in range(3))
                own = np.searchsorted(live, leaf)
                ids, C = pa.concat_arrays([t[3] for t in tiles]), np.concatenate([t[4] for t in tiles])
                of, rank = np.repeat(np.arange(len(tiles)), [len(t[3]) for t in tiles]), ranks(ids)
                tiles.clear()
                single = _single(C, metric, True)
                for q in held:
                    rows = q.meet(own, near_, far, of, C, ids, rank, single)
                    if rows is not None and rows.num_rows:
                        yield rows

            for b in batches:
                heads = b.select(["part", "slab", "grp", "tile", "leaf", "near", "far"]).to_pylist()
                for i, h in enumerate(heads):
                    if (h["part"], h["slab"], h["grp"]) != group:
                        if tiles:
                            yield from pass_by()
                        held.clear()
                        group = (h["part"], h["slab"], h["grp"])
                    if h["tile"] is None:
                        held.append(Block(b, i))
                        continue
                    tiles.append((h["leaf"], h["near"], h["far"], b.column("ids")[i].values,
                                  np.frombuffer(b.column("v")[i].as_py()).reshape(-1, dim)))
                    if sum(len(t[3]) for t in tiles) >= at_once:
                        yield from pass_by()
            if tiles:
                yield from pass_by()

        slab = F.pmod(F.xxhash64("tile"), F.lit(slabs)).cast("int").alias("slab")
        visits = asked.mapInArrow(visit, "part int, leaf int, lo double, hi double").groupBy("part", "leaf").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        pairs = (visits.join(index.read().select("tile", "leaf", "near", "far"), "leaf")
                       .filter((F.col("far") >= F.col("lo")) & (F.col("near") <= F.col("hi"))).select("part", "tile"))
        groups = asked.select("part", "grp").distinct()
        sent = (pairs.join(groups, "part").join(index.read().select("tile", "leaf", "near", "far", "ids", "v").hint("merge"), "tile")
                     .withColumn("slab", slab))
        asking = asked.drop("home").withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
        cells = asking.unionByName(sent, allowMissingColumns=True).repartitionById(
            parts * slabs, (F.col("part") * slabs + F.col("slab")).cast("int"))
        near = cells.sortWithinPartitions("part", "slab", "grp", F.col("tile").asc_nulls_first()).mapInArrow(sweep, found)
    return top_k_per_group(near, one, rank_order, k).select("qid", "id", "dist", "rk")
