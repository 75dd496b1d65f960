"""Exact top-k search by inner product with a pivot-distance index.

With M the largest norm, a vector x gets one more component sqrt(M^2 - |x|^2) and a query
a zero, after which the squared distance is |q|^2 + M^2 - 2 q.x: the nearest vector is the
one of highest inner product, and the triangle inequality holds.

Index: every vector is keyed by its nearest pivot and its distance to it; rows sorted by
that key are cut into tiles, each an annulus (smallest and largest distance) of one pivot.
Search: a query's own tile gives a first bound on its k-th score; then a pivot's annuli
are expanded outwards around the query's distance to the pivot, and a tile is left out
as soon as |d(q, pivot) - d(x, pivot)| exceeds the bound for all its rows.  Queries go in
blocks against tiles; both are bounded in rows, so hot keys and groups of copies only
make more tiles.  Scores are exact integers; the index loses nothing (recall 1).

The pivots are fitted on a bounded sample (``SAMPLE`` rows by hash of id).

Vectors of each length are searched among themselves: the length is part of the pivot's key.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part, nor do null ids; vectors of different lengths have no score with each other; equal scores
rank by smaller id; rows with an id equal to the query's are never its candidates; rows that
repeat an id and vector count once, several vectors of an id each count; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.llm.common import Scratch, vectors, whole_vectors

K, SCALE = 20, 64
PIVOTS, SAMPLE = 16, 2048
TILE, QBLOCK = 4096, 512
SLACK = 1e-9
LENGTH, PIVOT_BITS = 16, (1 << 16) - 1      # a pivot's key: vector length << 16 | its number


def integers(df: DataFrame, vec: str = "embedding", scale: int = SCALE):
    """The column floor(scale * x), x as double, as array<bigint>."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _fit_pivots(X: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of k-means from farthest-point starts."""
    P = [X[0]]
    d = ((X - P[0]) ** 2).sum(1)
    while len(P) < min(n, len(X)) and d.max() > 0:
        P.append(X[d.argmax()])
        d = np.minimum(d, ((X - P[-1]) ** 2).sum(1))
    P = np.array(P)
    for _ in range(5):
        own = ((X[:, None, :] - P[None]) ** 2).sum(2).argmin(1)
        P = np.array([X[own == i].mean(0) if (own == i).any() else P[i] for i in range(len(P))])
    return P


def _distances(X: np.ndarray, tail: np.ndarray | float, P: np.ndarray) -> np.ndarray:
    """Distances of rows (X, tail) to the pivots, whose last column is the tail's."""
    sq = ((X * X).sum(1) + np.square(tail))[:, None] + (P * P).sum(1) - 2 * (X @ P[:, :-1].T)
    if np.ndim(tail):
        sq -= 2 * np.outer(tail, P[:, -1])
    return np.sqrt(np.maximum(sq, 0))


def _scores(Q: np.ndarray, X: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point while every partial sum is below 2^53."""
    top = float(np.abs(Q).max(initial=0)) * float(np.abs(X).max(initial=0)) * Q.shape[1]
    if top < 2 ** 52:
        return (Q.astype(np.float64) @ X.astype(np.float64).T).astype(np.int64)
    return Q @ X.T


def _best(S: np.ndarray, ids: np.ndarray, qid: np.ndarray, least: np.ndarray, k: int):
    """Per query row, up to k (row, id, score) of the highest scores >= least; ids ascend, so a
    stable sort leaves ties to the smaller id."""
    n = S.shape[1]
    for i in range(len(S)):
        s = S[i]
        ok = np.flatnonzero((s >= least[i]) & (ids != qid[i]))
        if len(ok) > k:
            edge = np.partition(s[ok], len(ok) - k)[len(ok) - k] if n else 0
            ok = ok[s[ok] >= edge]
            ok = ok[np.argsort(-s[ok], kind="stable")][:k]
        yield i, ids[ok], s[ok]


def top_k(df: DataFrame, is_query, ids: str = "vec_id", vec: str = "ints", k: int = K,
          pivots: int = PIVOTS, tile: int = TILE, qblock: int = QBLOCK) -> DataFrame:
    """The k best rows of ``df`` for every row that satisfies the condition ``is_query`` (a
    column over the id): ``query_id, rank, vec_id, score``.  ``vec`` is array<bigint>."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    base = (df.select(F.col(ids).cast("bigint").alias("id"), F.col(vec).alias("v"))
              .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                      & F.forall("v", lambda x: x.isNotNull())))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = base.agg(F.max(norm)).first()[0]
    if top is None:
        return empty
    m2 = top * (1 + SLACK)

    # pivots per length, from a bounded sample; a length outside it has the origin as its pivot
    sample: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    fitted = {}
    for dim, rows in sample.items():
        X = np.array(rows, np.float64)
        fitted[dim] = _fit_pivots(np.column_stack([X, np.sqrt(np.maximum(m2 - (X * X).sum(1), 0))]), pivots)

    def pivots_of(dim: int) -> np.ndarray:
        return fitted[dim] if dim in fitted else np.zeros((1, dim + 1))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.list_value_length(whole.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                b = whole.filter(pa.array(size == dim))
                x = vectors(b.column("v"), dim)
                d = _distances(x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0)), pivots_of(dim))
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), pa.array(dim << LENGTH | own), pa.array(d[np.arange(len(d)), own]),
                     b.column("q")], ["id", "v", "pivot", "dist", "q"])

    flagged = base.withColumn("q", F.coalesce(is_query(F.col("id")), F.lit(False)))
    keyed = flagged.mapInArrow(key, "id bigint, v array<bigint>, pivot bigint, dist double, q boolean")
    # rows by (pivot, distance): contiguous runs are the annuli
    ordered = keyed.dropDuplicates(["id", "v"]).repartitionByRange("pivot", "dist", "id") \
                   .sortWithinPartitions("pivot", "dist", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def tiles(rows, last):
            """Cut off whole tiles; the rest waits for more rows of its pivot."""
            while rows and (last or rows[0][2][0] != rows[-1][2][-1] or sum(len(r[0]) for r in rows) >= tile):
                same = [r for r in rows if r[2][0] == rows[0][2][0]]      # rows of one pivot have one length
                i, v, p, d, q = (np.concatenate([r[j] for r in same]) for j in range(5))
                n = min(tile, len(i))
                yield i[:n], v[:n], int(p[0]), float(d[0]), float(d[n - 1]), q[:n]
                rows[:] = ([(i[n:], v[n:], p[n:], d[n:], q[n:])] if n < len(i) else []) + rows[len(same):]

        for whole in batches:
            pivot = whole.column("pivot").to_numpy()
            for p in np.unique(pivot):                                    # ascending, as the rows are
                lo, hi = np.searchsorted(pivot, p), np.searchsorted(pivot, p, side="right")
                b = whole.slice(lo, hi - lo)
                held.append((b.column("id").to_numpy(), vectors(b.column("v"), int(p) >> LENGTH, np.int64),
                             b.column("pivot").to_numpy(), b.column("dist").to_numpy(),
                             b.column("q").to_numpy(zero_copy_only=False)))
            yield from map(pack, tiles(held, False))
        yield from map(pack, tiles(held, True))

    def pack(t) -> pa.RecordBatch:
        i, v, p, lo, hi, q = t
        o = np.argsort(i, kind="stable")
        i, v, q = i[o], v[o], q[o]
        # first bound of the queries in this tile: their k-th score among its own rows
        own = np.flatnonzero(q)
        least = np.full(len(own), np.iinfo(np.int64).min)
        for at in range(0, len(own), qblock):
            s = own[at:at + qblock]
            S = _scores(v[s], v)
            for r, _, got in _best(S, i, i[s], least[at:at + qblock], k):
                if len(got) >= k:
                    least[at + r] = got.min()
        raw = lambda a: pa.array([np.ascontiguousarray(a, np.int64).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{p}:{lo!r}:{int(i[0])}:{len(i)}"]), pa.array([p], pa.int64()), pa.array([lo]), pa.array([hi]),
             raw(i), raw(v), raw(i[own]), raw(v[own]), raw(least)],
            ["tile", "pivot", "lo", "hi", "ids", "vecs", "qids", "qvecs", "least"])

    index = scratch.table(ordered.mapInArrow(
        cut, "tile string, pivot bigint, lo double, hi double, ids binary, vecs binary, "
             "qids binary, qvecs binary, least binary"))

    # query blocks, each with the interval of distances that can matter, per pivot
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qid, least = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["least"], np.int64)
                v = np.frombuffer(r["qvecs"], np.int64).reshape(len(qid), -1)
                P = pivots_of(v.shape[1])
                for at in range(0, len(qid), qblock):
                    s = slice(at, at + qblock)
                    x = v[s].astype(np.float64)
                    d = _distances(x, 0.0, P)
                    reach = _reach(x, least[s], m2)
                    lo, hi = (d - reach[:, None]).min(0), (d + reach[:, None]).max(0)
                    n = len(P)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{r['tile']}:{at}"] * n), pa.array(v.shape[1] << LENGTH | np.arange(n)),
                         pa.array(lo), pa.array(hi)], ["qblock", "pivot", "qlo", "qhi"])

    queries = index.filter(F.length("qids") > 0)
    meta = queries.select("tile", "qids", "qvecs", "least").mapInArrow(
        blocks, "qblock string, pivot bigint, qlo double, qhi double")
    pairs = (meta.join(index.select("pivot", "tile", "lo", "hi"), "pivot")
                 .filter((F.col("hi") >= F.col("qlo")) & (F.col("lo") <= F.col("qhi")))
                 .select("tile", F.regexp_extract("qblock", r"^(.*):(\d+)$", 1).alias("home"),
                         F.regexp_extract("qblock", r"^(.*):(\d+)$", 2).cast("int").alias("at")))
    cut_of = lambda c, w: F.expr(f"substring({c}, cast(at * {w} + 1 as int), cast({qblock} * {w} as int))")
    work = (pairs.join(queries.select(F.col("tile").alias("home"), "qids", "qvecs", "least"), "home")
                 .select("tile", cut_of("qids", 8).alias("qids"),
                         cut_of("qvecs", "(length(qvecs) div length(qids)) * 8").alias("qvecs"),
                         cut_of("least", 8).alias("least"))
                 .join(index.select("tile", "pivot", "lo", "hi", "ids", "vecs"), "tile"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                r = {c: b.column(c)[j].as_py() for c in b.schema.names}
                qid, least = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["least"], np.int64)
                dim = r["pivot"] >> LENGTH
                v = np.frombuffer(r["qvecs"], np.int64).reshape(-1, dim)
                x = v.astype(np.float64)
                d = _distances(x, 0.0, pivots_of(dim)[r["pivot"] & PIVOT_BITS][None])[:, 0]
                gap = np.maximum(np.maximum(d - r["hi"], r["lo"] - d), 0)
                go = np.flatnonzero(gap <= _reach(x, least, m2))      # triangle inequality
                ids_, X = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vecs"], np.int64).reshape(-1, dim)
                if not len(go):
                    continue
                S = _scores(v[go], X)
                out = [(np.full(len(i), qid[go[n]]), i, s) for n, i, s in _best(S, ids_, qid[go], least[go], k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 ["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


def _reach(x: np.ndarray, least: np.ndarray, m2: float) -> np.ndarray:
    """Distance within which a vector of score >= least lies (unbounded without a bound)."""
    with np.errstate(over="ignore"):
        sq = (x * x).sum(1) + m2 - 2.0 * least
    return np.sqrt(np.maximum(sq, 0)) * (1 + SLACK) + SLACK * np.sqrt(m2 + 1)


def prepare(df: DataFrame, vec: str = "embedding", scale: int = SCALE, out: str = "ints") -> DataFrame:
    """Rows with a usable vector, and its integer form in ``out``."""
    return whole_vectors(df, vec).withColumn(out, integers(df, vec, scale))
