"""Nearest chunks per question (J3), by the stored index of ``vector_index``, and top-k per group.

Here are the kernels of the search: placing vectors in a space where the triangle inequality
holds, and the best chunks of one tile for some questions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUND = 6
PAIRS = 1 << 16          # pairs whose exact distances are computed at once
COLUMNS = 2048           # chunks whose products with a block of questions are held at once
EDGE = 2e-6              # rounding can move a distance by half of 1e-6


def top_k_per_group(df: DataFrame, keys, order, k: int, rank_col: str = "rk") -> DataFrame:
    """The first ``k`` rows of each group under ``order`` (ties must be broken by the caller)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
              .filter(F.col(rank_col) <= k))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix, read from its flat values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) != len(col) * dim:
        raise ValueError(f"vector lengths differ from {dim}")
    return flat.reshape(len(col), dim)


def _usable(df: DataFrame, vec: str, metric: str) -> DataFrame:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.filter(F.col(vec).isNotNull() & ok)
    return df.filter(F.exists(vec, lambda x: x != 0)) if metric == "cosine" else df


def _place(X: np.ndarray, metric: str, m2: float | None) -> np.ndarray:
    """Vectors in the search space; ``m2`` (largest squared norm) for chunks under ip."""
    if metric == "cosine":
        return X / np.sqrt((X * X).sum(1))[:, None]
    if metric == "ip":
        tail = np.zeros(len(X)) if m2 is None else np.sqrt(np.maximum(m2 - (X * X).sum(1), 0))
        return np.column_stack([X, tail])
    return X


def _reach(limit: np.ndarray, Q: np.ndarray, metric: str, m2: float) -> np.ndarray:
    """Search-space distance within which a hit of distance <= ``limit`` lies."""
    limit = limit + EDGE
    if metric == "l2sq":
        sq = limit
    elif metric == "cosine":
        sq = 2 * limit
    else:
        sq = (Q * Q).sum(1) + m2 - 2 * (1 - limit)
    return np.sqrt(np.maximum(sq, 0))


def _exact(Q: np.ndarray, C: np.ndarray, qn: np.ndarray, cn: np.ndarray, r: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2sq":
        return ((Q[r] - C[c]) ** 2).sum(1)
    d = (Q[r] * C[c]).sum(1)
    return 1 - (d if metric == "ip" else d / (np.sqrt(qn[r]) * np.sqrt(cn[c])))


def _single(X: np.ndarray, metric: str, stored: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Vectors in single precision with one more component, so that one product ``q . c`` is ``base + e |c|^2 - distance``
    (``base``: |q|^2 for l2sq, else 1; ``e``: ``_slack``), and their squared norms; None beyond its range."""
    X = _place(X, metric, None) if metric == "cosine" else X
    n = (X * X).sum(1)
    if n.max(initial=0) > 1e30:
        return None
    e = _slack(X.shape[1])
    one = np.ones(len(X)) if not stored else (e - 1) * n if metric == "l2sq" else e * n
    return np.column_stack([2 * X if stored and metric == "l2sq" else X, one]).astype(np.float32), n


def _slack(dim: int) -> float:
    """Twice what rounding in single precision can add to a product, as a share of |q|^2 + 2 |c|^2."""
    return 4 * (dim + 8) * 2.0 ** -24


def _where(near: np.ndarray) -> np.ndarray:
    """Flat places of the few true values, found eight at a time."""
    if not near.flags.c_contiguous or near.size % 8:
        return np.flatnonzero(near)
    eights = np.flatnonzero(near.reshape(-1).view(np.uint64))
    i, j = np.nonzero(near.reshape(-1, 8)[eights])
    return 8 * eights[i] + j


def _near_single(q: tuple, c: tuple, limit: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may lie within ``limit``, by products in single precision; none that does is missed."""
    (L, qn), (R, cn) = q, c
    e = _slack(L.shape[1] - 1)
    base = qn if metric == "l2sq" else np.ones(len(qn))
    least = lambda at: np.nextafter((base[at] - limit[at] - EDGE - e * qn[at]).astype(np.float32), np.float32(-np.inf))[:, None]
    found, limit = [(np.zeros(0, np.int64),) * 2], limit.copy()
    for lo in range(0, len(R), COLUMNS):
        S = L @ R[lo:lo + COLUMNS].T
        near = S >= least(slice(None))
        r, c_ = np.divmod(_where(near), S.shape[1])
        many = np.flatnonzero(np.bincount(r, minlength=len(L)) > 8 * k)
        if len(many):           # rows that a k-th distance of their own bounds better, here and in later columns
            own = S[many]
            kth = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k]
            limit[many] = np.minimum(limit[many], base[many] - kth + e * (qn[many] + 2 * cn.max()))
            near[many] = own >= least(many)
            r, c_ = np.divmod(_where(near), S.shape[1])
        found.append((r, c_ + lo))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _near_double(Q: np.ndarray, C: np.ndarray, limit: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The same in double precision."""
    qn, cn = (Q * Q).sum(1), (C * C).sum(1)
    dot = Q @ C.T
    scale = qn[:, None] + cn[None]
    if metric == "l2sq":
        D = scale - 2 * dot
    elif metric == "ip":
        D = 1 - dot
    else:
        D = 1 - dot / np.sqrt(qn[:, None] * cn[None])
        scale = np.ones_like(D)
    err = 1e-14 * Q.shape[1] * scale + 1e-12
    D -= err
    near = D <= (limit + EDGE)[:, None]
    many = np.flatnonzero(near.sum(1) > 8 * k)
    if len(many):
        kth = np.partition(D[many] + 2 * err[many], k - 1, axis=1)[:, k - 1]
        near[many] = D[many] <= (np.minimum(kth, limit[many]) + EDGE)[:, None]
    return np.nonzero(near)


def _hits(Q: np.ndarray, C: np.ndarray, rank: np.ndarray, limit: np.ndarray, k: int, metric: str,
          q: tuple | None = None, c: tuple | None = None):
    """(question row, chunk row, distance) of up to k chunks per question within ``limit``.

    ``q``, ``c``: the rows as ``_single`` gives them, where they are held.  Single precision leaves few pairs unless
    distances are small beside the norms; then double precision tells them apart."""
    q, c = q or _single(Q, metric, False), c or _single(C, metric, True)
    near = _near_single(q, c, limit, k, metric) if q and c else None
    if near is None or len(near[0]) > max(len(Q) * len(C) // 16, 8 * k * len(Q)):
        parts = [_near_double(Q, C[lo:lo + COLUMNS], limit, k, metric) for lo in range(0, len(C), COLUMNS)]
        near = tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in ([r for r, _ in parts], [at + i * COLUMNS for i, (_, at) in enumerate(parts)]))
    r, c = near
    qn, cn = (Q * Q).sum(1), (C * C).sum(1)
    d = np.concatenate([np.zeros(0), *(_exact(Q, C, qn, cn, r[lo:lo + PAIRS], c[lo:lo + PAIRS], metric) for lo in range(0, len(r), PAIRS))])
    d = np.round(d, ROUND) + 0.0
    order = np.lexsort((rank[c], d, r))
    r, c, d = r[order], c[order], d[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep], d[keep]


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int = 5, metric: str = "l2sq",
                   q_id: str = "qid", q_vec: str = "vector", c_id: str = "id", c_vec: str = "vector",
                   index=None) -> DataFrame:
    """``(qid, id, dist, rk)`` for the ``k`` chunks nearest each question vector.

    ``index``: the stored index of ``chunks`` (``vector_index.build_index``), which is then searched;
    without it one is built for this call."""
    from docket.operators import vector_index as V
    index = index or V.build_index(chunks, None, metric, c_id, c_vec)
    if index.tree is not None and index.tree.metric != metric:
        raise ValueError(f"the index holds distances of {index.tree.metric!r}, not {metric!r}")
    return V.search(index, questions, k, q_id, q_vec)
