"""Vector column functions (N2).  Used where the pairs are already given
(a chunk and its own vector, a check); the nearest-neighbour search itself
lives in ``docket.operators.knn`` and never forms all pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket.functions._util import col as _col

METRICS = ("l2sq", "cosine", "ip")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, v: acc + v)


def vector_distance(a, b, metric: str = "l2sq") -> Column:
    """Squared L2 (default), cosine distance (1 - cos) or inner-product distance (1 - dot)."""
    a = _col(a).cast("array<double>")
    b = _col(b).cast("array<double>")
    if metric == "l2sq":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                           F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    if metric == "ip":
        return F.lit(1.0) - _dot(a, b)
    if metric == "cosine":
        return F.lit(1.0) - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")


def l2_normalize(v) -> Column:
    v = _col(v).cast("array<double>")
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))
