from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


SLICE = 1 << 20


def byte_slices(arr: pa.Array, limit: int = SLICE):
    """``arr`` in consecutive slices of about ``limit`` bytes of text (a longer row is a slice of
    its own), so that working arrays do not grow with Spark's batch of rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(arr), 0), np.int64))])
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield arr.slice(lo, hi - lo)
        lo = hi
