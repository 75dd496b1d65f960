"""Sorted rows as packs: one row per run of equal keys, of bounded size, its values in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, keys: list[str], values: list[str], size: int, name: str = "pack") -> DataFrame:
    """``df`` (each partition sorted by the non-null ``keys``) as rows of keys and arrays of values:
    at most ``size`` rows of one key in each, under a ``name`` of its own."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in [*keys, *values]}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        part, made = TaskContext.get().partitionId(), 0

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            one = pa.array([0, t.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{made}"])] + [t.column(k).slice(0, 1).combine_chunks() for k in keys]
                + [pa.ListArray.from_arrays(one, t.column(v).combine_chunks()) for v in values], [name, *keys, *values])

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            n = t.num_rows
            new = np.zeros(n - 1, bool)
            for k in keys:
                c = t.column(k)
                new |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                while lo < hi and (last or hi < n or hi - lo >= size):
                    yield out(t.slice(lo, min(size, hi - lo)))
                    lo = min(lo + size, hi)
                if lo < hi:
                    held.append(t.slice(lo, hi - lo))

        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                if sum(t.num_rows for t in held) >= size:
                    yield from cut(False)
        if held:
            yield from cut(True)

    schema = ", ".join([f"{name} string", *[f"{k} {kinds[k]}" for k in keys], *[f"{v} array<{kinds[v]}>" for v in values]])
    return df.select(*[F.col(c) for c in [*keys, *values]]).mapInArrow(pack, schema)
