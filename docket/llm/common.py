"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket import ship
from docket.functions._util import byte_slices  # noqa: F401
from docket.session import checkpoint_dir


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package and make sure the shared checkpoint folder is known."""
    checkpoint_dir(spark)
    ship(spark)
    return spark


class Scratch:
    """Intermediate tables under ``spark.checkpoint.dir``, dropped when no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ready(spark)
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str | None) -> None:
        if path:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n+1 offsets (a null has length 0)."""
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def vectors(arr: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """A non-null list column of equal lengths as an n x dim matrix."""
    return np.asarray(arr.flatten(), kind).reshape(len(arr), dim)


def whole(col: str) -> Column:
    """Whether a vector is not null, not empty and holds only finite components."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True))


def whole_vectors(df: DataFrame, col: str) -> DataFrame:
    """Rows whose vector is whole."""
    return df.filter(whole(col))


class Forest:
    """Union-find over 0..n-1 for one task's block."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.p[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: ``(id, component)``, the
    component being its smallest id; ids without an edge do not appear.

    Alternating large-star / small-star rounds over edge tables; every round is
    written to the shared folder, nothing but two totals reaches the driver.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .filter("u <> v").distinct())
    e, path = scratch.write(e)
    total = F.struct(F.count(F.lit(1)).alias("n"),
                     F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    before = e.agg(total.alias("t")).first()["t"]
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                      .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt, npath = scratch.write(small)
        now = nxt.agg(total.alias("t")).first()["t"]
        scratch.drop(path)
        e, path = nxt, npath
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("id"), F.col("u").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
