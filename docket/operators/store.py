"""The stored, id-keyed collection (K3): new rows are added, stored ids are left alone.

A store at ``path`` holds ``rows-<P>`` (the rows, in P parts by a hash of the id) and ``sketch-<P>``:
for every part a Bloom filter of its ids, as bitmaps of 32,768 bits with two bits per id.  A batch
asks the sketches of its parts first; only ids that may be stored, by both bits, are compared with
stored ids, and those are read only in the parts of such ids.  So a batch of new ids reads
next to no stored id, whatever the size of the store.

Parts split as the store grows: once they hold ``2 * PART_ROWS`` rows on average, the store is written
anew in a power of two times as many parts (so rows move a bounded number of times on
average), and the former folders are deleted when the new ones are whole.  The number of parts is in the
folder's name, so no caller can mix two numbers, and a first load takes as many parts, and tasks, as
its rows ask for.

The sketch of a batch is written before its rows: after a crash between the two a sketch knows ids
that are not stored, which costs a look at stored ids and nothing else; a batch sent again
adds what is missing.  Null ids count as one id.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docket.session import delete_path, materialize

PART_ROWS, LEAST_PARTS, PART = 100_000, 8, "id_part"
BITS, MAP = 1 << 21, 1 << 15            # bits of a part's filter; bits of one stored bitmap


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def parts_of(spark: SparkSession, path: str) -> int:
    """The store's number of parts; 0 where nothing is stored."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    whole = [int(n[5:]) for n in names if n.startswith("rows-") and fs.exists(_fs(spark, os.path.join(path, n, "_SUCCESS"))[0])]
    return max(whole, default=0)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store at ``path`` (of a plain table there, if it is none), with their part."""
    parts = parts_of(spark, path)
    return spark.read.parquet(os.path.join(path, f"rows-{parts}") if parts else path)


def _text(on: str) -> Column:
    return F.coalesce(F.col(on).cast("string"), F.lit("\0"))


def _keyed(df: DataFrame, on: str, parts: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(_text(on)), F.lit(parts)).cast("int"))


def _bits(on: str) -> Column:
    """The two bits of an id, each with the bitmap it lies in."""
    place = lambda i: F.pmod(F.xxhash64(_text(on), F.lit(i)), F.lit(BITS))
    return F.array(*[F.struct(F.lit(i).alias("nth"), F.floor(place(i) / MAP).cast("int").alias("map"), (place(i) % MAP).alias("bit"))
                     for i in (1, 2)])


def _sketch(rows: DataFrame, on: str) -> DataFrame:
    each = rows.select(PART, F.explode(_bits(on)).alias("b")).select(PART, "b.map", "b.bit")
    return each.groupBy(PART, "map").agg(F.bitmap_construct_agg("bit").alias("bitmap"), F.count(F.lit(1)).alias("n"))


def _maybe(ids: DataFrame, sketch: DataFrame, on: str) -> DataFrame:
    """The ids both of whose bits are set in their part's sketch."""
    asked = ids.select(on, PART, F.explode(_bits(on)).alias("b")).select(on, PART, "b.nth", "b.map", "b.bit")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = asked.join(sketch.select(PART, "map", "bitmap"), [PART, "map"]) \
               .filter(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1)
    return hit.groupBy(on, PART).agg(F.count_distinct("nth").alias("n")).filter("n = 2").select(on, PART)


def dedupe_by_id(df: DataFrame, on: str = "id") -> DataFrame:
    """One row per id, the smallest by content: deterministic and partially
    aggregated before the shuffle, so a hot id costs one row per map task."""
    others = [c for c in df.columns if c != on]
    if not others:
        return df.select(on).distinct()
    g = df.groupBy(on).agg(F.min(F.struct(*others)).alias("_r"))
    return g.select(on, *[F.col("_r")[c].alias(c) for c in others])


def _unknown(df: DataFrame, path: str, on: str, parts: int, stats: dict) -> DataFrame:
    """The rows of a batch whose id is not among the store's, with their part."""
    spark = df.sparkSession
    staged = materialize(_keyed(df, on, parts), "batch")
    ids = staged.select(on, PART).distinct()
    touched = [r[0] for r in ids.select(PART).distinct().collect()]       # numbers of parts: one per 100,000 stored rows at most
    sketch = spark.read.parquet(os.path.join(path, f"sketch-{parts}")).filter(F.col(PART).isin(touched))
    maybe = materialize(_maybe(ids, sketch, on), "maybe")
    where = [r[0] for r in maybe.select(PART).distinct().collect()]
    if not where:
        return staged
    seen = Observation()
    held = spark.read.parquet(os.path.join(path, f"rows-{parts}")).filter(F.col(PART).isin(where)).select(on) \
                .observe(seen, F.count(F.lit(1)).alias("n"))
    known = materialize(maybe.join(held.withColumnRenamed(on, "_on"), F.col(on).eqNullSafe(F.col("_on")), "left_semi")
                             .select(F.col(on).alias("_on")), "known")
    stats |= {"parts_read": len(where), "ids_read": seen.get["n"]}
    return staged.join(known, F.col(on).eqNullSafe(F.col("_on")), "left_anti")


def only_new(df: DataFrame, path: str, on: str = "id") -> DataFrame:
    """One row per id of ``df`` that is not stored at ``path``, written to the checkpoint folder."""
    parts = parts_of(df.sparkSession, path)
    rows = _unknown(df.drop(PART), path, on, parts, {}).drop(PART) if parts else df.drop(PART)
    return materialize(dedupe_by_id(rows, on), "fresh")


def add_new(df: DataFrame, path: str, on: str = "id", part_rows: int = PART_ROWS) -> dict:
    """Store the rows whose id is not stored yet.  What it took: rows ``added``, ``parts`` of the store,
    ``parts_read`` and ``ids_read`` (stored ids that were read)."""
    spark = df.sparkSession
    parts = parts_of(spark, path)
    stats = {"parts_read": 0, "ids_read": 0}
    rows = df.drop(PART)
    fresh = materialize(dedupe_by_id(_unknown(rows, path, on, parts, stats).drop(PART) if parts else rows, on), "fresh")
    n = fresh.count()
    parts = parts or _power(n, part_rows)
    if n:
        _write(_keyed(fresh, on, parts), path, on, parts, "append")
        total = spark.read.parquet(os.path.join(path, f"sketch-{parts}")).agg(F.sum("n")).first()[0] / 2
        if total > 2 * part_rows * parts:
            parts = _split(spark, path, on, parts, _power(total, part_rows))
    return {"added": n, "parts": parts, **stats}


def _power(rows: float, part_rows: int) -> int:
    parts = LEAST_PARTS
    while parts * part_rows < rows:
        parts *= 2
    return parts


def _write(rows: DataFrame, path: str, on: str, parts: int, mode: str) -> None:
    _sketch(rows, on).coalesce(8).sortWithinPartitions(PART, "map").write.mode(mode).parquet(os.path.join(path, f"sketch-{parts}"))
    rows.repartition(PART).write.mode(mode).partitionBy(PART).parquet(os.path.join(path, f"rows-{parts}"))


def _split(spark: SparkSession, path: str, on: str, parts: int, more: int) -> int:
    """The store in more parts; the former folders go once the new ones are whole."""
    rows = _keyed(spark.read.parquet(os.path.join(path, f"rows-{parts}")).drop(PART), on, more)
    _write(rows, path, on, more, "overwrite")
    for name in (f"rows-{parts}", f"sketch-{parts}"):
        delete_path(spark, os.path.join(path, name))
    return more


def collection_upsert(df: DataFrame, path: str, on: str = "id") -> int:
    """K3: append the rows whose id is not stored yet; stored ids are left alone.  Returns the number of
    rows added.  Replaying the same input adds nothing."""
    return add_new(df, path, on)["added"]
