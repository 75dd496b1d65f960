"""The id-keyed collection: pairing (J1), new rows (J6), packing (K2, W4), positions (W6, P8),
records (P6, P7), counts (A1, A2, A5), sample (L1); its store (K3) is in ``store``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.operators.store import collection_upsert, dedupe_by_id  # noqa: F401
from docket.session import cut, materialize

_PID_SHIFT = 33   # monotonically_increasing_id = partition index << 33 | record number


def row_index(df: DataFrame, order: list | None = None, col: str = "row_index") -> DataFrame:
    """0-based position in the whole table under ``order`` (a unique key).

    No single-partition window: the sorted rows are tagged with their partition
    and record number, pinned to the checkpoint folder, per-partition counts are
    summed into offsets (one row per partition), and each row adds its offset.
    Without ``order`` the position follows the scan order.
    """
    base = df.orderBy(*order) if order else df
    tagged = materialize(base.withColumn("_mid", F.monotonically_increasing_id()), "rowidx")
    pid = F.shiftright(F.col("_mid"), _PID_SHIFT)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of ``tagged``; written, so Spark knows its bytes when it picks the join.
    offsets = materialize(counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")), "offsets")
    out = (tagged.withColumn("_pid", pid)
                 .join(offsets, "_pid")
                 .withColumn(col, (F.col("_off") + F.col("_mid")
                                   - F.shiftleft(F.col("_pid"), _PID_SHIFT)).cast("bigint"))
                 .drop("_pid", "_off", "_mid"))
    return out


def batch_number(df: DataFrame, size: int = 300, order: list | None = None,
                 col: str = "batch") -> DataFrame:
    """Position div ``size``."""
    idx = row_index(df, order, "_pos")
    return idx.withColumn(col, F.floor(F.col("_pos") / size).cast("bigint")).withColumnRenamed("_pos", "pos")


def positional_id(pos_col: str = "pos") -> Column:
    """``doc_<n>``."""
    return F.concat(F.lit("doc_"), F.col(pos_col).cast("string"))


def pack_batches(df: DataFrame, size: int = 300, order: list | None = None,
                 id_col: str = "id", doc_col: str = "document", meta_col: str = "metadata",
                 vec_col: str = "embedding") -> DataFrame:
    """K2: rows to parallel arrays per batch of ``size`` rows, in position order.

    Each group holds at most ``size`` rows by construction.
    """
    b = batch_number(df, size, order)
    g = b.groupBy("batch").agg(F.array_sort(F.collect_list(
        F.struct("pos", F.col(id_col).alias("i"), F.col(doc_col).alias("d"),
                 F.col(meta_col).alias("m"), F.col(vec_col).alias("e")))).alias("_r"))
    return g.select("batch",
                    F.transform("_r", lambda x: x["i"]).alias("ids"),
                    F.transform("_r", lambda x: x["d"]).alias("documents"),
                    F.transform("_r", lambda x: x["m"]).alias("metadatas"),
                    F.transform("_r", lambda x: x["e"]).alias("embeddings"))


def pair_vectors(chunks: DataFrame, vectors: DataFrame, on: str = "id", how: str = "inner") -> DataFrame:
    """Chunk with its vector by id (the planner picks the join strategy)."""
    return chunks.join(vectors, on, how)


def new_only(df: DataFrame, existing: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose id is not yet stored."""
    return df.join(existing.select(on), on, "left_anti")


def embedding_record(df: DataFrame, source_col: str = "source") -> DataFrame:
    """Add ``pdf``, ``pdf_url`` and an empty ``module``."""
    return df.withColumns({
        "pdf": F.col(source_col),
        "pdf_url": F.concat(F.lit("/pdf/"), F.col(source_col)),
        "module": F.lit(""),
    })


def metadata_record(form: str = "full") -> Column:
    """The stored metadata struct in either form."""
    if form == "full":
        return F.struct(F.col("source"), F.col("pdf"), F.col("pdf_url"),
                        F.coalesce(F.col("module"), F.lit("")).alias("module"))
    if form == "rest":
        return F.struct(F.col("source"), F.col("chunk_id"), F.col("doc_index"))
    raise ValueError("form is 'full' or 'rest'")


def collection_count(df: DataFrame) -> DataFrame:
    """A1."""
    return df.agg(F.count(F.lit(1)).alias("n"))


RANGES = 4096


def _range(on: str) -> Column:
    return F.pmod(F.xxhash64(F.col(on).cast("string")), F.lit(RANGES)).cast("int")


def _digests(df: DataFrame, on: str, name: str) -> DataFrame:
    """Per range of the id's hash: rows and two sums that do not depend on their order."""
    total = lambda seed: F.sum(F.xxhash64(F.col(on).cast("string"), F.lit(seed)).cast("decimal(20,0)"))
    null = F.col(on).isNull()
    return df.groupBy(F.when(null, F.lit(-1)).otherwise(_range(on)).alias("_range")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).alias(name))


def check_parity(left: DataFrame, right: DataFrame, on: str = "id",
                 raise_on_mismatch: bool = False) -> DataFrame:
    """A2: ids present on one side only, as ``(side, id)``; with
    ``raise_on_mismatch`` stop when the row counts differ (the reference's
    test) or any id is missing on one side.

    Both sides are first digested by range of a hash of the id: a count and two independent 64-bit
    sums per range.  Ranges whose digests agree hold the same ids and are done after that scan;
    only the ids of ranges that differ are made distinct and joined.  Null ids take no part.
    """
    digests = cut(_digests(left, on, "_l").join(_digests(right, on, "_r"), "_range", "full_outer"), "digests")
    differ = digests.filter(~F.col("_l").eqNullSafe(F.col("_r"))).select("_range")      # at most RANGES numbers

    def keys(side: DataFrame, name: str) -> DataFrame:
        """Distinct ids of the ranges that differ: a repeated id costs one row per map task."""
        ids = side.filter(F.col(on).isNotNull()).select(F.col(on).alias(name), _range(on).alias("_range"))
        return ids.join(differ, "_range", "left_semi").select(name).distinct()

    j = keys(left, "_l").join(keys(right, "_r"), F.col("_l") == F.col("_r"), "full_outer")
    out = j.filter(F.col("_l").isNull() | F.col("_r").isNull()).select(
        F.when(F.col("_r").isNull(), F.lit("left_only")).otherwise(F.lit("right_only")).alias("side"),
        F.coalesce(F.col("_l"), F.col("_r")).alias(on))
    if raise_on_mismatch:
        nl, nr = digests.agg(F.coalesce(F.sum("_l.n"), F.lit(0)), F.coalesce(F.sum("_r.n"), F.lit(0))).first()
        if nl != nr:
            raise ValueError(f"row counts differ: {nl} vs {nr}")
        if out.limit(1).count():
            raise ValueError("ids missing on one side")
    return out


def stage_counts(**stages: DataFrame) -> DataFrame:
    """A5: one row per named stage with its row count (one aggregate per stage)."""
    out = None
    for name, df in stages.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def sample_rows(df: DataFrame, order: list, n: int = 3) -> DataFrame:
    """L1: the first ``n`` rows under ``order`` (a top-n, planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
