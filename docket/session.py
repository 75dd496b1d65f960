"""Session helpers: one place for the Spark settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the session does not already carry a value, so a
# cluster's own configuration always wins.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Rows and bytes of one Arrow batch: what a Python worker holds at a time, some copies of it included.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches where the session sets no bound of its own."""
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def get_spark(master: str | None = None, app: str = "docket",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    active = SparkSession.getActiveSession()
    for k, v in conf.items():
        if active is not None and k in DEFAULTS and active.conf.get(k, None) is not None:
            continue                      # the session's own value holds
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    checkpoint_dir(spark)
    from docket import ship
    ship(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and spilled intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only a local session (tests) may fall
    back to a private temporary folder; on a cluster the setting is required,
    because a machine-local folder does not survive a lost executor.
    """
    small_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="docket-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table location under the checkpoint folder (which ``cleanup`` deletes)."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(id(spark.sparkContext._jsc), []).append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage so that recomputation after a lost executor starts from the
    written table, and pins a result whose later reuse must see identical rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: dict[int, list[str]] = {}


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote with ``materialize`` or at a
    ``scratch_path`` (and only those).  Call it once every DataFrame built on them has been
    consumed.  Returns the number of folders removed."""
    paths = _WRITTEN.pop(id(spark.sparkContext._jsc), [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).delete(p, True):
            n += 1
    return n


@contextmanager
def own_tables(spark: SparkSession):
    """Tables that ``materialize`` writes inside this block are deleted at its end
    (for a micro-batch whose results are written by then)."""
    key = id(spark.sparkContext._jsc)
    before = _WRITTEN.pop(key, [])
    try:
        yield
    finally:
        cleanup(spark)
        _WRITTEN[key] = before


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core before heavy
    row-local work (chunking, embedding).  A no-op when there are that many input
    files, as for any large input (a look at the file list; no job)."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if len(df.inputFiles()) < want else df


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` once to the shared checkpoint folder and read it
    back.  (``Dataset.checkpoint()`` would compute the plan twice: once to
    count, once to write.)"""
    return materialize(df, name)
