"""Streams: questions in, answers out (F2); files in, collection rows out.

Both reuse the batch operators through ``foreachBatch``; the ids of questions seen are the only
state.  Answers are written per batch id (overwrite), and the
collection upsert is keyed by content id, so a replayed batch after a failure
changes nothing.  Intermediate tables of a micro-batch are deleted at its end, and the
default checkpoint is named after the output, so no two streams share one.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docket.operators import chunk as C
from docket.operators import collection as K
from docket.operators import embed as M
from docket.operators import store as ST
from docket.operators.vector_index import VectorIndex, build_index, extend, index_exists, open_index
from docket.plans.answer import DIM, answer_batch, embedder_name
from docket.session import checkpoint_dir, own_tables
from docket.sources.files import extract_archive_text


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _checkpoint(spark: SparkSession, kind: str, out_path: str) -> str:
    """A place for a stream's progress that a restart into the same output finds again."""
    return os.path.join(checkpoint_dir(spark), f"{kind}-{hashlib.md5(out_path.encode()).hexdigest()}")


def answer_stream(questions: DataFrame, chunks: DataFrame, index: DataFrame, out_path: str,
                  checkpoint: str | None = None, trigger: dict | None = None,
                  vectors: VectorIndex | None = None, event_time: str | None = None,
                  delay: str = "1 day", **kw) -> StreamingQuery:
    """F2: answer each micro-batch of ``(qid, question)`` rows; one folder per batch id.

    The stream keeps the ids it has seen as keyed state, so a question sent again, in the same or in a
    later micro-batch, is answered once.  With ``event_time`` (a timestamp column) an id is kept only as long
    as its repeats may arrive, ``delay`` after it; without it the state grows with the distinct ids.
    ``vectors``, the stored index of the collection's vectors, is opened once and asked by every
    micro-batch; without it each micro-batch builds one of its own, deleted at its end."""
    spark = questions.sparkSession
    ckpt = checkpoint or _checkpoint(spark, "answer_stream", out_path)

    def run(batch: DataFrame, batch_id: int) -> None:
        with own_tables(spark):
            answer_batch(batch, chunks, index, vectors=vectors, **kw).write.mode("overwrite") \
                .parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    q_id = kw.get("q_id", "qid")
    if event_time is None:
        once = questions.dropDuplicates([q_id])
    else:
        once = questions.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([q_id])
    w = once.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def ingest_rows(files: DataFrame, collection_path: str, checkpoint: str | None = None,
                trigger: dict | None = None, method: str = "recursive", dim: int = DIM,
                vectors_path: str | None = None) -> StreamingQuery:
    """F3 on a stream of ``(path, content)`` rows -> text (S4) -> chunks (C1, C2) ->
    hash vectors (M2) -> upsert into the collection (K3).

    Documents are keyed by a hash of their path (stable across batches) in
    place of a list position.  With ``vectors_path`` the rows that are new also enter the stored
    vector index there, before they are stored: a batch sent again after a failure
    between the two replaces its tiles and then stores its rows.
    """
    spark = files.sparkSession
    ckpt = checkpoint or _checkpoint(spark, "ingest_stream", collection_path)

    def run(batch: DataFrame, batch_id: int) -> None:
        with own_tables(spark):
            text = extract_archive_text(batch.select("path", "content"))
            docs = text.select("name", "text", F.xxhash64("path").alias("doc_index"))
            ch = C.chunk_docs(docs, method=method)
            rows = ch.withColumn("embedding", M.hash_vector("content", dim)).withColumn("embedder", F.lit(embedder_name(dim)))
            rows = K.embedding_record(rows)
            if vectors_path is None:
                K.collection_upsert(rows, collection_path)
                return
            fresh = ST.only_new(rows, collection_path)
            if fresh.limit(1).count():
                if index_exists(spark, vectors_path):
                    extend(open_index(spark, vectors_path), fresh, str(batch_id), c_vec="embedding")
                else:
                    build_index(fresh, vectors_path, c_vec="embedding", batch=str(batch_id))
                K.collection_upsert(fresh, collection_path)

    w = files.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def ingest_stream(spark: SparkSession, source_dir: str, collection_path: str, **kw) -> StreamingQuery:
    """F3 on files arriving under ``source_dir``."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("recursiveFileLookup", "true").load(source_dir))
    return ingest_rows(files, collection_path, **kw)
