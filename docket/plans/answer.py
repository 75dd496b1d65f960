"""The whole question path as one job (F1) and the flagship query.

questions -> category (R6) -> branch by filter (R5):
  SMALL_TALK            -> no answer here (a text model's job; see ``model``)
  DIRECT_NOTES_REQUEST  -> best candidate file (R4 + J2) -> fixed reply with its link
  NOTES_QUERY           -> question vector (M2) -> nearest chunks (J3) -> context (A3, T1)
                           -> source label and link (A4, J4) -> prompt (P11)
  anything else         -> fixed reply
Branches meet in a union; only the rows of a branch reach its operators.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.operators import chunk as C
from docket.operators import context as X
from docket.operators import embed as M
from docket.operators import knn
from docket.operators import route as R
from docket.operators import similar as S
from docket.operators.vector_index import VectorIndex, build_index
from docket.plans import testdata as D
from docket.session import cut, materialize, spread

DIM = 64
K = 5


def embedder_name(dim: int = DIM) -> str:
    """The name under which a collection records vectors of ``hash_vector``."""
    return f"hash-{dim}"


def answer_batch(questions: DataFrame, chunks: DataFrame, index: DataFrame,
                 k: int = K, dim: int = DIM,
                 model: Callable[[pd.Series], pd.Series] | None = None,
                 q_id: str = "qid", q_col: str = "question", embedder: str | None = None,
                 vectors: VectorIndex | None = None) -> DataFrame:
    """``(qid, question, category, answer, source_label, source_link, context, prompt)``.

    ``chunks``: ``(id, source, content, vector)`` with vectors from the same
    embedder as the questions (``hash_embed`` with ``dim`` by default).
    A collection that names its ``embedder`` must name this one in every row
    (``hash-<dim>`` by default), as vectors of two embedders do not compare.
    ``index``: ``(pos, path, link)``.  ``vectors``: the stored index of ``chunks``; without it one
    is built for this call.  ``model``, when given, turns each
    prompt into an answer batch by batch (M1).
    """
    if "embedder" in chunks.columns:
        other = chunks.filter(~F.col("embedder").eqNullSafe(F.lit(embedder or embedder_name(dim)))).select("embedder").first()
        if other is not None:
            raise ValueError(f"the collection holds vectors of {other[0]!r}, the questions those of {embedder or embedder_name(dim)!r}")
    # Read by every branch: pinned once (a stream's
    # micro-batch is then not re-read from its source per use).
    qs = cut(R.classify_questions(questions.select(F.col(q_id).alias("qid"),
                                                   F.col(q_col).alias("question"))), "questions")
    req = qs.filter(F.col("category") == "DIRECT_NOTES_REQUEST")
    match = S.fuzzy_best_file(req, index)
    ask = qs.filter(F.col("category") == "NOTES_QUERY")
    # written, so that no task runs the embedder and the search's routing in two Python workers at a time
    qvec = cut(M.hash_embed(ask, "qid", "question", dim), "asked_vectors")
    hits = knn.nearest_chunks(qvec, chunks, k=k, q_vec="vector", c_vec="vector", index=vectors)
    # k rows per question with their text, read by both branches below: pinned
    # once so the collection is scanned once.
    rows = cut(X.hit_payload(hits, chunks), "hits")
    ctx = X.concat_context(rows)
    src = X.top_source(rows, None, index, pin=False)
    retrieval = (ask.select("qid").join(ctx, "qid", "left").join(src, "qid", "left")
                    .select("qid", F.lit(None).cast("string").alias("answer"), "source_label",
                            "source_link", F.coalesce("context", F.lit("")).alias("context")))
    out = R.dispatch(qs, match, retrieval)
    out = out.withColumn("prompt", F.when(F.col("category") == "NOTES_QUERY",
                                          X.build_prompt("question", "context")))
    if model is not None:
        asked = M.with_model(out.filter(F.col("prompt").isNotNull()).drop("answer"), "prompt", model,
                             out_col="answer", out_type="string")
        out = out.filter(F.col("prompt").isNull()).unionByName(asked.select(out.columns))
    return out.withColumnRenamed("qid", q_id)


def notes_chunks(spark: SparkSession, sf_dir: str, method: str = "recursive", dim: int = DIM,
                 store: bool = True) -> DataFrame:
    """Chunks of every document with hash vectors: ``(id, source, content, vector, embedder)``.

    The ingest half of the pipeline.  With ``store`` the collection is written
    once to the shared checkpoint folder and read back, so the question half
    scans a stored table instead of re-chunking and re-embedding per use.
    """
    docs = D.table(spark, sf_dir, "documents").select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        "text", F.col("doc_id").alias("doc_index"))
    ch = C.chunk_docs(spread(docs), method=method)
    coll = ch.select("id", "source", "content", M.hash_vector("content", dim).alias("vector"),
                     F.lit(embedder_name(dim)).alias("embedder"))
    return materialize(coll, "collection") if store else coll


def flagship(spark: SparkSession, sf_dir: str, method: str = "recursive") -> DataFrame:
    """Every chat question of the test tables answered against the chunked,
    embedded documents, through their stored vector index, and the notes index."""
    chunks = notes_chunks(spark, sf_dir, method)
    return answer_batch(D.chat_questions(spark, sf_dir), chunks, D.notes_index(spark, sf_dir), vectors=build_index(chunks))
