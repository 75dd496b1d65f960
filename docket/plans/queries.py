"""Registered queries: one per operator group, each over whole test tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching oracle in ``docket.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions import text as T
from docket.functions import vectors as V
from docket.operators import chunk as C
from docket.operators import collection as K
from docket.operators import context as X
from docket.operators import embed as M
from docket.operators import history as H
from docket.operators import knn
from docket.operators import tree as TR
from docket.operators import route as R
from docket.operators import similar as S
from docket.operators.vector_index import build_index
from docket.plans import testdata as D
from docket.session import scratch_path
from docket.sources import files as SRC

K_CHAT = 5


def knn_top5(spark: SparkSession, sf: str) -> DataFrame:
    """J3 + W1: the 5 nearest stored vectors of every stored vector."""
    hits = knn.nearest_chunks(D.vector_questions(spark, sf), D.vector_collection(spark, sf), k=K_CHAT)
    return hits.select("qid", "id", "dist", "rk")


def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + J3 + A3 + T1: cleaned context of the 5 nearest chunks per question."""
    coll = D.vector_collection(spark, sf)
    hits = knn.nearest_chunks(D.vector_questions(spark, sf), coll, k=K_CHAT)
    return X.concat_context(hits, coll, c_text="content").select("qid", "context", "n_hits")


def top_source_link(spark: SparkSession, sf: str) -> DataFrame:
    """A4 + T4 + J4: label and link of each question's first hit."""
    coll = D.vector_collection(spark, sf)
    hits = knn.nearest_chunks(D.vector_questions(spark, sf), coll, k=K_CHAT)
    return X.top_source(hits, coll, D.file_index(spark, sf))


def clean_context(spark: SparkSession, sf: str) -> DataFrame:
    """T1 over every document."""
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", T.clean_context("text").alias("cleaned"))


def snippet_sample(spark: SparkSession, sf: str) -> DataFrame:
    """L1 + T2: the first three documents by id, as 300-character snippets."""
    d = D.table(spark, sf, "documents").select("doc_id", T.snippet("text", 300).alias("snippet"))
    return K.sample_rows(d, [F.col("doc_id")], 3)


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """C2 + W5 + T7 + P3 + P5: fixed 1200/200 windows with content-hash ids."""
    d = D.table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("name"),
        "text", F.col("doc_id").alias("doc_index"))
    return C.chunk_docs(d, method="fixed")


def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """C1 + W5 + T7 + P5 over every document."""
    d = D.table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("name"),
        "text", F.col("doc_id").alias("doc_index"))
    return C.chunk_docs(d, method="recursive")


def tag_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Text runs of every ``<p>`` element, one row each."""
    p = D.table(spark, sf, "pages")
    return p.select("page_id", F.posexplode(T.tag_runs("html", "p")).alias("run_pos", "run")) \
            .withColumn("run_pos", F.col("run_pos").cast("bigint"))


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """T5: every url as a safe file name."""
    p = D.table(spark, sf, "pages")
    return p.select("page_id", T.safe_filename("url").alias("safe_name"))


def render_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant turn, with bold words, bullets and numbers added, rendered to HTML."""
    c = D.table(spark, sf, "conversations").filter(F.col("role") == "assistant") \
         .withColumn("text", F.concat(F.lit("*note* "), F.col("text"), F.lit("\n* first\n* second\n\n1. one\n22. two\n\n\nend ")))
    return c.select("conv_id", "turn", T.render_answer("text").alias("html"))


def route_fields(spark: SparkSession, sf: str) -> DataFrame:
    """R1-R3 + R6 over every chat question."""
    q = R.classify_questions(R.route_fields(D.chat_questions(spark, sf)))
    return q.select("qid", "module", "semester", "subject", "category")


def candidate_files(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate notes files of every benchmark question (all-files rows flagged)."""
    return R.candidate_files(D.bench_questions(spark, sf), D.notes_index(spark, sf))


def candidate_summary(spark: SparkSession, sf: str) -> DataFrame:
    """R4 aggregated per question, without listing pairs."""
    return R.candidate_summary(D.bench_questions(spark, sf), D.notes_index(spark, sf))


def candidate_sets(spark: SparkSession, sf: str) -> DataFrame:
    """R4 as bitmaps: how many files each benchmark question's set holds, and a digest of their positions."""
    qs, index = D.bench_questions(spark, sf), D.notes_index(spark, sf)
    sets = R.candidate_sets(qs, index).withColumn("at", R.set_positions())
    each = sets.groupBy("_mk", "_sk", "_jk").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    digest = F.md5(F.array_join(F.transform("at", lambda x: x.cast("string")), ",").cast("binary"))
    return R.question_keys(qs).join(each, ["_mk", "_sk", "_jk"], "left").select(
        "qid", F.coalesce("n", F.lit(0)).alias("n_candidates"), digest.alias("positions_md5"))


def file_index_read(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the page index written as one JSON object (every tenth path twice), read again; and a missing file."""
    idx = D.file_index(spark, sf)
    again = idx.filter("pos % 10 = 0").select((F.col("pos") + (1 << 40)).alias("pos"), "path", F.concat("link", F.lit("#2")).alias("link"))
    entry = F.concat(TR._json_str(F.col("path")), F.lit(":"), TR._json_str(F.col("link")))
    lines = idx.unionByName(again).select("pos", F.concat(F.when(F.col("pos") > 0, F.lit(",")).otherwise(F.lit("{")), entry).alias("value"))
    path = scratch_path(spark, "index")
    end = spark.createDataFrame([(1 << 62, "}")], "pos bigint, value string")
    lines.unionByName(end).repartition(1).sortWithinPartitions("pos").select("value").write.text(path)
    return SRC.scan_file_index(spark, path).unionByName(SRC.scan_file_index(spark, path + "-missing"))


def rows_written(spark: SparkSession, sf: str) -> DataFrame:
    """K1: every document written as parquet and as JSON lines, and both read again."""
    d = D.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    out = None
    for fmt in ("parquet", "json"):
        path = scratch_path(spark, fmt)
        SRC.write_rows(d, path, fmt)
        rows = spark.read.schema(d.schema).format(fmt).load(path).select(
            F.lit(fmt).alias("form"), "doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fuzzy_best(spark: SparkSession, sf: str) -> DataFrame:
    """J2 + N1: most similar candidate file per benchmark question."""
    return S.fuzzy_best_file(D.bench_questions(spark, sf), D.notes_index(spark, sf))


def recent_questions(spark: SparkSession, sf: str) -> DataFrame:
    """W2 + W3 + T3: the recent-question list of every conversation."""
    turns = D.repeated_turns(spark, sf)
    return H.recent_questions(H.drop_repeats(turns))


def library_tree(spark: SparkSession, sf: str) -> DataFrame:
    """H1 over the page file index."""
    return TR.library_tree(D.file_index(spark, sf))


def folder_children(spark: SparkSession, sf: str) -> DataFrame:
    """H3 for every folder: child counts by type and the first child name."""
    nodes = TR.library_tree(D.file_index(spark, sf))
    kids = nodes.filter(F.col("parent_path").isNotNull())
    return kids.groupBy(F.col("parent_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_children"),
        F.count(F.when(F.col("type") == "file", 1)).alias("n_files"),
        F.min("name").alias("first_child"))


def folder_closure(spark: SparkSession, sf: str) -> DataFrame:
    """H2 over the library tree of the page index, from the top level."""
    nodes = TR.library_tree(D.file_index(spark, sf))
    entries = nodes.select(F.col("path").alias("id"), F.col("parent_path").alias("parent_id"), "name",
                           (F.col("type") == "folder").alias("is_folder"))
    return TR.folder_closure(entries)


def lookup_file(spark: SparkSession, sf: str) -> DataFrame:
    """File requests against the stored file names."""
    return X.lookup_file(D.file_requests(spark, sf), D.stored_names(spark, sf))


def pack_batches(spark: SparkSession, sf: str) -> DataFrame:
    """K2 + W4 + W6 + P7: the collection packed in batches of 300 by id."""
    coll = D.vector_collection(spark, sf).withColumns({"chunk_id": F.col("id") % 7, "doc_index": F.col("id")}).select(
        "id", F.col("content").alias("document"), K.metadata_record("rest").alias("metadata"), F.col("vector").alias("embedding"))
    pb = K.pack_batches(coll, 300, [F.col("id")])
    return pb.select(
        "batch", F.size("ids").cast("bigint").alias("n_rows"),
        F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids_csv"),
        F.aggregate("documents", F.lit(0).cast("bigint"),
                    lambda a, x: a + F.length(x).cast("bigint")).alias("doc_chars"),
        F.array_join(F.transform("metadatas", lambda m: F.concat_ws("|", m["source"], m["chunk_id"].cast("string"),
                                                                    m["doc_index"].cast("string"))), ",").alias("metadata_csv"),
        F.array_join(F.transform("embeddings", lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a * 3 % 1000003
                     + F.floor(x.cast("double") * 4096).cast("bigint"), lambda a: a.cast("string"))), ",").alias("vector_codes"))


def parity(spark: SparkSession, sf: str) -> DataFrame:
    """A2: documents without a vector and vectors without a document."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    vecs = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return K.check_parity(docs, vecs, "id")


def upsert_new(spark: SparkSession, sf: str) -> DataFrame:
    """K3's insert set (J6): documents, one per id, whose id is not stored yet
    (stored = the labelled documents)."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    stored = D.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return K.new_only(K.dedupe_by_id(docs, "id"), stored, "id")


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """M2 in long form over every benchmark text."""
    b = D.table(spark, sf, "benchmark")
    out = M.hash_embed_long(b, "item_id", "text", 64)
    return out.select("item_id", "bucket", F.round("weight", 6).alias("weight"))


def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + A1: documents loaded, chunks made (fixed windows), collection size."""
    docs = D.table(spark, sf, "documents")
    chunks = chunk_fixed(spark, sf)
    return K.stage_counts(documents=docs, chunks=chunks, collection=D.vector_collection(spark, sf))


def answer_batch(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over every chat question, documents cut in fixed windows (SQL-checkable)."""
    from docket.plans.answer import flagship
    return flagship(spark, sf, method="fixed")


def answer_batch_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """F1 as the flagship: documents split recursively."""
    from docket.plans.answer import flagship
    return flagship(spark, sf, method="recursive")


def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """R5 + R6 + J2: category branches for every chat question (retrieval left out)."""
    qs = R.classify_questions(D.chat_questions(spark, sf))
    req = qs.filter(F.col("category") == "DIRECT_NOTES_REQUEST")
    match = S.fuzzy_best_file(req, D.notes_index(spark, sf))
    out = R.dispatch(qs, match, None)
    return out.select("qid", "category", "answer", "source_label", "source_link")


def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """J3 + W1 with the cosine distance."""
    hits = knn.nearest_chunks(D.vector_questions(spark, sf), D.vector_collection(spark, sf),
                              k=K_CHAT, metric="cosine")
    return hits.select("qid", "id", "dist", "rk")


def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + N2 + M2: each stored vector against the hash vector of its own document."""
    coll = D.vector_collection(spark, sf)
    own = coll.withColumn("hv", M.hash_vector("content", 64))
    return own.select("id",
                      (F.round(V.vector_distance("vector", "hv", "l2sq"), 6) + 0.0).alias("l2sq"),
                      (F.round(V.vector_distance("vector", "hv", "ip"), 6) + 0.0).alias("ip"),
                      (F.round(V.vector_distance("vector", "hv", "cosine"), 6) + 0.0).alias("cosine"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """T2 over every document."""
    return D.table(spark, sf, "documents").select("doc_id", T.snippet("text", 300).alias("snippet"))


def document_names(spark: SparkSession, sf: str) -> DataFrame:
    """P1 + P2: documents with the name columns emptied in turn, as (name, text)."""
    d = D.table(spark, sf, "documents")
    raw = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("name"),
                   F.when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("filename"), "text")
    return raw.select("doc_id", T.doc_name("name", "filename").alias("name"),
                      F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"))


def collection_records(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + P6 + P7 + P8 + W6 + P9: documents paired with their vectors, as stored records."""
    docs = D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"))
    vecs = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").cast("bigint").alias("dim"))
    rec = K.embedding_record(K.row_index(K.pair_vectors(docs, vecs), [F.col("id")]))
    meta = rec.withColumn("m", K.metadata_record("full"))
    return meta.select("id", K.positional_id("row_index").alias("pos_id"), "dim", "m.source", "m.pdf", "m.pdf_url", "m.module",
                       T.file_url("source").alias("url"))


def whole_replies(spark: SparkSession, sf: str) -> DataFrame:
    """T9 over the whole text of every turn, with whitespace put around it."""
    c = D.table(spark, sf, "conversations")
    text = F.concat(F.lit(" \n"), F.replace("text", F.lit("ß"), F.lit("ss")), F.lit("\t \n"))
    return c.select("conv_id", "turn", T.normalize_reply(text).alias("reply"))


def answer_forms(spark: SparkSession, sf: str) -> DataFrame:
    """P10: both forms of answers with missing parts, derived from the assistant's turns."""
    c = D.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    pick = lambda n, x: F.when((F.col("conv_id") + F.col("turn")) % 5 == n, "").when(
        (F.col("conv_id") + F.col("turn")) % 5 == n + 1, F.lit(None)).otherwise(x)
    a = c.select("conv_id", "turn", pick(0, F.col("text")).alias("answer"), pick(1, F.lit("label")).alias("source_label"),
                 pick(2, F.lit("http://x/y")).alias("source_link"))
    page = X.answer_defaults(a, "page").select("conv_id", "turn", F.md5(F.col("html").cast("binary")).alias("html_md5"))
    return X.answer_defaults(a, "cli").join(page, ["conv_id", "turn"])


def collection_size(spark: SparkSession, sf: str) -> DataFrame:
    """A1 over the vector collection."""
    return K.collection_count(D.vector_collection(spark, sf))


def top_folders(spark: SparkSession, sf: str) -> DataFrame:
    """H3: what the top level of the library tree holds."""
    return TR.folder_contents(TR.library_tree(D.file_index(spark, sf)), None).select("path", "name", "type")


def top1_source(spark: SparkSession, sf: str) -> DataFrame:
    """The source file of the nearest chunk of every question."""
    coll = D.vector_collection(spark, sf)
    hits = knn.nearest_chunks(D.vector_questions(spark, sf), coll, k=1)
    return D.vector_questions(spark, sf).select("qid").join(
        hits.join(coll.select("id", "source"), "id").select("qid", F.col("source").alias("file")), "qid", "left")


def archive_text(spark: SparkSession, sf: str) -> DataFrame:
    """Slide decks and word files built from every document, and their text again."""
    files = D.archives(spark, sf)
    return SRC.extract_archive_text(files).select("name", "text", "status")


def upsert_twice(spark: SparkSession, sf: str) -> DataFrame:
    """K3 + S5: half of the documents stored, then all of them, then all again."""
    path = scratch_path(spark, "collection")
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    added = [K.collection_upsert(d, path) for d in (docs.filter("id % 2 = 0"), docs, docs)]
    kept = K.dedupe_by_id(SRC.collection_get(spark, path, ["id", "source", "n_chars"]), "id")
    return kept.withColumn("added_last", F.lit(added[-1]).cast("bigint"))


def whole_docs(spark: SparkSession, sf: str) -> DataFrame:
    """P1 over every document as it is, and again with a null and with an empty text."""
    d = D.table(spark, sf, "documents").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("filename"), "text")
    null, empty = [d.select(F.concat("filename", F.lit(m)).alias("filename"), F.lit(t).cast("string").alias("text"))
                   for m, t in (("-null", None), ("-empty", ""))]
    return C.normalize_docs(d.unionByName(null).unionByName(empty)).select("name", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files of one JSON array each (about 500 rows), and read again."""
    d = D.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    files = d.count() // 500 + 1
    arrays = (d.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("part"))
               .agg(F.to_json(F.collect_list(F.struct(*d.columns))).alias("value")))
    path = scratch_path(spark, "json")
    arrays.write.partitionBy("part").text(path)
    rows = SRC.scan_json_rows(spark, path, d.schema)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def file_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Every text written to text files, and the bytes of the files found again."""
    path = scratch_path(spark, "texts")
    text = D.table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("value"))
    text.write.option("maxRecordsPerFile", 1000).text(path)
    return SRC.scan_files(spark, path, (".txt",)).agg(F.sum(F.length("content")).cast("bigint").alias("n_bytes"))


def tree_json(spark: SparkSession, sf: str) -> DataFrame:
    """K4: the library tree as nested JSON, one text per top-level node."""
    return TR.tree_json(TR.library_tree(D.file_index(spark, sf)))


def model_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """M1: every document through a model that counts characters and spaces."""
    d = D.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = M.with_model(d, "text", lambda t: [[float(len(x)), float(x.count(" "))] for x in t], out_type="array<double>")
    return out.select("doc_id", F.col("embedding")[0].cast("bigint").alias("n_chars"),
                      F.col("embedding")[1].cast("bigint").alias("n_spaces"))


def answer_stream(spark: SparkSession, sf: str) -> DataFrame:
    """every chat question as a stream, answered from fixed chunks through their stored index."""
    from docket.plans import answer as A
    from docket.streaming import streams as ST
    qs = D.chat_questions(spark, sf)
    asked, out = scratch_path(spark, "asked"), scratch_path(spark, "answers")
    qs.write.parquet(asked)
    chunks, index = A.notes_chunks(spark, sf, "fixed"), D.notes_index(spark, sf)
    ST.answer_stream(spark.readStream.schema(qs.schema).parquet(asked), chunks, index, out,
                     vectors=build_index(chunks)).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def ingest_archives(spark: SparkSession, sf: str) -> DataFrame:
    """archives of every document as a stream into a collection, fixed windows."""
    from docket.streaming import streams as ST
    files = D.archives(spark, sf)
    arrived, coll = scratch_path(spark, "arrived"), scratch_path(spark, "collection")
    files.write.parquet(arrived)
    ST.ingest_rows(spark.readStream.schema(files.schema).parquet(arrived), coll, method="fixed").awaitTermination()
    code = F.array_join(F.transform("embedding", lambda x: F.round(x * 10000).cast("bigint").cast("string")), ",")
    return SRC.collection_get(spark, coll).select("source", "chunk_id", "content", "pdf_url", "embedder", code.alias("vector_code"))


QUERIES = {
    "whole_docs": whole_docs,
    "json_rows": json_rows,
    "file_bytes": file_bytes,
    "tree_json": tree_json,
    "model_lengths": model_lengths,
    "answer_stream": answer_stream,
    "ingest_archives": ingest_archives,
    "knn_top5": knn_top5,
    "rag_context": rag_context,
    "top_source_link": top_source_link,
    "clean_context": clean_context,
    "snippets": snippets,
    "document_names": document_names,
    "collection_records": collection_records,
    "whole_replies": whole_replies,
    "answer_forms": answer_forms,
    "collection_size": collection_size,
    "top_folders": top_folders,
    "top1_source": top1_source,
    "archive_text": archive_text,
    "upsert_twice": upsert_twice,
    "snippet_sample": snippet_sample,
    "chunk_fixed": chunk_fixed,
    "chunk_recursive": chunk_recursive,
    "tag_runs": tag_runs,
    "safe_names": safe_names,
    "render_answer": render_answer,
    "route_fields": route_fields,
    "candidate_files": candidate_files,
    "candidate_summary": candidate_summary,
    "candidate_sets": candidate_sets,
    "file_index_read": file_index_read,
    "rows_written": rows_written,
    "fuzzy_best": fuzzy_best,
    "recent_questions": recent_questions,
    "library_tree": library_tree,
    "folder_children": folder_children,
    "folder_closure": folder_closure,
    "lookup_file": lookup_file,
    "pack_batches": pack_batches,
    "parity": parity,
    "upsert_new": upsert_new,
    "hash_embed": hash_embed,
    "stage_counts": stage_counts,
    "answer_batch": answer_batch,
    "answer_batch_recursive": answer_batch_recursive,
    "dispatch": dispatch,
    "knn_cosine": knn_cosine,
    "pair_distance": pair_distance,
}
