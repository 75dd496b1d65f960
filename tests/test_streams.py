import os

from pyspark.sql import functions as F

from docket.plans import answer as A
from docket.plans import testdata as D
from docket.operators import vector_index as VI
from docket.sources.files import collection_get
from docket.streaming import streams as ST
from tests.conftest import SF001
from tests.test_sources import make_pptx


def test_answer_stream_equals_batch(spark, tmp):
    qs = D.chat_questions(spark, SF001)
    src = f"{tmp}/q"
    qs.repartition(3).write.parquet(src)
    chunks = A.notes_chunks(spark, SF001, "fixed")
    index = D.notes_index(spark, SF001)
    stream = spark.readStream.schema(qs.schema).parquet(src)
    out = f"{tmp}/answers"
    q = ST.answer_stream(stream, chunks, index, out, checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    got = spark.read.parquet(out).drop("batch_id")
    want = A.answer_batch(qs, chunks, index)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)


def test_ingest_stream_replay_adds_nothing(spark, tmp):
    os.makedirs(f"{tmp}/in")
    make_pptx(f"{tmp}/in/a.pptx", [["alpha beta", "gamma"]])
    make_pptx(f"{tmp}/in/b.pptx", [["delta"]])
    coll = f"{tmp}/coll"
    ST.ingest_stream(spark, f"{tmp}/in", coll, checkpoint=f"{tmp}/ck1").awaitTermination()
    n1 = collection_get(spark, coll).count()
    assert n1 == 2
    # a fresh checkpoint replays every file: ids already stored are left alone
    ST.ingest_stream(spark, f"{tmp}/in", coll, checkpoint=f"{tmp}/ck2").awaitTermination()
    assert collection_get(spark, coll).count() == n1
    row = collection_get(spark, coll).filter(F.col("source") == "a.pptx").first()
    assert row.content == "alpha beta\ngamma" and row.pdf_url == "/pdf/a.pptx" and len(row.embedding) == 64


def test_ingest_keeps_the_vector_index_in_step(spark, tmp):
    src, coll, vectors = f"{tmp}/in", f"{tmp}/coll", f"{tmp}/vectors"
    files = D.archives(spark, SF001)
    files.repartition(4).write.parquet(src)
    stream = lambda: spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.ingest_rows(stream(), coll, checkpoint=f"{tmp}/ck1", vectors_path=vectors).awaitTermination()
    index = VI.open_index(spark, vectors)
    rows = collection_get(spark, coll)
    assert index.rows == rows.count() > 200 and index.read().select("batch").distinct().count() == 4
    qs = rows.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    got, want = (sorted(map(tuple, VI.search(i, qs, 3).collect())) for i in (index, VI.build_index(rows, c_vec="embedding")))
    assert got == want
    ST.ingest_rows(stream(), coll, checkpoint=f"{tmp}/ck2", vectors_path=vectors).awaitTermination()
    assert VI.open_index(spark, vectors).rows == index.rows == collection_get(spark, coll).count()


def test_many_batches_leave_no_tables(spark, tmp):
    base = spark.conf.get("spark.checkpoint.dir")
    qs = D.chat_questions(spark, SF001).limit(6)
    src = f"{tmp}/q"
    qs.repartition(3).write.option("maxRecordsPerFile", 2).parquet(src)
    chunks = A.notes_chunks(spark, SF001, "fixed")
    stream = spark.readStream.schema(qs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    before = set(os.listdir(base))
    q = ST.answer_stream(stream, chunks, D.notes_index(spark, SF001), f"{tmp}/answers", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    assert len([p for p in os.listdir(f"{tmp}/answers") if p.startswith("batch_id=")]) >= 3
    assert set(os.listdir(base)) == before


def test_a_question_sent_again_is_answered_once(spark, tmp):
    qs = D.chat_questions(spark, SF001).limit(4).withColumn("at", F.current_timestamp())
    src = f"{tmp}/q"
    for i in range(3):                                     # the same questions in three micro-batches, twice in each
        qs.unionByName(qs).coalesce(1).write.mode("append").parquet(src)
    chunks, index = A.notes_chunks(spark, SF001, "fixed"), D.notes_index(spark, SF001)
    vectors = VI.build_index(chunks)
    for name, kw in (("plain", {}), ("timed", {"event_time": "at"})):
        stream = spark.readStream.schema(qs.schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = f"{tmp}/{name}"
        ST.answer_stream(stream, chunks, index, out, checkpoint=f"{tmp}/ck-{name}", vectors=vectors, **kw).awaitTermination()
        got = [r.qid for r in spark.read.parquet(out).collect()]
        assert sorted(got) == sorted(r.qid for r in qs.select("qid").collect())


def test_default_checkpoints_differ(spark):
    assert ST._checkpoint(spark, "answer_stream", "/a") != ST._checkpoint(spark, "answer_stream", "/b")
