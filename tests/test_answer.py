import pandas as pd
import pytest
from pyspark.sql import functions as F

from docket.functions.route import REPLY_FOUND, REPLY_NOT_FOUND, REPLY_OTHER
from docket.operators import embed as M
from docket.plans.answer import answer_batch


def setup(spark):
    chunks = spark.createDataFrame([
        ("c1", "os/Deadlock Notes.pdf", "deadlock happens when processes wait\tforever é"),
        ("c2", "dsa/stack.pdf", "a stack is last in first out"),
        ("c3", "dsa/queue.pdf", "a queue is first in first out"),
    ], "id string, source string, content string")
    chunks = chunks.withColumn("vector", M.hash_vector("content", 64))
    index = spark.createDataFrame([
        (0, "OS/Module 1/os module 1 3rd sem.pdf", "L0"),
        (1, "OS/notes/deadlock notes.pdf", "L1"),
        (2, "DSA/dsa module 2 stack.pdf", "L2"),
    ], "pos bigint, path string, link string")
    qs = spark.createDataFrame([
        (1, "hello"), (2, "send the notes pdf for dsa module 2"), (3, "explain deadlock when processes wait"),
        (4, "the weather today"),
    ], "qid bigint, question string")
    return qs, chunks, index


def test_answer_batch_all_categories(spark):
    qs, chunks, index = setup(spark)
    out = {r.qid: r for r in answer_batch(qs, chunks, index, k=2).collect()}
    assert out[1].category == "SMALL_TALK" and out[1].answer is None
    assert (out[2].category, out[2].answer, out[2].source_link) == ("DIRECT_NOTES_REQUEST", REPLY_FOUND, "L2")
    assert out[2].source_label == "DSA/dsa module 2 stack.pdf"
    r3 = out[3]
    assert r3.category == "NOTES_QUERY" and r3.source_label == "os/Deadlock Notes"
    # no index path contains 'os/deadlock notes.pdf' (letter case ignored)
    assert r3.source_link is None
    # the tab and the accent are deleted, joining their neighbours
    assert r3.context.startswith("deadlock happens when processes waitforever")
    assert "\t" not in r3.context and "é" not in r3.context
    assert r3.question in r3.prompt and r3.context in r3.prompt
    assert (out[4].category, out[4].answer) == ("OTHER", REPLY_OTHER)


def test_answer_batch_model_and_empty_index(spark):
    qs, chunks, _ = setup(spark)
    empty = spark.createDataFrame([], "pos bigint, path string, link string")

    def model(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: "ANSWER:" + str(len(p)))

    out = {r.qid: r for r in answer_batch(qs, chunks, empty, k=1, model=model).collect()}
    assert out[3].answer.startswith("ANSWER:") and out[3].source_link is None
    assert (out[2].answer, out[2].source_link) == (REPLY_NOT_FOUND, None)
    assert out[1].answer is None and out[4].answer == REPLY_OTHER


def test_other_embedder_is_refused(spark):
    qs, chunks, index = setup(spark)
    with pytest.raises(ValueError, match="vectors of 'other'"):
        answer_batch(qs, chunks.withColumn("embedder", F.lit("other")), index, k=2)
    with pytest.raises(ValueError, match="vectors of None"):
        answer_batch(qs, chunks.withColumn("embedder", F.lit(None).cast("string")), index, k=2)
    same = answer_batch(qs, chunks.withColumn("embedder", F.lit("hash-64")), index, k=2)
    assert same.count() == 4


def test_path_grams_are_not_broadcast(spark):
    # a few names keep Spark's estimate of the paths small; their n-grams must not go through the driver
    from pyspark.sql import functions as F
    from docket.operators.context import link_by_contains
    names = spark.createDataFrame([("a/1.pdf",), ("zz",), ("",)], "name string")
    index = spark.range(400).select(F.col("id").alias("pos"), F.concat(F.lit("x/A/"), F.col("id").cast("string"), F.lit(".pdf/tail")).alias("path"),
                                    F.col("id").cast("string").alias("link"))
    df = link_by_contains(names, index)
    assert {r.name: r.link for r in df.collect()} == {"a/1.pdf": "1", "zz": None, "": "0"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
