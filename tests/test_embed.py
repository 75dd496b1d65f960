import hashlib
import math
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docket.operators import embed as M


def test_hash_embed_unit_and_consistent(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "   "), (3, "Ünïcode wörds  here")], "id bigint, text string")
    dense = {r.id: r.vector for r in M.hash_embed(df, "id", "text", 16).collect()}
    assert len(dense[1]) == 16 and abs(math.sqrt(sum(x * x for x in dense[1])) - 1) < 1e-12
    assert dense[2] == [0.0] * 16
    long = M.hash_embed_long(df, "id", "text", 16).collect()
    for r in long:
        assert abs(dense[r.id][r.bucket] - r.weight) < 1e-12


def test_with_model_retries(spark, tmp):
    marker = f"{tmp}/fail-once"

    def model(s: pd.Series) -> pd.Series:
        import os
        if not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("transient")
        return s.str.len().astype("float64").map(lambda x: [x])

    df = spark.createDataFrame([("ab",), ("abc",)], "t string").coalesce(1)
    out = M.with_model(df, "t", model, wait=0.01).collect()
    assert sorted(r.embedding[0] for r in out) == [2.0, 3.0]


def test_with_model_repeats_only_the_failing_call(spark, tmp):
    def model(s: pd.Series) -> pd.Series:
        import os
        with open(f"{tmp}/calls", "a") as f:
            f.write(s.iloc[0] + "\n")
        if s.iloc[0] == "c" and not os.path.exists(f"{tmp}/failed"):
            open(f"{tmp}/failed", "w").close()
            raise RuntimeError("transient")
        return s.map(lambda x: [float(ord(x))])

    df = spark.createDataFrame([(x,) for x in "abcdef"], "t string").coalesce(1)
    out = M.with_model(df, "t", model, wait=0.01, call_rows=2).collect()
    assert {r.t: r.embedding[0] for r in out} == {x: float(ord(x)) for x in "abcdef"}
    assert open(f"{tmp}/calls").read().split() == ["a", "c", "c", "e"]


def test_with_model_wrong_length_is_an_error(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="gave 1 values for 2 inputs"):
        M.with_model(df, "t", lambda s: [[1.0]], retries=2, wait=0.01).collect()


def test_md5_of_many_words_at_once():
    rng = random.Random(3)
    words = ["", "a", "x" * 54, "x" * 55, "x" * 56, "ü" * 27, "ü" * 28, "y" * 200] + [
        "".join(rng.choices("abcdefghäöß€", k=rng.randrange(0, 70))) for _ in range(500)]
    want = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in words]
    assert M._md5_heads(pa.array(words), rows=64).tolist() == want
    assert M._md5_heads(pa.array(words, pa.large_string()).slice(3, 90)).tolist() == want[3:93]
    assert M._md5_heads(pa.array([], pa.string())).tolist() == []


def test_hash_vector_equals_the_definition_in_columns(spark):
    texts = ["Über über  naïve\u00a0space\u2003x", "a\tb\nc\x0bd\x0ce\rf a", " lead and trail ", "", None, "w" * 120 + " w", "ΣΑΣ İstanbul",
             " ".join(f"t{i % 97}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r.id: r.vector for r in M.hash_embed(df, "id", "text", 24).collect()}
    tok = df.select("id", F.explode(M.tokens("text")).alias("t")).select("id", M.token_bucket(F.col("t"), 24).alias("b")).collect()
    for i in range(len(texts)):
        counts = [sum(r.id == i and r.b == b for r in tok) for b in range(24)]
        norm = math.sqrt(sum(c * c for c in counts))
        assert got[i] == [c / norm if norm else 0.0 for c in counts]


def test_hash_vector_hashes_in_batches(spark):
    # token by token in Spark's lambdas it took most of the ingest's time
    df = spark.range(3).select("id", F.lit("a b").alias("text"))
    plan = M.hash_embed(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan
