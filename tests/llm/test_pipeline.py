"""The corpus pipeline, stage by stage and whole."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from docket.llm import bpe, queries, secret_scan
from docket.llm.common import Forest, Scratch
from tests.conftest import SF001
from tests.llm.test_rows import _RULES


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(9001, "12 !!", None, "s", 5), (9002, None, "en", "s", None),
                                 (9003, "token=abcdefghijkl0123 was said here by them", "en", None, 44)], docs.schema)
    docs = docs.unionByName(odd).withColumn("extra", F.lit(1))
    scratch = Scratch(spark, "test")
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, SF001))
        assert docs.columns[-1] == "extra" and len(docs.columns) == 6
        seen[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rows} for n, rows in seen.items()}
    assert not {9001, 9002} & ids["language_id"] and len(ids["language_id"]) >= 199
    assert ids["minhash_near_dedup"] <= ids["language_id"]
    assert ids["secret_scan"] == ids["minhash_near_dedup"] == ids["source_mixing"]
    for r in seen["secret_scan"]:
        assert not any(ok(m) for k in secret_scan.BASE for m in _RULES[k][0].finditer(r["text"]) if (ok := _RULES[k][1]))
        assert r["n_chars"] == len(r["text"])
    out = P.tokens(spark, docs, SF001).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in seen["source_mixing"])
    texts = {r["doc_id"]: r["text"] for r in seen["source_mixing"]}
    codec = bpe.Codec(*bpe.default_vocabulary())
    for r in out[:50]:
        ids_ = codec.encode(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids_, "<u4").tobytes()).hexdigest()


def test_stages_by_brute_force_and_sql(spark, tmp):
    """Near-dedup against all pairs of shingle sets, mixing against its SQL, on the fixture with planted copies."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.filter("size(split(text, ' ')) > 60").orderBy("doc_id").limit(12).collect()
    near = [(8000 + i, r["text"] + (" one more" if i % 2 else ""), r["lang"], r["source"], None) for i, r in enumerate(rows)]
    near.append((None, rows[0]["text"], "en", "s", None))
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema))
    kept = Scratch(spark, "test").table(P.near_duplicates(spark, docs, SF001))
    given = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    words = [t.split() for _, _, t in given]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    forest = Forest(len(given))
    for i in range(len(given)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                forest.join(i, j)
    want = [d for i, (no, d, _) in enumerate(given) if forest.find(i) == i]
    assert len(want) <= len(given) - len(near)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    kept.write.parquet(f"{tmp}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp}/documents/*.parquet')")
    cur = con.execute(queries.SQL["op3_mixing"])
    at = [d[0] for d in cur.description].index("doc_id")
    mixed = P.mix_sources(spark, kept, SF001).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter(r[at] for r in cur.fetchall())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    scratch = Scratch(spark, "test")
    for _, stage in P.STAGES:
        docs = scratch.table(stage(spark, docs, SF001))
    assert docs.count() == 0


def test_run_is_the_stages(spark):
    rows = P.run(spark, SF001)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows.count() > 150
