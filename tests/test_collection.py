import os

from pyspark.sql import functions as F

from docket.operators import collection as K
from docket.operators import store as ST
from docket.sources.files import collection_get


def test_row_index_and_batches(spark):
    df = spark.range(0, 601, numPartitions=7).withColumn("id", F.format_string("k%04d", "id"))
    idx = K.row_index(df, [F.col("id")]).collect()
    assert sorted((r.id, r.row_index) for r in idx) == [("k%04d" % i, i) for i in range(601)]
    for n in (0, 300, 301):
        d = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("document"),
                                  F.struct(F.lit("s").alias("source")).alias("metadata"),
                                  F.array(F.lit(1.0)).alias("embedding"))
        pb = K.pack_batches(d, 300, [F.col("id").cast("bigint")]).orderBy("batch").collect()
        assert [len(r.ids) for r in pb] == ([300] * (n // 300) + ([n % 300] if n % 300 else []))
        if n:
            assert pb[0].ids[:3] == ["0", "1", "2"]


def test_positional_id(spark):
    df = spark.createDataFrame([(3,)], "pos bigint")
    assert df.select(K.positional_id()).first()[0] == "doc_3"


def test_upsert_round_trip(spark, tmp):
    path = os.path.join(tmp, "coll")
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "id string, text string")
    assert K.collection_upsert(rows, path) == 2
    assert K.collection_upsert(rows, path) == 0
    more = spark.createDataFrame([("c", "w"), ("a", "q")], "id string, text string")
    assert K.collection_upsert(more, path) == 1
    got = sorted(tuple(r) for r in collection_get(spark, path).collect())
    assert got == [("a", "x"), ("b", "y"), ("c", "w")]


def test_small_batches_read_few_stored_ids(spark, tmp):
    path = os.path.join(tmp, "coll")
    rows = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("n"))
    got = ST.add_new(rows(0, 40_000), path, part_rows=1000)
    assert (got["added"], got["parts"], got["ids_read"]) == (40_000, 64, 0)
    got = ST.add_new(rows(50_000, 51_000), path, part_rows=1000)
    assert got["added"] == 1000 and got["ids_read"] < 4000          # of 40,000
    got = ST.add_new(rows(39_990, 40_010), path, part_rows=1000)
    assert got["added"] == 10 and got["parts_read"] <= 12
    assert ST.add_new(rows(0, 40_010), path, part_rows=1000)["added"] == 0
    assert collection_get(spark, path).count() == collection_get(spark, path, ["id"]).distinct().count() == 41_010


def test_parts_split_as_the_store_grows(spark, tmp):
    path = os.path.join(tmp, "coll")
    for i in range(5):                  # 32 parts for the first 3,500 rows, enough up to 12,800
        rows = spark.range(i * 3000, (i + 1) * 3000 + 500).select("id", (F.col("id") * 2).alias("n"))
        got = ST.add_new(rows, path, part_rows=200)
    assert got["parts"] == 128 and ST.parts_of(spark, path) == 128
    assert sorted(os.listdir(path)) == ["rows-128", "sketch-128"]
    assert sorted(tuple(r) for r in collection_get(spark, path).collect()) == [(i, 2 * i) for i in range(15_500)]


def test_a_batch_that_broke_off_is_completed(spark, tmp):
    """The sketch is written, the rows are not: the same batch again stores them."""
    path = os.path.join(tmp, "coll")
    a, b = (spark.range(lo, lo + 50).select("id", F.lit("x").alias("t")) for lo in (0, 50))
    ST.add_new(a, path)
    ST._sketch(ST._keyed(b, "id", 8), "id").write.mode("append").parquet(f"{path}/sketch-8")
    assert ST.add_new(b, path)["added"] == 50 and collection_get(spark, path).count() == 100
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "id bigint, t string")
    assert [ST.add_new(nulls, path)["added"] for _ in range(2)] == [1, 0]


def test_parity(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    b = spark.createDataFrame([(2,), (3,), (4,)], "id bigint")
    assert sorted(tuple(r) for r in K.check_parity(a, b).collect()) == [("left_only", 1), ("right_only", 4)]
    import pytest
    with pytest.raises(ValueError):
        K.check_parity(a, b, raise_on_mismatch=True)


def test_records_and_sample(spark):
    df = spark.createDataFrame([("s.pdf", 0, 1, None)], "source string, chunk_id int, doc_index bigint, module string")
    r = K.embedding_record(df.drop("module")).withColumn("module", F.lit(None).cast("string"))
    m = r.select(K.metadata_record("full").alias("m")).first().m
    assert (m.pdf, m.pdf_url, m.module) == ("s.pdf", "/pdf/s.pdf", "")
    s = K.sample_rows(spark.range(10), [F.col("id").desc()], 3).collect()
    assert [x.id for x in s] == [9, 8, 7]
    c = K.stage_counts(a=spark.range(3), b=spark.range(5)).collect()
    assert sorted(tuple(x) for x in c) == [("a", 3), ("b", 5)]


def test_parity_counts_and_hot_id(spark):
    import pytest
    a = spark.createDataFrame([(1,)] * 50 + [(2,)], "id bigint")
    b = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert K.check_parity(a, b).count() == 0
    with pytest.raises(ValueError, match="row counts differ"):
        K.check_parity(a, b, raise_on_mismatch=True)


def test_cleanup_removes_only_own_tables(spark, tmp):
    from docket.session import cleanup, materialize
    keep = os.path.join(tmp, "keep")
    spark.range(3).write.parquet(keep)
    m = materialize(spark.range(5), "probe")
    assert m.count() == 5
    path = m.inputFiles()[0].rsplit("/", 1)[0].replace("file:", "")
    assert cleanup(spark) >= 1
    assert not os.path.exists(path) and os.path.exists(keep)


def test_parity_of_equal_tables_joins_nothing(spark):
    a = spark.range(20_000).select("id")
    assert K.check_parity(a, a.repartition(7), raise_on_mismatch=True).count() == 0
    b = a.filter("id <> 77").unionByName(spark.createDataFrame([(None,), (30_000,), (5,)], "id bigint"))
    assert sorted(tuple(r) for r in K.check_parity(a, b).collect()) == [("left_only", 77), ("right_only", 30_000)]
    digests = K._digests(a, "id", "d").join(K._digests(b, "id", "e"), "_range", "full_outer")
    assert digests.filter("not (d <=> e)").count() <= 4            # the ranges of the four ids that differ, of 4,096
