from docket.operators import history as H


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, question string")


def test_drop_repeats_golden(spark):
    t = turns(spark, [(1, i, q) for i, q in enumerate(["q1", "q1", " q1 ", "", "q2", "q1"])])
    got = [r.question for r in H.drop_repeats(t).orderBy("turn").collect()]
    assert got == ["q1", "q2", "q1"]


def test_drop_repeats_across_buckets(spark):
    qs = ["a", "a", "", "b", "b", " ", "", "b", "c", "a", "a"]
    t = turns(spark, [(7, i, q) for i, q in enumerate(qs)])
    full = [r.turn for r in H.drop_repeats(t).orderBy("turn").collect()]
    for b in (1, 2, 3):
        assert [r.turn for r in H.drop_repeats(t, bucket_turns=b).orderBy("turn").collect()] == full
    assert full == [0, 3, 8, 9]


def test_recent_questions(spark):
    t = turns(spark, [(1, i, "question %d " % i + "x" * (55 if i == 9 else 0)) for i in range(10)])
    r = H.recent_questions(H.drop_repeats(t)).orderBy("rk").collect()
    assert len(r) == 8 and r[0].question.startswith("question 9") and r[-1].question == "question 2"
    assert r[0].label.endswith("…") and len(r[0].label) == 61
