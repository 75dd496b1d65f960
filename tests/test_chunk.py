from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docket.operators import chunk as C


def test_recursive_goldens():
    assert [len(c) for c in C.split_recursive("a" * 1300)] == [1200, 300]
    t = "  " + "word " * 99 + " "
    assert C.split_recursive(t) == [t.strip()]
    assert C.split_recursive("") == []


def test_recursive_paragraphs_and_overlap():
    paras = ["p%d " % i + "x" * 500 for i in range(4)]
    text = "\n\n".join(paras)
    out = C.split_recursive(text, 1200, 200)
    assert out[0].startswith("p0") and all(len(c) <= 1200 for c in out)
    assert "".join(out).count("p3") >= 1


def test_recursive_long_word_kept_whole_at_char_level():
    out = C.split_recursive("b" * 2500, 1000, 100)
    assert [len(c) for c in out] == [1000, 1000, 700]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n")), max_size=400),
       st.integers(min_value=5, max_value=60), st.integers(min_value=0, max_value=4))
def test_recursive_properties(text, size, overlap):
    out = C.split_recursive(text, size, overlap)
    assert all(0 < len(c) <= size for c in out)
    assert all(c == c.strip() for c in out)
    # every non-space character survives, in order (overlap may repeat some)
    src = "".join(text.split())
    it = iter("".join("".join(c.split()) for c in out))
    assert all(ch in it for ch in src)


def test_fixed_windows(spark):
    df = spark.createDataFrame([("a" * 1300,), ("b" * 5,)], "t string")
    got = [[len(x) for x in r[0]] for r in df.select(C.fixed_windows("t", 1200, 200)).collect()]
    assert got == [[1200, 300], [5]]


def test_chunk_docs_skips_blank_keeps_index(spark):
    docs = spark.createDataFrame([("d/a.pdf", "hello", 0), ("b", "   ", 1), ("c", "x" * 1300, 2)],
                                 "name string, text string, doc_index bigint")
    rows = C.chunk_docs(docs).orderBy("doc_index", "chunk_id").collect()
    assert [(r.source, r.doc_index, r.chunk_id) for r in rows] == [("a.pdf", 0, 0), ("c", 2, 0), ("c", 2, 1)]
    import hashlib
    assert rows[0].id == hashlib.sha1(b"a.pdf00hello").hexdigest()


def test_recursive_udf_matches_python(spark):
    texts = ["a" * 1300, "x y " * 400, "l1\nl2\n" * 300, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.recursive_chunks("t")).collect()]
    assert got == [C.split_recursive(t) for t in texts]


def test_normalize_docs(spark):
    df = spark.createDataFrame([("f.pdf", None), ("g", "t")], "filename string, text string")
    assert [tuple(r) for r in C.normalize_docs(df).collect()] == [("f.pdf", ""), ("g", "t")]


def test_recursive_multi_level_hand_worked():
    # lines first; the 16-character line is split again on spaces; pieces keep
    # their separator at the front and chunks are trimmed
    text = "aaa bbb\nccc ddd eee fff\nggg"
    assert C.split_recursive(text, 10, 3) == ["aaa bbb", "ccc ddd", "eee fff", "ggg"]
    # overlap 4 carries the whole trailing piece ' ddd' / ' eee' into the next chunk
    assert C.split_recursive(text, 10, 4) == ["aaa bbb", "ccc ddd", "ddd eee", "eee fff", "ggg"]


def test_batches_are_bounded_and_long_ones_are_sliced(spark):
    from pyspark.sql import functions as F
    from docket.session import BATCHES, checkpoint_dir
    checkpoint_dir(spark)
    for k in BATCHES:
        assert spark.conf.get(k, None) is not None
    df = spark.range(40, numPartitions=1).select(F.when(F.col("id") % 7 != 3, F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("wörd "), 30_000))).alias("t"), "id")
    got = {r.id: r.c for r in df.select("id", C.recursive_chunks("t").alias("c")).collect()}
    for r in df.collect():
        assert got[r.id] == ([] if r.t is None else C.split_recursive(r.t))
