from pyspark.sql import functions as F

from docket.functions import text as T


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_clean_context(spark):
    assert one(spark, T.clean_context("s"), "a\tb é c\n\n d") == "ab c d"


def test_strip_extension(spark):
    assert one(spark, T.strip_extension("s"), "N.PDF") == "N"
    assert one(spark, T.strip_extension("s"), "a.pdf.txt") == "a.pdf.txt"
    assert one(spark, T.strip_extension("s"), "a.pdf\n") == "a.pdf\n"


def test_safe_filename(spark):
    assert one(spark, T.safe_filename("s"), "a/b:?c") == "a_b_c"


def test_render_answer(spark):
    assert one(spark, T.render_answer("s"), "* one\n* two") == "<ul><li>one</li></ul><br><ul><li>two</li></ul>"
    assert one(spark, T.render_answer("s"), "**x**") == "<strong></strong>x<strong></strong>"
    assert one(spark, T.render_answer("s"), None) == ""
    assert one(spark, T.render_answer("s"), "1. a\n\nb") == "<ul><li>a</li></ul><br><br>b"


def test_base_name(spark):
    assert one(spark, T.base_name("s"), "x\\y/z.pdf") == "z.pdf"
    assert one(spark, T.base_name("s"), "x/") == ""


def test_doc_name(spark):
    df = spark.createDataFrame([("", None, "f"), (None, "b", None), ("", "", "")], "a string, b string, c string")
    assert [r[0] for r in df.select(T.doc_name("a", "b", "c")).collect()] == ["f", "b", "unknown"]


def test_ellipsis_and_snippet(spark):
    assert one(spark, T.ellipsis("s", 60), "x" * 61) == "x" * 60 + "…"
    assert one(spark, T.ellipsis("s", 60), "x" * 60) == "x" * 60
    assert one(spark, T.snippet("s", 5), "a \n\tbcdef") == "a b"


def test_tag_runs(spark):
    assert one(spark, T.tag_runs("s", "a:t"), "<a:t>x</a:t><a:t>y z</a:t>") == ["x", "y z"]
    assert one(spark, T.tag_runs("s", "a:t"), "<a:t>x\n</a:t>") == []


def test_trim_js_and_blank(spark):
    assert one(spark, T.trim_js("s"), " \t x \n") == "x"
    df = spark.createDataFrame([(" \t",), ("　",), ("a",), (None,)], "s string")
    assert [r[0] for r in df.select(T.is_blank("s")).collect()] == [True, True, False, True]


def test_content_id(spark):
    import hashlib
    got = one(spark, T.content_id(F.lit("n.pdf"), F.lit(12), F.lit(3), F.col("s")), "text é")
    assert got == hashlib.sha1("n.pdf123text é".encode()).hexdigest()


def test_normalize_reply(spark):
    assert one(spark, T.normalize_reply("s"), "  notes_query\n") == "NOTES_QUERY"


def test_answer_defaults(spark):
    from docket.operators.context import answer_defaults
    df = spark.createDataFrame([(1, None, "", None), (2, "* a", "Lab", "http://x")],
                               "qid int, answer string, source_label string, source_link string")
    cli = {r.qid: r for r in answer_defaults(df, "cli").collect()}
    assert (cli[1].answer, cli[1].source_label, cli[1].source_link) == (
        "No answer returned", "No source label", "No source link")
    assert cli[2].answer == "* a"
    page = {r.qid: r.html for r in answer_defaults(df, "page").collect()}
    assert page[1] == "No answer provided."
    assert page[2].startswith("<ul><li>a</li></ul><br><br>") and 'href="http://x"' in page[2] and ">Lab</a>" in page[2]


def test_clean_name(spark):
    from docket.operators.chunk import clean_name
    df = spark.createDataFrame([("", "dir\\\\sub/f.pdf", None), (None, None, None)], "name string, filename string, file string")
    assert [r[0] for r in df.select(clean_name("name", "filename", "file")).collect()] == ["f.pdf", "unknown"]
