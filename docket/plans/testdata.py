"""Stand-in tables derived from the given parquet tables.

The reference keeps a file index (path -> link), a vector collection and
chat questions; the test tables hold none of these directly, so each is derived
here by a fixed rule, over the whole table, and the DuckDB oracles derive the
same (see ``docket.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions.route import SUBJECTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, path, link)``: every page as a file, path = url without scheme + '.pdf'."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"),
        F.concat(F.regexp_replace("url", r"^[a-z]+://", ""), F.lit(".pdf")).alias("path"),
        F.col("url").alias("link"))


def notes_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, path, link)`` named like course notes, so module, semester and
    subject filters have something to find: '<subject> module <m> <s>th sem
    <url without scheme>.pdf'."""
    pages = table(spark, sf_dir, "pages")
    subj = F.element_at(F.array(*[F.lit(s.name) for s in SUBJECTS], F.lit("misc")),
                        (F.col("page_id") % (len(SUBJECTS) + 1) + 1).cast("int"))
    path = F.concat(subj, F.lit(" module "), (F.col("page_id") % 6).cast("string"),
                    F.lit(" "), (F.col("page_id") % 4 + 1).cast("string"), F.lit("th sem "),
                    F.regexp_replace("url", r"^[a-z]+://", ""), F.lit(".pdf"))
    return pages.select(F.col("page_id").alias("pos"), path.alias("path"), F.col("url").alias("link"))


def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on the test tables: each document with its vector (``doc_id = vec_id``).

    ``(id, source, content, vector)``; source = '<lang>/<doc_id>.pdf'.
    """
    docs = table(spark, sf_dir, "documents")
    vecs = table(spark, sf_dir, "embeddings")
    j = docs.join(vecs, docs.doc_id == vecs.vec_id)
    return j.select(F.col("doc_id").alias("id"),
                    F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"),
                             F.lit(".pdf")).alias("source"),
                    F.col("text").alias("content"),
                    F.col("embedding").alias("vector"))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector asked as a question: ``(qid, vector)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"),
                                                     F.col("embedding").alias("vector"))


# Fixed wording used to turn the test texts into questions of each category.
QUESTION_LEADS = ("hello", "send the notes pdf for", "explain", "tell me about")


def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions ``(qid, question)``: qid = 'conv_id:turn';
    a lead word chosen by conversation, and a module / semester by turn."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    lead = F.element_at(F.array(*[F.lit(s) for s in QUESTION_LEADS]),
                        (F.col("conv_id") % len(QUESTION_LEADS) + 1).cast("int"))
    q = F.concat(lead, F.lit(" "), F.col("text"), F.lit(" module "),
                 (F.col("turn") % 5).cast("string"), F.lit(" "),
                 (F.col("conv_id") % 5).cast("string"), F.lit("th sem"))
    return conv.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), q.alias("question"))


# Fixed keyword cycle mixed into benchmark questions (includes no keyword).
BENCH_TOPICS = ("deadlock", "stack", "logic gates", "probability", "", "queue", "graphs")


def bench_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as notes requests ``(qid, question)``."""
    b = table(spark, sf_dir, "benchmark")
    topic = F.element_at(F.array(*[F.lit(s) for s in BENCH_TOPICS]),
                         (F.col("item_id") % len(BENCH_TOPICS) + 1).cast("int"))
    q = F.concat(F.col("text"), F.lit(" "), topic, F.lit(" module "),
                 (F.col("item_id") % 7).cast("string"), F.lit(" "),
                 (F.col("item_id") % 5).cast("string"), F.lit("th sem notes"))
    return b.select(F.col("item_id").alias("qid"), q.alias("question"))


def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names on disk: base names of the notes index paths."""
    from docket.functions.text import base_name
    return notes_index(spark, sf_dir).select(base_name("path").alias("name"))


def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per page: its stored name, that name + '.bak' (absent), or
    nothing, by page id."""
    from docket.functions.text import base_name
    n = notes_index(spark, sf_dir)
    name = base_name("path")
    req = (F.when(F.col("pos") % 3 == 0, name)
            .when(F.col("pos") % 3 == 1, F.concat(name, F.lit(".bak")))
            .otherwise(F.lit("")))
    return n.select(F.col("pos").alias("req_id"), req.alias("name"))


def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as history ``(conv_id, turn, question)``, each four times over: as it is,
    again with spaces around it, blank, and with a mark; so repeats, blanks and long lists occur."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    forms = F.array(F.col("text"), F.concat(F.lit(" "), F.col("text"), F.lit("  ")), F.lit("  "),
                    F.concat(F.col("text"), F.lit(" again")))
    return conv.select("conv_id", F.col("turn").alias("t"), F.posexplode(forms).alias("j", "question")) \
               .select("conv_id", (F.col("t") * 4 + F.col("j")).alias("turn"), "question")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: every document as a deck of two slides (even ids) or a word file."""
    import pandas as pd

    def build(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["line"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    if i % 2 == 0:
                        z.writestr("ppt/slides/slide1.xml", f"<a:t>{text}</a:t>")
                        z.writestr("ppt/slides/slide2.xml", f"<a:t>doc</a:t><a:t>{i}</a:t>")
                    else:
                        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
                        z.writestr("word/document.xml", f'<w:d xmlns:w="{ns}"><w:p><w:t>{escape(text)}</w:t></w:p>'
                                                        f"<w:p><w:t>doc {i}</w:t></w:p></w:d>")
                rows.append((f"mem/{i}.{'pptx' if i % 2 == 0 else 'docx'}", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(
        F.coalesce("text", F.lit("")), r"[\n\r<>&]", " ").alias("line"))
    return docs.mapInPandas(build, "path string, content binary")
