"""Sources and sinks: file scan (S1), JSON rows (S2), file index (S3), archive
text extraction (S4), collection read (S5), stage writes (K1)."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docket.functions.text import tag_runs
from docket.operators.store import PART, stored_rows

# The document kinds extracted, matched case-sensitively on the name.
SUFFIXES = (".pdf", ".docx", ".pptx")
SLIDE_PREFIX = "ppt/slides/slide"
SLIDE_TAG = "a:t"
WORD_ENTRY = "word/document.xml"


def scan_files(spark: SparkSession, path: str, suffixes=SUFFIXES, with_content: bool = True) -> DataFrame:
    """Every file under ``path`` (recursive) whose name ends with one of
    ``suffixes``: ``(path, name[, content])``.  Content is read only when selected."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
          .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    cond = None
    for s in suffixes:
        c = F.col("name").endswith(s)
        cond = c if cond is None else (cond | c)
    df = df.filter(cond)
    cols = ["path", "name"] + (["content"] if with_content else [])
    return df.select(*cols)


def scan_json_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file holding one JSON array of objects, or a folder of such files, as rows
    (explicit schema).  A file is one document and so one task; folders are read in parallel."""
    return (spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
            .json(path))


def scan_file_index(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON object path -> link as ``(pos, path, link)`` in file order.

    A missing or unreadable file gives an empty index.  A key given twice
    keeps its first position and its last link.
    """
    empty = spark.createDataFrame([], "pos bigint, path string, link string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    parsed = raw.select(F.from_json("value", "map<string,string>").alias("m")).filter(F.col("m").isNotNull())
    rows = parsed.select(F.posexplode(F.map_entries("m")).alias("pos", "e")) \
                 .select(F.col("pos").cast("bigint").alias("pos"), F.col("e.key").alias("path"),
                         F.col("e.value").alias("link"))
    return rows.groupBy("path").agg(F.min("pos").alias("pos"), F.max_by("link", "pos").alias("link")) \
               .select("pos", "path", "link")


_ENTRY_SCHEMA = "path string, kind string, entry_pos int, payload string, status string"


def _word_text(xml: bytes) -> str:
    """Paragraph texts of a word-processing document, blank line between paragraphs."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(xml)
    paras = []
    for p in root.iter(ns + "p"):
        paras.append("".join(t.text or "" for t in p.iter(ns + "t")))
    return "\n\n".join(paras)


def _slides(content: bytes) -> list[str]:
    """The slide documents of a deck, in archive order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [z.read(i.filename).decode("utf-8", "replace") for i in z.infolist()
                if i.filename.startswith(SLIDE_PREFIX) and i.filename.endswith(".xml")]


def _archive_entries(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            # a file's rows are added only once all of it was read: a damaged one gives '' and 'error'
            try:
                if path.endswith(".pptx"):
                    slides = _slides(content)
                    rows = [(path, "slides", i, x, "ok") for i, x in enumerate(slides)] or [(path, "slides", 0, "", "ok")]
                elif path.endswith(".docx"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, "word", 0, _word_text(z.read(WORD_ENTRY)), "ok")]
                else:
                    rows = [(path, "other", 0, "", "unsupported")]
            except Exception:  # noqa: BLE001
                rows = [(path, "error", 0, "", "error")]
            out += rows
        yield pd.DataFrame(out, columns=["path", "kind", "entry_pos", "payload", "status"])


def extract_archive_text(files: DataFrame) -> DataFrame:
    """``(path, name, text, status)`` per file.

    Slide decks: entries ``ppt/slides/slide*.xml`` in archive order, every
    ``<a:t>`` run on its own line (runs taken natively by T8).  Word files: the
    paragraph texts.  Other kinds (PDF) pass through with status
    'unsupported'; a file that is damaged anywhere gives '' with status 'error'.
    Files are read and unzipped once; a group holds one file's slides.
    """
    ent = files.select("path", "content").mapInPandas(_archive_entries, _ENTRY_SCHEMA)
    runs = F.array_join(F.transform(tag_runs("payload", SLIDE_TAG), lambda x: F.concat(x, F.lit("\n"))), "")
    text = F.when(F.col("kind") == "slides", runs).otherwise(F.col("payload"))
    g = ent.select("path", "entry_pos", "status", text.alias("text")).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("entry_pos", "text"))).alias("_e"), F.min("status").alias("status"))
    return g.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                    F.array_join(F.transform("_e", lambda x: x["text"]), "").alias("text"), "status")


def collection_get(spark: SparkSession, path: str, fields=None) -> DataFrame:
    """The stored collection, only the chosen fields (pruned at the scan)."""
    df = stored_rows(spark, path)
    return df.select(*fields) if fields else df.drop(PART)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1: write a stage's rows (parquet by default; JSON lines on request)."""
    df.write.mode(mode).format(fmt).save(path)


