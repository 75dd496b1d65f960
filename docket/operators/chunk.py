"""Documents to chunks: blank drop (P4), names (P2, P3), fixed windows (C2),
recursive splitting (C1), chunk positions (W5), ids (T7) and records (P5).

Chunking is row-local: no shuffle.  C2 is all native; C1's greedy packing is
order-dependent inside one text, so it runs as an Arrow UDF over slices of a batch
that returns the chunk list, exploded natively afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions._util import byte_slices
from docket.functions._util import col as _col
from docket.functions.text import base_name, content_id, doc_name, is_blank

SEPARATORS = ("\n\n", "\n", " ", "")
# Whitespace as trimmed by a script-language trim().
_JS_WS = ("\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    cur: list[str] = []
    total = 0
    for p in pieces:
        n = len(p)
        if total + n > size and cur:
            doc = "".join(cur).strip(_JS_WS)
            if doc:
                out.append(doc)
            while total > overlap or (total + n > size and total > 0):
                total -= len(cur[0])
                cur.pop(0)
        cur.append(p)
        total += n
    doc = "".join(cur).strip(_JS_WS)
    if doc:
        out.append(doc)
    return out


def split_recursive(text: str, size: int = 1200, overlap: int = 200,
                    separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split on the first separator present, pack pieces greedily up to ``size``
    with whole-piece overlap, and split oversize pieces with the later separators."""
    sep, rest = separators[-1], None
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, separators[i + 1:]
            break
    if sep:
        pieces = [p for p in re.split("(?=" + re.escape(sep) + ")", text) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    good: list[str] = []
    for p in pieces:
        if len(p) < size:
            good.append(p)
            continue
        if good:
            out.extend(_pack(good, size, overlap))
            good = []
        if rest is None:
            out.append(p)
        else:
            out.extend(split_recursive(p, size, overlap, rest))
    if good:
        out.extend(_pack(good, size, overlap))
    return out


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop rows whose text is null or whitespace only."""
    return df.filter(~is_blank(text_col))


def normalize_docs(df: DataFrame, name_col: str = "filename", text_col: str = "text") -> DataFrame:
    """Rename the name column to ``name``; null or empty text becomes ''."""
    return df.select(F.col(name_col).cast("string").alias("name"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def clean_name(*name_cols) -> Column:
    """P2 + P3: first non-empty name, base name only."""
    return base_name(doc_name(*name_cols))


def fixed_windows(text, size: int = 1200, overlap: int = 200) -> Column:
    """C2 as a column: character windows of ``size`` starting every ``size - overlap``."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    t = _col(text)
    n = F.length(t)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1),
                       lambda i: F.substring(t, i * step + 1, size))


def recursive_chunks(text, size: int = 1200, overlap: int = 200,
                     separators: tuple[str, ...] = SEPARATORS) -> Column:
    """C1 as a column (array<string>), evaluated by an Arrow UDF."""

    @F.arrow_udf("array<string>")
    def _split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in byte_slices(texts):         # only a slice of a batch is held as Python strings
                yield pa.array([split_recursive(t, size, overlap, separators) if t is not None else []
                                for t in part.to_pylist()], pa.list_(pa.string()))

    return _split(_col(text))


def chunk_docs(docs: DataFrame, name_col: str = "name", text_col: str = "text",
               index_col: str = "doc_index", method: str = "recursive",
               size: int = 1200, overlap: int = 200) -> DataFrame:
    """C1/C2 + W5 + T7 + P5: ``(id, source, doc_index, chunk_id, content)``.

    ``index_col`` is the document's position in the input list (see
    ``collection.row_index``); a blank document keeps its position unused.
    """
    if method == "recursive":
        arr = recursive_chunks(text_col, size, overlap)
    elif method == "fixed":
        arr = fixed_windows(text_col, size, overlap)
    else:
        raise ValueError("method is 'recursive' or 'fixed'")
    kept = drop_blank(docs, text_col)
    exploded = kept.select(base_name(F.col(name_col)).alias("source"),
                           F.col(index_col).cast("bigint").alias("doc_index"),
                           F.posexplode(arr).alias("chunk_id", "content"))
    return exploded.select(
        content_id("source", "doc_index", "chunk_id", "content").alias("id"),
        "source", "doc_index", F.col("chunk_id").cast("int").alias("chunk_id"), "content")
