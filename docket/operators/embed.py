"""Vectors: a user model over Arrow batches with retries (M1) and a deterministic
feature-hashing embedder standing in for a remote model (M2)."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions._util import byte_slices
from docket.functions._util import col as _col


RETRIES = 5
WAIT_SECONDS = 2.0
CALL_ROWS = 32


def with_model(df: DataFrame, in_col: str, fn: Callable[[pd.Series], pd.Series],
               out_col: str = "embedding", out_type: str = "array<float>",
               retries: int = RETRIES, wait: float = WAIT_SECONDS, call_rows: int = CALL_ROWS) -> DataFrame:
    """M1: add ``out_col = fn(in_col)`` in calls of at most ``call_rows`` rows.

    ``fn`` takes a pandas Series of inputs and returns a Series of the same
    length; another length is an error like any other.  A failing call is retried up to
    ``retries`` times, ``wait`` seconds apart, without repeating the calls before it; the
    last error is raised (and then Spark's own task retry applies).  Calls run in parallel
    across tasks, not one at a time.
    """
    schema = f"{', '.join(f'`{c}` {t}' for c, t in _ddl(df))}, `{out_col}` {out_type}"

    def call(texts: pd.Series) -> list:
        for attempt in range(1, retries + 1):
            try:
                vals = list(fn(texts))
                if len(vals) != len(texts):
                    raise ValueError(f"the model gave {len(vals)} values for {len(texts)} inputs")
                return vals
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(wait)

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            out[out_col] = [v for lo in range(0, len(pdf), call_rows)
                            for v in call(pdf[in_col].iloc[lo:lo + call_rows])]
            yield out

    return df.mapInPandas(run, schema)


def _ddl(df: DataFrame):
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


# Token separators: ASCII whitespace (the same class in every engine used here).
TOKEN_SPLIT = r"[ \t\n\x0b\f\r]+"


def tokens(text) -> Column:
    """Lower-cased whitespace-separated tokens (empty ones dropped)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda x: F.length(x) > 0)


def token_bucket(tok: Column, dim: int) -> Column:
    """Bucket of a token: first 8 hex digits of its MD5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


# MD5 (RFC 1321): shifts and constants of its 64 steps, and the word each reads
_SHIFT = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_ADD = np.floor(2.0 ** 32 * np.abs(np.sin(np.arange(1, 65)))).astype(np.uint64).astype(np.uint32)
_WORD = [(m * i + c) % 16 for i, (m, c) in enumerate([(1, 0)] * 16 + [(5, 1)] * 16 + [(3, 5)] * 16 + [(7, 0)] * 16)]


def _md5_heads(words: pa.Array, rows: int = 1 << 14) -> np.ndarray:
    """The first four bytes of each text's MD5, as a number: all words of one MD5 block (up to 55 bytes) side by side."""
    words = words.cast(pa.large_binary())
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    flat = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = np.empty(len(words), np.int64)
    for lo in range(0, len(words), rows):
        start = off[lo:lo + rows + 1]
        n = np.diff(start)
        start, long = start[:-1], np.flatnonzero(n > 55)
        n[long] = 0
        text = np.zeros((len(n), 64), np.uint8)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text[np.repeat(np.arange(len(n)), n), at] = flat[np.repeat(start, n) + at]
        text[np.arange(len(n)), n] = 0x80
        word = np.ascontiguousarray(text.view("<u4").T)
        word[14] = 8 * n
        first = np.uint32(0x67452301)
        a, b, c, d = (np.full(len(n), x, np.uint32) for x in (first, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
            f += a
            f += _ADD[i]
            f += word[_WORD[i]]
            a, d, c, b = d, c, b, b + ((f << np.uint32(_SHIFT[i])) | (f >> np.uint32(32 - _SHIFT[i])))
        out[lo:lo + rows] = (a + first).byteswap()
        for i in long.tolist():
            out[lo + i] = int.from_bytes(hashlib.md5(words[lo + i].as_py(), usedforsecurity=False).digest()[:4], "big")
    return out


def hash_vector(text, dim: int = 64) -> Column:
    """M2 as a column: term counts of the lower-cased text hashed into ``dim``
    buckets (first 8 hex digits of each token's MD5, modulo ``dim``),
    L2-normalised; all zeros for a text without tokens.  Not a semantic model.

    Every token of a text is in its row, so the vector is built row-locally: no shuffle.  Lower-casing is
    Spark's; tokens are hashed and counted by an Arrow UDF over slices of a batch, each distinct token of a slice once.
    """

    @F.arrow_udf("array<double>")
    def _vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in byte_slices(texts):
                words = pc.ascii_split_whitespace(pc.fill_null(part, ""))
                known = words.flatten().dictionary_encode()
                bucket = np.where(np.asarray(pc.binary_length(known.dictionary)) > 0, _md5_heads(known.dictionary) % dim, -1)
                at = bucket[known.indices.to_numpy()]
                row = np.repeat(np.arange(len(part)) * dim, np.diff(words.offsets.to_numpy()))
                counts = np.bincount((row + at)[at >= 0], minlength=len(part) * dim).reshape(-1, dim)
                norm = np.sqrt((counts * counts).sum(1).astype(np.float64))
                values = counts / np.where(norm > 0, norm, 1.0)[:, None]
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(values.ravel()))

    return _vectors(F.lower(_col(text)))


def hash_embed(df: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = 64,
               out_col: str = "vector") -> DataFrame:
    """M2: ``(id, vector array<double>)`` for every row."""
    return df.select(F.col(id_col), hash_vector(text_col, dim).alias(out_col))


def hash_embed_long(df: DataFrame, id_col: str = "id", text_col: str = "text",
                    dim: int = 64) -> DataFrame:
    """M2 in long form: ``(id, bucket, weight)`` for the non-zero buckets."""
    v = hash_embed(df, id_col, text_col, dim, "_v")
    return (v.select(F.col(id_col), F.posexplode("_v").alias("bucket", "weight"))
             .filter(F.col("weight") != 0)
             .withColumn("bucket", F.col("bucket").cast("bigint")))
