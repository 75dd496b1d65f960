"""Byte-level BPE encoding and decoding through a sentencepiece model written from the ranks.

The rank file is turned into a sentencepiece BPE model directly: every token is a
piece in which each byte stands as one character (``chr(BASE + byte)``), its score
is its negative rank, and the normaliser is the identity.  Texts are cut into
pre-tokens by the vocabulary's pattern; each distinct pre-token is encoded by the
model, and ids are decoded by the inverse map from id to bytes.

Defined results: a null text encodes like an empty one, to no ids; texts may be of
any length (nothing is cut); repeated rows repeat their result; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import ready

BASE = 0x4E00           # byte b is the character chr(BASE + b) inside the model
UNK = chr(BASE + 256)   # the model must have an unknown piece; no input contains it
CACHE = 150_000         # distinct pre-tokens remembered (about 100 bytes each), so some 15 MB per worker
GROUP = 300_000         # characters whose unknown pre-tokens are encoded together


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a ``.tiktoken`` file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and pre-token pattern of the public 50k vocabulary."""
    import public_tokenizers as P
    return read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


# -- the model file: protocol-buffer fields written by hand --------------------------------------

def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose id for a token is its place in rank order, plus 1."""
    # Field numbers and enum values of the sentencepiece model format.
    pieces, trainer, normalizer = 1, 2, 3
    piece, score, kind, unknown = 1, 2, 3, 2
    model_type, bpe, vocab_size = 3, 2, 4
    name, dummy_prefix, extra_spaces, escape = 1, 3, 4, 5

    def entry(text: str, rank: float, extra: bytes = b"") -> bytes:
        return _block(pieces, _block(piece, text.encode()) + _varint(score << 3 | 5)
                      + struct.pack("<f", -rank) + extra)

    out = [entry(UNK, 0.0, _number(kind, unknown))]
    out += [entry("".join(chr(BASE + b) for b in tok), float(r))
            for tok, r in sorted(ranks.items(), key=lambda x: x[1])]
    out.append(_block(trainer, _number(model_type, bpe) + _number(vocab_size, len(out))))
    out.append(_block(normalizer, _block(name, b"identity") + _number(dummy_prefix, 0)
                      + _number(extra_spaces, 0) + _number(escape, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary, made once per task."""

    limit = CACHE

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(ranks))
        pat = regex.compile(pattern)
        self.find, self.match = pat.findall, pat.match
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.rank = np.array([0] + [r for _, r in order], np.uint32)      # piece id -> rank
        # token bytes one after the other, by rank
        last = order[-1][1] + 1 if order else 0
        length = np.zeros(last, np.int64)
        for tok, r in order:
            length[r] = len(tok)
        self.length, self.start = length, np.concatenate([[0], np.cumsum(length)])
        self.blob = np.frombuffer(b"".join(t for t, _ in order), np.uint8)
        self.cache: dict[str, bytes] = {}

    def fill(self, tokens: Iterable[str]) -> None:
        """Encode the pre-tokens not in the cache (ids as little-endian 32-bit bytes)."""
        new = [t for t in tokens if t not in self.cache]
        if not new:
            return
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(_MAP) for t in new]
        got = self.sp.encode(mapped, num_threads=1)
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int64, int(n.sum()))
        raw, at = self.rank[flat].astype("<u4").tobytes(), 0
        for t, end in zip(new, (np.cumsum(n) * 4).tolist(), strict=True):
            self.cache[t] = raw[at:end]
            at = end

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(next(self.encode_all([text])), "<u4")

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: none), as little-endian 32-bit bytes.

        Texts are taken in groups of about ``GROUP`` characters, whose unknown
        pre-tokens the model encodes in one call."""
        for _, ids in self.pieces(texts):
            yield b"".join(ids)

    def pieces(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[bytes]]]:
        """The pre-tokens of each text, and the ids of each pre-token."""
        for group in _groups(texts):
            if len(self.cache) > self.limit:
                self.cache.clear()
            get, done, late = self.cache.get, [], []
            for t in group:
                tokens = self.find(t) if t else []
                ids = list(map(get, tokens))
                if None in ids:
                    late.append((tokens, ids))
                done.append((tokens, ids))
            self.fill({t for tokens, ids in late for t, x in zip(tokens, ids, strict=True) if x is None})
            for tokens, ids in late:
                ids[:] = [get(t) if x is None else x for t, x in zip(tokens, ids, strict=True)]
            yield from done

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        shift = self.start[ids] - (ends - n)
        return self.blob[np.repeat(shift, n) + np.arange(total)].tobytes()


def _groups(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


_MAP = {b: BASE + b for b in range(256)}
_CODEC: dict[str, Codec] = {}


def task_codec(key: str, shared) -> Codec:
    """The worker's codec for a broadcast vocabulary; made once per worker process."""
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(*shared.value)
    return _CODEC[key]


def shared_codec(spark, ranks: dict[bytes, int] | None = None, pattern: str | None = None):
    """A function that gives the task's codec; vocabulary and model (about 2 MB) are broadcast."""
    base, pat = (ranks, pattern) if ranks is not None else default_vocabulary()
    shared = ready(spark).sparkContext.broadcast((base, pattern or pat, model_bytes(base)))
    return partial(task_codec, uuid.uuid4().hex, shared)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", codec=None) -> DataFrame:
    """Add ``out``: the token ids of every whole text, as an array of int."""
    codec = codec or shared_codec(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec()
        for arr in batches:
            got = list(c.encode_all(x.as_py() for x in arr))
            flat = pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))
            ends = np.cumsum([0] + [len(g) // 4 for g in got])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    own = [c for c in docs.columns if c != out]
    return docs.select(*own, run(F.col(text)).alias(out))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", codec=None) -> DataFrame:
    """Add ``out``: the bytes that an array of ids stands for (null ids: no bytes)."""
    codec = codec or shared_codec(rows.sparkSession)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec()
        for arr in batches:
            yield pa.array([c.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in arr], pa.binary())

    own = [c for c in rows.columns if c != out]
    return rows.select(*own, run(F.col(ids)).alias(out))


def round_trip(docs: DataFrame, text: str = "text", codec=None) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: every text is encoded, the ids
    are decoded, and digests of both are kept instead of the ids themselves."""
    codec = codec or shared_codec(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec()
        for arr in batches:
            n, a, b = [], [], []
            for raw in c.encode_all(x.as_py() for x in arr):
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(c.decode(np.frombuffer(raw, "<u4"))).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             ["n_tokens", "ids_sha256", "decoded_sha256"])

    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    own = [c for c in docs.columns if c not in new]
    return (docs.select(*own, run(F.col(text)).alias("__bpe"))
                .select(*own, *[F.col(f"__bpe.{c}").alias(c) for c in new]))
