"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each text as UTF-8 bytes in windows of ``WINDOW`` bytes, both
ways, and gives every byte position a probability per language; the document's
probabilities are the mean over all its positions.  It is trained in numpy by
backpropagation through time on a bounded sample: at most ``per_lang`` documents
per language; a document of more than ``PLACES`` x ``PIECE`` characters gives so many pieces
at places drawn from its whole length.  Prediction reads whole texts.

Defined results: a null text, an empty text and a text without any letter give
``und`` with score 0; rows are independent, so repeated rows repeat their result; of
rows that repeat an id and language in the sample the smallest text is learned;
an empty table, or one without labelled rows, gives ``und`` with score 0; columns named
like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.llm.common import byte_slices, ready, utf8

UND = "und"
PER_LANG = 240      # training documents per language
PLACES, PIECE = 10, 300     # pieces and their characters, of a long training document
HIDDEN = 6          # state size per direction
WINDOW = 48         # bytes per window
STEPS, BATCH, RATE = 260, 256, 0.02
LANES = 4096        # windows run side by side at prediction


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


# -- the network, with f(a) = a / (1 + |a|), cheaper than tanh and of the same shape:
#    z, r = (1 + f) / 2 of Ez[x] + Uz h and Er[x] + Ur h;  c = f(Ec[x] + r * (Uc h));  h' = c + z (h - c)

def _squash(a: np.ndarray, tmp: np.ndarray) -> None:
    np.abs(a, out=tmp)
    tmp += 1
    a /= tmp


def _run(E: np.ndarray, U: np.ndarray, X: np.ndarray, M: np.ndarray | None, back: bool,
         keep: list | None = None) -> np.ndarray:
    """States of one direction: T x H x n.  ``X`` bytes T x n, ``M`` 0/1 T x n or None."""
    (T, n), H = X.shape, U.shape[1]
    out = np.empty((T, H, n), np.float32)
    h = np.zeros((H, n), np.float32)
    g, u, tmp = (np.empty((3 * H, n), np.float32) for _ in range(3))
    for t in (range(T - 1, -1, -1) if back else range(T)):
        if keep is not None:
            g, u = np.empty_like(g), np.empty_like(u)
        np.take(E, X[t], axis=1, mode="clip", out=g)
        np.matmul(U, h, out=u)
        zr, c, uc = g[:2 * H], g[2 * H:], u[2 * H:]
        zr += u[:2 * H]
        _squash(zr, tmp[:2 * H])
        zr += 1
        zr *= 0.5
        np.multiply(zr[H:], uc, out=tmp[:H])
        c += tmp[:H]
        _squash(c, tmp[:H])
        new = out[t]
        np.subtract(h, c, out=new)
        new *= zr[:H]
        new += c
        if M is not None:
            new *= M[t]
        if keep is not None:
            keep.append((t, h, zr, uc, c))
        h = new
    return out


def _back(U: np.ndarray, X: np.ndarray, keep: list, dOut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of E and U from the gradient of every state (through time)."""
    H = U.shape[1]
    n = X.shape[1]
    dE, dU = np.zeros((3 * H, 256), np.float32), np.zeros_like(U)
    dh = np.zeros((H, n), np.float32)
    for t, h, zr, uc, c in reversed(keep):
        dh = dh + dOut[t]
        z, r = zr[:H], zr[H:]
        dc = dh * (1 - z) * (1 - np.abs(c)) ** 2                 # f' = (1 - |f|)^2
        dz = dh * (h - c) * (1 - np.abs(2 * z - 1)) ** 2 / 2
        dr = dc * uc * (1 - np.abs(2 * r - 1)) ** 2 / 2
        du = np.concatenate([dz, dr, dc * r])
        dg = np.concatenate([dz, dr, dc])
        hot = np.zeros((n, 256), np.float32)
        hot[np.arange(n), X[t]] = 1
        dE += dg @ hot
        dU += du @ h.T
        dh = dh * z + U.T @ du
    return dE, dU


def train(texts: list[str], langs: list[str], seed: int = 7, steps: int = STEPS,
          hidden: int = HIDDEN, window: int = WINDOW) -> dict:
    """Fit the network on labelled texts; every position of a window carries its text's label."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    by = [[b for t, g in zip(texts, langs, strict=True) if g == name and (b := t.encode("utf-8", "replace"))]
          for name in names]
    keep = [i for i, b in enumerate(by) if b]
    names, by = [names[i] for i in keep], [by[i] for i in keep]
    L, H = len(names), hidden
    if L == 0:
        return {"names": [], "window": window}
    p = {"Ef": rng.normal(0, .3, (3 * H, 256)), "Uf": rng.normal(0, H ** -.5, (3 * H, H)),
         "Eb": rng.normal(0, .3, (3 * H, 256)), "Ub": rng.normal(0, H ** -.5, (3 * H, H)),
         "W": rng.normal(0, .3, (L, 2 * H)), "b": np.zeros((L, 1))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, L, BATCH)
        X = np.zeros((window, BATCH), np.uint8)
        M = np.zeros((window, BATCH), np.float32)
        for j, lab in enumerate(y):
            b = by[lab][rng.integers(len(by[lab]))]
            at = rng.integers(0, max(1, len(b) - window + 1))
            w = np.frombuffer(b, np.uint8)[at:at + window]
            X[:len(w), j], M[:len(w), j] = w, 1
        kf: list = []
        kb: list = []
        hf, hb = _run(p["Ef"], p["Uf"], X, M, False, kf), _run(p["Eb"], p["Ub"], X, M, True, kb)
        hh = np.concatenate([hf, hb], axis=1)                    # T x 2H x n
        q = _softmax(p["W"] @ hh + p["b"])
        d = q.copy()
        d[:, y, np.arange(BATCH)] -= 1
        d *= M[:, None, :] / M.sum()
        dh = p["W"].T @ d
        g = {"W": np.einsum("tln,thn->lh", d, hh, optimize=True), "b": d.sum((0, 2))[:, None]}
        dh *= M[:, None, :]
        g["Ef"], g["Uf"] = _back(p["Uf"], X, kf, dh[:, :H])
        g["Eb"], g["Ub"] = _back(p["Ub"], X, kb, dh[:, H:])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * min(1.0, 4 * (1 - step / (steps + 1)))
        for k in p:
            v = g[k] / max(1.0, norm)
            m[k] = .9 * m[k] + .1 * v
            s[k] = .99 * s[k] + .01 * v * v
            p[k] -= (rate * (m[k] / (1 - .9 ** step)) / (np.sqrt(s[k] / (1 - .99 ** step)) + 1e-8)).astype(np.float32)
    return p | {"names": names, "window": window}


def _softmax(a: np.ndarray) -> np.ndarray:
    """Over the axis before the last."""
    a = a - a.max(axis=-2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=-2, keepdims=True)
    return a


def predict(model: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Pooled probabilities (documents x languages) of the texts buf[off[i]:off[i+1]]."""
    T, L, n = model["window"], len(model["names"]), len(off) - 1
    H = model["Uf"].shape[1]
    size = np.diff(off)
    wins = -(-size // T)
    doc = np.repeat(np.arange(n), wins)
    first = np.repeat(np.cumsum(wins) - wins, wins)
    start = off[:-1][doc] + (np.arange(len(doc)) - first) * T
    length = np.minimum(T, off[1:][doc] - start)
    total = np.zeros((n, L))
    order = np.argsort(-length, kind="stable")       # whole windows first: only the rest needs a mask
    for lo in range(0, len(order), LANES):
        k = order[lo:lo + LANES]
        t = np.arange(T)[:, None]
        X = buf[np.minimum(start[k][None] + t, len(buf) - 1)]
        M = (t < length[k][None]).astype(np.float32)
        M = None if M.all() else M
        hf = _run(model["Ef"], model["Uf"], X, M, False)
        hb = _run(model["Eb"], model["Ub"], X, M, True)
        q = np.matmul(model["W"][:, :H], hf)
        q += model["W"][:, H:] @ hb
        q += model["b"]
        np.exp(q, out=q)                             # |state| < 1 bounds the logits by the weights
        q /= q.sum(axis=1, keepdims=True)
        if M is not None:
            q *= M[:, None, :]
        pooled = q.sum(axis=0)
        for lab in range(L):
            total[:, lab] += np.bincount(doc[k], pooled[lab], n)
    return total / np.maximum(size, 1)[:, None]


def training_rows(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                  per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """At most ``per_lang`` labelled, not held-out texts per language (first by hash of id)."""
    lab = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()
                      & ~held_out(doc_id))
    w = Window.partitionBy("_l").orderBy("_h", "_i")
    pick = (lab.select(F.col(lang).alias("_l"), F.col(doc_id).alias("_i"), F.xxhash64(doc_id).alias("_h"))
               .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_lang))
    ids = [r["_i"] for r in pick.select("_i").distinct().collect()]
    n = F.length("t")
    spot = lambda i: F.pmod(F.xxhash64("i", i), n - PIECE + 1).cast("int") + 1
    pieces = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(PLACES)),
                                      lambda i: F.col("t").substr(spot(i), F.lit(PIECE))), "\n")
    rows = (lab.filter(F.col(doc_id).isin(ids)).groupBy(F.col(doc_id).alias("i"), F.col(lang).alias("l"))
               .agg(F.min(text).alias("t"))
               .select("l", F.when(n > PLACES * PIECE, pieces).otherwise(F.col("t")).alias("t"),
                       F.xxhash64("i").alias("h"), "i")
               .collect()) if ids else []
    rows.sort(key=lambda r: (r["l"], r["h"], r["i"]))
    return [r["t"] for r in rows], [r["l"] for r in rows]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        per_lang: int = PER_LANG, **kw) -> dict:
    """Train on a bounded sample of ``docs`` (see ``training_rows``)."""
    return train(*training_rows(docs, text, lang, doc_id, per_lang), **kw)


def identify(docs: DataFrame, model: dict, text: str = "text", pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """Add the predicted language and its pooled probability to every row."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<l string, p double>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for arr in batches:
            if m["names"] and len(arr):
                q = np.concatenate([predict(m, *utf8(x)) for x in byte_slices(arr, 4 << 20)])
                best = q.argmax(axis=1)
                names = pa.array(m["names"]).take(pa.array(best))
                probs = pa.array(np.clip(q[np.arange(len(best)), best], 0, 1))
            else:
                names, probs = pa.array([UND] * len(arr), pa.string()), pa.array(np.zeros(len(arr)))
            yield pa.StructArray.from_arrays([names, probs], ["l", "p"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = [c for c in docs.columns if c not in (pred, score)]
    out = docs.select(*own, label(F.col(text)).alias("__lang"), letters.alias("__letters"))
    return out.select(*own, F.when(F.col("__letters"), F.col("__lang.l")).otherwise(UND).alias(pred),
                      F.when(F.col("__letters"), F.col("__lang.p")).otherwise(0.0).alias(score))
