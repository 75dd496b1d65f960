"""Runs of repeated words and hard negatives against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm import hard_negatives, periodic, queries
from tests.conftest import SF001


def brute_runs(w):
    """(start, length, period) by trying every period; a stretch found before has a smaller one."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_runs_by_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        docs = []
        for _ in range(rnd.randrange(1, 6)):
            p = [rnd.randrange(3) for _ in range(rnd.randrange(1, 9))]
            edge = [rnd.randrange(3) for _ in range(rnd.randrange(9))]
            docs.append(rnd.choice([
                [rnd.randrange(2) for _ in range(rnd.randrange(60))],
                edge + (p * 9)[:rnd.randrange(1, 9 * len(p) + 1)] + edge,
                [0] * rnd.randrange(30) + [1] * rnd.randrange(3) + [0] * rnd.randrange(30),
                (([0] * rnd.randrange(1, 7) + [1]) * rnd.randrange(3, 9) + [rnd.randrange(2)]) * rnd.randrange(1, 6)]))
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = periodic.runs(np.array([x for d in docs for x in d], np.int64), off)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d)]


def test_runs_of_one_long_text_are_near_linear():
    got = periodic.runs(np.tile(np.arange(5000), 40), np.array([0, 200_000]))
    assert got.tolist() == [[0, 0, 200_000, 5000]]
    assert periodic.runs(np.zeros(200_000, np.int64), np.array([0, 200_000])).tolist() == [[0, 0, 200_000, 1]]
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), np.array([0, 9]), min_periods=3)


def test_runs_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.op11_runs(spark, SF001).collect()}
    short = [(i, t) for i, t in docs if len((t or "").split()) < 3000]
    want = {brute_row(i, t) for i, t in short}
    assert len(got) == len(docs) and len(short) > 150 and sum(r[1] > 0 for r in want) > 5
    assert {r for r in got if r[0] in {i for i, _ in short}} == want


def test_runs_edges(spark, tmp):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 50), (4, "a " * 50), (None, "x y " * 20), (5, "é é  " * 30 + "z"),
            (6, ("go on and on \t\r" * 30_000))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("mine")).withColumn("r", F.lit(1))
    out = periodic.find_runs(df).collect()
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out), key=str)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 50, 1)], "a"), (4, [(0, 50, 1)], "a"),
                          (0, [(0, 40, 2)], "x y"), (5, [(0, 30, 1)], "é é  z"), (6, [(0, 120_000, 4)], "go on and on")], key=str)
    assert periodic.find_runs(df.limit(0)).count() == 0
    df.select("doc_id", "text").write.parquet(f"{tmp}/documents.parquet")
    got = {(r["doc_id"], r["n_runs"], r["length"]) for r in queries.op11_runs(spark, tmp).collect()}
    assert {(1, 0, None), (2, 0, None), (3, 0, None), (None, 1, 40)} <= got


# -- hard negatives -----------------------------------------------------------------------------

def brute_negatives(rows, anchors, k=5, m=5, pct=80):
    """rows: (id, label, vector of ints)."""
    out = []
    for i, lab, v in rows:
        if i not in anchors:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), j, c) for j, c, x in rows if j != i and len(x) == len(v))
        for p, j, _ in [r for r in s if r[2] == lab][:k]:
            hits = [(q, n) for q, n, c in s if c != lab and -q <= -p and pct * -p <= 100 * -q][:m]
            out += [(i, j, r + 1, n, -p, -q) for r, (q, n) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("tile,block", [(7, 3), (4096, 512)])
def test_negatives_by_brute_force(spark, tile, block):
    rng = np.random.default_rng(tile)
    X = rng.integers(-6, 9, (260, 5))
    X[50:90] = X[10]                        # copies: equal scores
    lab = rng.integers(0, 3, 260)
    lab[::3] = 1                            # a label that holds more than a third
    rows = [(i, int(c), x) for i, (c, x) in enumerate(zip(lab, X.tolist(), strict=True))]
    rows += [(300 + i, i % 2, [i, 3]) for i in range(40)]       # vectors of another length
    df = spark.createDataFrame(rows, "vec_id long, label int, ints array<bigint>").repartition(3)
    got = hard_negatives.mine(df, lambda i: i % 10 == 0, tile=tile, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, range(0, 400, 10))


def test_negatives_edges(spark):
    rows = [(0, "a", [1.0, 0.0]), (None, "a", [1.0, 0.0]), (1, None, [1.0, 0.0]), (2, "a", None), (3, "a", [float("nan"), 1.0]),
            (4, "a", []), (5, "a", [None, 1.0]), (6, "a", [1.0, 0.0]), (6, "a", [1.0, 0.0]), (7, "b", [0.9, 5.0]),
            (0, "b", [1.0, 0.0]), (8, "b", [2.0, 0.0]), (9, "c", [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<float>") \
              .withColumn("rank", F.lit("mine")).withColumn("keys", F.lit(0)).withColumn("score", F.lit(0))
    got = sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.prepare(df), lambda i: i == 0).collect())
    # anchor (0, a): both rows 6 score 256 * 256, row 7 256 * 230; anchor (0, b): 8 scores 2^17, the rows 6 lie
    # below its floor, and within that of 7 nothing scores 47104 to 58880
    assert got == [(0, 6, 1, 7, 65536, 58880)] * 2
    assert hard_negatives.mine(hard_negatives.prepare(df.limit(0)), lambda i: i == 0).count() == 0
    assert hard_negatives.mine(hard_negatives.prepare(df), lambda i: i == 4).count() == 0


def test_large_scores_stay_exact():
    rng = np.random.default_rng(0)
    S = rng.integers(-2**60, 2**60, (4, 50))
    S[:, ::2] = S[:, :1]
    ids = rng.permutation(50)
    got, val = hard_negatives._top(S, S > -2**59, ids, 6)
    for i in range(4):
        want = sorted((-int(s), int(j)) for s, j in zip(S[i], ids, strict=True) if s > -2**59)[:6]
        assert sorted((-int(v), int(j)) for v, j in zip(val[i], got[i], strict=True)) == want
