"""Operators over whole tables against brute force: search, mixing, urls, near duplicates, preferences."""

import itertools
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docket.llm import mixing, preference, queries, text_neardup, topk, url_rules, vec_neardup
from docket.llm.common import Scratch, components
from tests.conftest import SF001
from tools.oracle_check import TABLES, digest


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{SF001}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    r = con.execute(queries.SQL[name])
    cols = [d[0] for d in r.description]
    assert digest(df.columns, rows) == digest(cols, r.fetchall())


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    par = {x: x for e in edges for x in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in edges:
        par[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


# -- top-k --------------------------------------------------------------------------------------

def _vec_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def _best(ids, X, k):
    out = set()
    for i, q in enumerate(ids):
        if q % 20 == 0:
            s = sorted((-int(X[i] @ X[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
            out |= {(q, r + 1, v, -m) for r, (m, v) in enumerate(s)}
    return out


@pytest.mark.parametrize("tile", [7, 64, 4096])
def test_top_k_by_brute_force(spark, tile):
    """Different norms, groups of equal vectors, tiles that cut through them."""
    rng = np.random.default_rng(tile)
    X = rng.normal(size=(150, 6)) * rng.choice([0.1, 1, 30], (150, 1))
    X[40:90] = X[3]
    df = _vec_table(spark, [(i, x.astype(np.float32).tolist()) for i, x in enumerate(X)])
    got = topk.top_k(topk.prepare(df), lambda i: i % 20 == 0, tile=tile, qblock=3, pivots=5)
    I = np.floor(X.astype(np.float32).astype(float) * 64).astype(np.int64)
    assert {tuple(r) for r in got.collect()} == _best(list(range(150)), I, 20)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, None), (40, [float("nan"), 1.0]), (60, [None, 1.0]), (80, []),
            (1, [2.0, 0.0]), (2, [-1.0, 0.0]), (None, [5.0, 5.0]), (100, [0.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    df = _vec_table(spark, rows).withColumn("score", F.lit("mine")).withColumn("rank", F.lit("mine"))
    got = {tuple(r) for r in topk.top_k(topk.prepare(df), lambda i: i % 20 == 0).collect()}
    assert got == {(0, 1, 1, 8192), (0, 2, 100, 0), (0, 3, 2, -4096),
                   (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0)}
    assert topk.top_k(topk.prepare(df.limit(0)), lambda i: i % 20 == 0).count() == 0


def test_top_k_by_length_and_with_several_vectors_of_an_id(spark):
    """A short vector in front silences nothing; each length is searched among itself."""
    rng = np.random.default_rng(1)
    X = {3: rng.integers(-9, 9, (45, 3)), 5: rng.integers(-9, 9, (45, 5))}
    rows = [(0, [1.0])] + [(i + 20 * (n == 5), (x / 64).tolist()) for n in X for i, x in enumerate(X[n])]
    got = sorted(tuple(r) for r in topk.top_k(topk.prepare(_vec_table(spark, rows)), lambda i: i % 20 == 0, tile=8).collect())
    want = []
    for q in (0, 20, 40, 60):
        pairs = [(-int(X[n][j] @ X[n][q - o]), j + o) for n in X for o in [20 * (n == 5)] if 0 <= q - o < 45
                 for j in range(45) if j + o != q]
        want += [(q, r + 1, v, -m) for r, (m, v) in enumerate(sorted(pairs)[:20])]
    assert got == sorted(want)


# -- near-duplicate vectors ---------------------------------------------------------------------

@pytest.mark.parametrize("slot", [4, 1024])
def test_vector_links_by_brute_force(spark, slot):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(160, 16)).astype(np.float32)
    X[60:100] = X[5] + rng.normal(size=(40, 16)).astype(np.float32) * 0.22
    X[100:110] = X[7]
    X[110:120] = X[8] * 3
    got = vec_neardup.near_duplicates(_vec_table(spark, [(i, x.tolist()) for i, x in enumerate(X)]), slot=slot)
    U = X.astype(float)
    U /= np.sqrt((U * U).sum(1))[:, None]
    A = U @ U.T >= 0.95
    np.fill_diagonal(A, False)
    comp = np.arange(160)
    for _ in range(160):
        comp = np.array([min([comp[i], *comp[A[i]]]) for i in range(160)])
    want = {(i, int(A[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(160)}
    assert {tuple(r) for r in got.collect()} == want
    assert 100 < A.sum()


@pytest.mark.parametrize("groups", [1, 2, 3, 6, 7])
def test_groups_of_vectors_meet_once(spark, groups):
    rows = spark.range(groups).select(F.col("id").alias("g"), F.lit(groups).cast("bigint").alias("groups"))
    met = [tuple(r) for r in vec_neardup.meetings(rows).select("a", "g").collect()]
    assert sorted(tuple(sorted(m)) for m in met) == list(itertools.combinations_with_replacement(range(groups), 2))
    assert max(Counter(g for _, g in met).values()) <= groups // 2 + 1          # how often a row is sent


def test_boxes_of_vectors_lose_no_link(spark):
    rng = np.random.default_rng(8)
    X = np.repeat(rng.normal(size=(30, 24)), 50, axis=0) + rng.normal(size=(1500, 24)) * 0.17
    X[1200:] = rng.normal(size=(300, 24))
    U = X / np.sqrt((X * X).sum(1))[:, None]
    A = (U[:, None] * U[None]).sum(2) >= 0.95
    got = vec_neardup.near_duplicates(_vec_table(spark, [(i, x.tolist()) for i, x in enumerate(X)]), slot=600).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((A.sum(1) - 1).tolist()))
    assert 5000 < A.sum() - 1500 < 60000
    # every pair that is near in a block is found, and boxes apart are left out
    p = vec_neardup._Plan(24, 4, 0.95, X)
    a, b = (vec_neardup._Group(pa.StructArray.from_arrays(
        [pa.array(ids), pa.array(np.ones(len(ids), np.int64)), pa.array(X[ids].tolist())], ["rep", "copies", "v"]), p)
        for ids in (np.arange(700), np.arange(700, 1500)))
    for x, y in ((a, b), (a, a)):
        near = {(int(x.rep[i]), int(y.rep[j])) for m, n in vec_neardup._near(x, y, p) for i, j in zip(m, n, strict=True)}
        links = {(i, j) for i in x.rep.tolist() for j in y.rep.tolist() if A[i, j] and i != j}
        assert links <= (near | {(j, i) for i, j in near} if x is y else near)
        assert len(near) < 0.2 * len(x.rep) * len(y.rep)


def test_vector_edges(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 1.0]), (6, [1.0, 1.0]),
            (7, [2.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0])]
    df = _vec_table(spark, rows).withColumn("rep", F.lit("mine")).withColumn("kept", F.lit(0))
    got = {tuple(r) for r in vec_neardup.near_duplicates(df).collect()}
    alone = {(i, 0, i, True) for i in (1, 2, 3, 4, 5)}
    assert got == alone | {(6, 2, 6, True), (7, 2, 6, False), (8, 2, 6, False)}
    assert vec_neardup.near_duplicates(df.limit(0)).count() == 0
    assert vec_neardup.near_duplicates(df.filter("vec_id < 3")).count() == 2


def test_vectors_of_several_lengths_and_several_of_an_id(spark):
    rows = [(0, [1.0]), *[(i, [1.0, 2.0, 3.0 + i / 1000]) for i in range(1, 41)], (50, [1.0, 1.0]), (50, [-1.0, 1.0]), (51, [-2.0, 2.0])]
    got = sorted(tuple(r) for r in vec_neardup.near_duplicates(_vec_table(spark, rows), slot=8).collect())
    assert got == sorted([(0, 0, 0, True), *[(i, 39, 1, i == 1) for i in range(1, 41)],
                          (50, 0, 50, True), (50, 1, 50, True), (51, 1, 50, False)])


# -- near-duplicate texts -----------------------------------------------------------------------

def _groups(texts, words=5):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


@pytest.mark.parametrize("slot", [3, 256])
def test_text_groups_by_brute_force(spark, slot):
    """Chains of edits around the threshold, one hot group dealt over slots."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(24):
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(9)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{rnd.randrange(400)}" for _ in range(60)) for _ in range(8)]
    texts += ["Is one. " * 300 + t for t in texts[-2:]] + ["short text", "short text", "short", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in text_neardup.near_duplicates(df, slot_texts=slot).collect()}
    assert [got[i] for i in range(len(texts))] == _groups(texts)


def test_copies_that_repeat_lines_differently(spark):
    """Set Jaccard 0.8 to 1, but far less by weights, as one side holds a line 300 times."""
    rnd = random.Random(11)
    texts = []
    for i in range(12):
        line = " ".join(f"l{i}x{j}" for j in range(20)) + " "
        body = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        other = list(body)
        if i % 2:
            other[rnd.randrange(100)] = "changed"
        texts += [line * 300 + " ".join(body), line * 2 + " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in text_neardup.near_duplicates(df).collect()}
    assert [got[i] for i in range(24)] == _groups(texts) == [i // 2 * 2 for i in range(24)]


def test_signatures_estimate_probability_jaccard():
    rnd = random.Random(1)
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(pool[:8], k=200)), " ".join(rnd.choices(pool[:8], k=200))]
    texts += ["a b c d e " * 30 + texts[0], "a b c d e " * 90 + texts[0]]
    owner, h, w = text_neardup.shingles(pa.array(texts))
    cut = np.searchsorted(owner, np.arange(5))
    sig = text_neardup.signatures(owner, h, w, 4, 4096)
    for i, j in itertools.combinations(range(4), 2):
        a, b = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
        exact = text_neardup.probability_jaccard(h[a], 1 + np.log(w[a]), h[b], 1 + np.log(w[b]))
        plain = 0.0
        x = dict(zip(h[a].tolist(), (1 + np.log(w[a])).tolist(), strict=True))
        y = dict(zip(h[b].tolist(), (1 + np.log(w[b])).tolist(), strict=True))
        for d in x.keys() & y.keys():
            plain += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
        assert exact == pytest.approx(plain)
        assert abs((sig[i] == sig[j]).mean() - exact) < 0.04


def test_text_edges_and_keep_one(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, "one two"), (5, "one two"), (6, long), (7, long + " tail"),
            (None, "one two"), (8, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k1", F.lit("mine")).withColumn("n", F.lit(0))
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in text_neardup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (8, 8, True)}
    kept = text_neardup.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 8, None])
    assert text_neardup.near_duplicates(df.limit(0)).count() == 0


def test_ids_with_several_texts_repeats_and_null_ids(spark):
    rnd = random.Random(12)
    own = [[f"w{rnd.randrange(10**6)}" for _ in range(100)] for _ in range(6)]
    texts = [" ".join(w) for w in own]
    near = [" ".join([*w[:-1], "changed"]) for w in own]
    # id 1 holds six texts; their near copies have other ids or none; one of these is id 1's too
    rows = [(1, t, 0) for t in texts] + [(1, near[0], 0)] + [(10 + i, t, 0) for i, t in enumerate(near[:4])]
    rows += [(None, near[4], 0), (None, near[5], 0), (None, "only here " * 9, 2), (None, "only here " * 9, 1), (None, None, 0), (None, None, 0)]
    rows += [(1, texts[2], 5), (1, texts[2], 5), (20, "said twice", 8), (20, "said twice", 7), (21, "said twice", 1), (22, "", 0), (22, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    got = text_neardup.near_duplicates(df, slot_texts=2, null_ids=True).collect()
    assert len(got) == 7 + 4 + 4 + 3
    assert all(r["component_id"] == 1 for r in got if r["doc_id"] and r["doc_id"] < 20)
    assert Counter(r["kept"] for r in got if r["doc_id"] == 1) == Counter({True: 6, False: 1})
    assert not any(r["kept"] for r in got if r["doc_id"] in (10, 11, 12, 13, 21))
    kept = [tuple(r) for r in text_neardup.keep_one(df, slot_texts=2, null_ids=True).collect()]
    first = [r for r in kept if r[0] == 1 and r[1] in (texts[0], near[0])]
    assert len(first) == 1
    assert Counter(kept) == Counter(first + [(1, t, 0) for t in texts[1:]] + [
        (None, "only here " * 9, 1), (None, None, 0), (None, None, 0), (20, "said twice", 7), (22, "", 0), (22, "", 0)])


# -- mixing -------------------------------------------------------------------------------------

@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "zz": 9}, {"a": 0.07, "b": 3, "c": 1.3, "d": 0.2}])
def test_mix_stays_within_a_block_of_the_targets(spark, weights):
    rows = [(i, "a" if i % 3 == 0 else "bcd"[i % 7 % 3]) for i in range(600)] + [(900, None), (901, None), (901, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("mix_slot", F.lit("mine"))
    got = mixing.mix(df, weights, block_rows=4, frame=50).collect()
    first = Counter((r["doc_id"], r["source"]) for r in got if r["mix_epoch"] == 0)
    assert first == Counter(rows)                                  # whole: every row once in the first pass
    pos = [r["mix_pos"] for r in got]
    assert sorted(pos) == list(range(len(pos)))
    counts = Counter(s for _, s in rows)
    given = {s: n ** .75 for s, n in counts.items()} if weights is None else {s: weights.get(s, 0) for s in counts}
    given = {s: w or sum(given.values()) * mixing.LEAST for s, w in given.items()}
    seen = Counter()
    by_slot = {r["mix_slot"]: r["source"] for r in got}
    for t in range(max(by_slot) + 1):
        seen[by_slot[t]] += 1
        for s in counts:
            assert abs(seen[s] - given[s] / sum(given.values()) * (t + 1)) < 1
    for s in counts:                                               # epochs of a source differ by one at most
        each = Counter(r["doc_id"] for r in got if r["source"] == s)
        times = [n / Counter(rows)[(i, s)] for i, n in each.items()]
        assert max(times) - min(times) <= 1


@pytest.mark.parametrize("shares", [[0.9995, 0.0005], [10 + i % 97 for i in range(150)], [0.6, 0.25, 0.1, 0.03, 0.015, 0.004, 0.001]])
def test_true_weights_over_many_frames(spark, shares):
    """Half a per mille, or many sources: no rounding of weights, and no drift."""
    n = 16 if len(shares) > 100 else 64
    counts = spark.createDataFrame([(f"={i:04d}", n if i + 1 == len(shares) else 16) for i in range(len(shares))], "src string, n bigint")
    scratch = Scratch(spark, "test")
    sources = scratch.table(mixing.targets(counts, {f"={i:04d}": float(x) for i, x in enumerate(shares)}))
    plan = [(r["slot"], r["i"], r["nth"]) for r in mixing.schedule(sources, scratch, 16, frame=100 if len(shares) > 100 else 1000).collect()]
    w = np.array(shares, float) / sum(shares)
    assert len(plan) >= (700 if len(shares) > 100 else 4000)
    had = np.zeros(len(shares))
    for t, (slot, i, nth) in enumerate(sorted(plan)):
        assert slot == t and nth == had[i]
        had[i] += 1
        assert np.abs(had - w * (t + 1)).max() < 1 + 1e-9


def test_mix_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string")
    assert mixing.mix(df).count() == 0
    one = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a")], "doc_id bigint, source string")
    assert mixing.mix(one, block_rows=3).count() == 3
    plan = mixing.mix(one)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- urls ---------------------------------------------------------------------------------------

def test_url_rules_and_edges(spark):
    cases = [("http://A.Com/x", "a.com", "/x", "com/", "allow"), ("https://example.com/en/1?q#z", "example.com", "/en/1", "example.com/en/", "block"),
             ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
             ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
             ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://x.net/es/a://b", "x.net", "/es/a://b", "net/es/", "block"),
             ("http://x.net/es", "x.net", "/es", None, "allow"), ("http://x.com", "x.com", "", None, "allow"),
             ("http://x.com?/a", "x.com", "", None, "allow"), ("x.com/a", "", "", None, "allow"), (None, "", "", None, "allow"),
             ("", "", "", None, "allow"), ("://x.org/" + "a/" * 50_000, "x.org", "/" + "a/" * 50_000, None, "allow")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases + cases)], "page_id int, url string") \
              .withColumn("host", F.lit("mine")).withColumn("rule", F.lit(1))
    mined = url_rules.mine(spark.createDataFrame([], "url string, blocked boolean"))
    rows = url_rules.judge(df, mined).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        c = cases[r["page_id"] % len(cases)]
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == c
    assert url_rules.judge(df.limit(0), mined).count() == 0


def test_mined_rules_by_brute_force(spark):
    rnd = random.Random(6)
    urls = [f"http://{rnd.choice('abc')}.site.{rnd.choice(['org', 'net'])}/{rnd.choice(['x', 'y', 'z'])}/{rnd.randrange(4)}" for _ in range(300)]
    rows = [(u, (".net/x" in u and rnd.random() < .9) or rnd.random() < .1) for u in urls] + [(None, None)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    got = {(frozenset(r["tokens"]), round(r["confidence"], 9)) for r in url_rules.mine(df, min_support=.02).collect()}
    sets = []
    for u, b in rows[:-1]:
        host, _, path = u.split("://")[1].partition("/")
        sets.append(({f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/")}, b))
    n, blocked = len(sets), sum(b for _, b in sets)
    count, hit = defaultdict(int), defaultdict(int)
    for s, b in sets:
        for k in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), k):
                count[c] += 1
                hit[c] += bool(b)
    want = {(frozenset(c), round(hit[c] / count[c], 9)) for c in count
            if hit[c] >= .02 * n and hit[c] / count[c] >= .5 and hit[c] / count[c] / (blocked / n) >= 1.2}
    assert got == want and want
    verdict = {r["url"]: r["confidence"] for r in url_rules.judge(df, url_rules.mine(df, min_support=.02), rules=()).collect()}
    for (u, _), (s, _) in zip(rows, sets, strict=False):
        best = max([c for t, c in want if t <= s], default=None)
        assert verdict[u] == (pytest.approx(best) if best else None)


def test_deep_url_tokens_are_mined_and_judged(spark):
    """The mark is the first of six host labels, the eighth path segment or a parameter."""
    forms = ["http://{}.b.c.d.site.org/1/{}", "http://www.site.org/1/2/3/4/5/6/7/{}/{}", "http://www.site.org/1?{}=1&page={}#x"]
    rows = [(f.format(m, i), m == "bad") for f in forms for m in ("bad", "good") for i in range(20)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    mined = url_rules.mine(df, min_support=.05)
    assert {("h:bad",), ("p:bad",), ("q:bad=1",)} <= {tuple(r["tokens"]) for r in mined.collect()}
    verdict = {r["url"]: r["verdict"] for r in url_rules.judge(df, mined, rules=()).collect()}
    assert all(verdict[u] == ("block" if b else "allow") for u, b in rows)


# -- preferences --------------------------------------------------------------------------------

def test_preferences(spark):
    kind = "pair_id bigint, turn int, role string, text string"
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 2, "user", "more"), (2, 0, "user", "q"),
         (3, 0, None, None), (3, 1, "assistant", ""), (4, 0, "user", "only chosen"), (None, 0, "user", "x"), (5, None, "user", "x")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "q"), (3, 0, None, None), (3, 1, "assistant", None)]
    rows = preference.format_preferences(spark.createDataFrame(a, kind).withColumn("part", F.lit("mine")), spark.createDataFrame(b, kind))
    got = {r["pair_id"]: r for r in preference.assemble(rows).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n"
    assert one["rejected"] == "<|assistant|>\nno<|end|>\n"
    s = one["chosen_spans"][0]
    assert len(one["chosen_spans"]) == 1 and one["chosen"][s["from"]:s["to"]] == "yes<|end|>\n"
    assert (got[2]["prompt"], got[2]["chosen"], got[2]["rejected"]) == ("<|user|>\nq<|end|>\n", "", "")
    assert got[3]["prompt"] == "<||>\n<|end|>\n" and got[3]["chosen"] == got[3]["rejected"] == "<|assistant|>\n<|end|>\n"
    assert got[4]["prompt"] == "" and got[4]["rejected"] == ""
    none = spark.createDataFrame([], kind)
    assert preference.format_preferences(none, none).count() == 0
