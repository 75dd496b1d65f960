import numpy as np
import pytest

from docket.operators import knn, vector_index


def brute(Q, qids, C, cids, k, metric="l2sq"):
    out = {}
    for qi, q in zip(qids, Q):
        if metric == "l2sq":
            d = ((C - q) ** 2).sum(1)
        elif metric == "ip":
            d = 1 - C @ q
        else:
            d = 1 - (C @ q) / (np.linalg.norm(C, axis=1) * np.linalg.norm(q))
        d = np.round(d, 6)
        order = sorted(range(len(cids)), key=lambda j: (d[j], cids[j]))[:k]
        out[qi] = [(cids[j], d[j]) for j in order]
    return out


def frames(spark, Q, C, cids):
    qdf = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(Q)], "qid bigint, vector array<float>")
    cdf = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in zip(cids, C)], "id string, vector array<float>")
    return qdf, cdf


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_knn_matches_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    Q = rng.normal(size=(7, 8)).astype(np.float32)
    C = rng.normal(size=(300, 8)).astype(np.float32)
    C[50] = C[10]          # exact copies: ties broken by id
    C[51] = C[10]
    cids = ["c%03d" % i for i in range(300)]
    qdf, cdf = frames(spark, Q, C, cids)
    got = knn.nearest_chunks(qdf, cdf.repartition(5), k=4, metric=metric).collect()
    want = brute(Q.astype(np.float64), range(7), C.astype(np.float64), cids, 4, metric)
    for qi in range(7):
        rows = sorted([r for r in got if r.qid == qi], key=lambda r: r.rk)
        assert [r.id for r in rows] == [c for c, _ in want[qi]]
        assert [r.rk for r in rows] == [1, 2, 3, 4]


def test_knn_blocks_path(spark):
    rng = np.random.default_rng(2)
    Q = rng.normal(size=(9, 4)).astype(np.float32)
    C = rng.normal(size=(60, 4)).astype(np.float32)
    cids = ["c%02d" % i for i in range(60)]
    qdf, cdf = frames(spark, Q, C, cids)
    one = sorted(tuple(r) for r in knn.nearest_chunks(qdf, cdf, k=3).collect())
    small = vector_index.build_index(cdf, leaf_rows=5)
    blk = sorted(tuple(r) for r in vector_index.search(small, qdf, k=3, block=2).collect())
    assert one == blk and len(one) == 27 and len(small.extent) > 8


def test_knn_hot_copy_group(spark):
    # a third of the chunks are copies of one vector: output stays k per question
    C = np.vstack([np.ones((100, 3)), np.arange(600).reshape(200, 3) / 100.0]).astype(np.float32)
    cids = ["h%04d" % i for i in range(300)]
    qdf, cdf = frames(spark, np.ones((2, 3), dtype=np.float32), C, cids)
    rows = knn.nearest_chunks(qdf, cdf.repartition(3), k=5).collect()
    assert len(rows) == 10
    assert sorted({r.id for r in rows}) == cids[:5]


def test_knn_dimension_mismatch(spark):
    qdf, _ = frames(spark, np.ones((1, 3), dtype=np.float32), np.ones((1, 3)), ["a"])
    _, cdf = frames(spark, np.ones((1, 4), dtype=np.float32), np.ones((2, 4)), ["a", "b"])
    with pytest.raises(Exception):
        knn.nearest_chunks(qdf, cdf, k=1).collect()


def test_knn_large_norms(spark):
    # close neighbours far from the origin: |q|^2 + |c|^2 - 2qc alone would lose their order
    rng = np.random.default_rng(3)
    C = 1e4 + rng.normal(size=(60, 4)) * 1e-2
    C = C.astype(np.float32)
    cids = ["c%02d" % i for i in range(60)]
    qdf, cdf = frames(spark, C[:6], C, cids)
    want = brute(C[:6].astype(np.float64), range(6), C.astype(np.float64), cids, 5)
    got = vector_index.search(vector_index.build_index(cdf, leaf_rows=9), qdf, k=5).collect()
    for qi in range(6):
        assert [r.id for r in sorted((r for r in got if r.qid == qi), key=lambda r: r.rk)] == [c for c, _ in want[qi]]


def test_knn_unusable_vectors(spark):
    nan = float("nan")
    cdf = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [nan, 1.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [None, 1.0])],
                                "id string, vector array<float>")
    qdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, None)], "qid bigint, vector array<float>")
    got = {m: sorted((r.qid, r.id) for r in knn.nearest_chunks(qdf, cdf, k=5, metric=m).collect()) for m in ("l2sq", "cosine", "ip")}
    assert got == {"l2sq": [(1, "a"), (1, "d")], "cosine": [(1, "a")], "ip": [(1, "a"), (1, "d")]}
    assert knn.nearest_chunks(qdf.limit(0), cdf, k=2).count() == knn.nearest_chunks(qdf, cdf.limit(0), k=2).count() == 0


def test_knn_many_splits_coalesced(spark):
    rng = np.random.default_rng(4)
    Q = rng.normal(size=(3, 4)).astype(np.float32)
    C = rng.normal(size=(200, 4)).astype(np.float32)
    cids = ["c%03d" % i for i in range(200)]
    qdf, cdf = frames(spark, Q, C, cids)
    want = brute(Q.astype(np.float64), range(3), C.astype(np.float64), cids, 3)
    got = knn.nearest_chunks(qdf, cdf.repartition(100), k=3).collect()   # 100 splits > 3 x cores
    for qi in range(3):
        assert [r.id for r in sorted((r for r in got if r.qid == qi), key=lambda r: r.rk)] == [c for c, _ in want[qi]]


def test_blocks_go_only_to_tiles_they_can_reach():
    """On vectors in clusters most question x chunk pairs are never compared."""
    from tools.knn_share import share
    rng = np.random.default_rng(1)
    C = rng.normal(size=(50, 32))
    X = C[rng.integers(0, 50, 10_000)] + rng.normal(size=(10_000, 32)) * 0.05
    assert share(X, X[::40]) < 0.2


def test_an_index_is_opened_extended_and_searched(spark, tmp):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(700, 6)).astype(np.float32)
    ids = ["c%03d" % i for i in range(700)]
    qdf, cdf = frames(spark, X[:9], X, ids)
    path = f"{tmp}/index"
    for metric in ("l2sq", "cosine"):
        vector_index.build_index(cdf.filter("id < 'c500'"), path, metric, leaf_rows=40)
        assert vector_index.index_exists(spark, path)
        index = vector_index.open_index(spark, path)
        for batch in ("b", "b"):                        # sent twice: it replaces itself
            index = vector_index.extend(index, cdf.filter("id >= 'c500'"), batch)
        assert index.rows == 700
        got = sorted(tuple(r) for r in vector_index.search(index, qdf, 4).collect())
        assert got == sorted(tuple(r) for r in knn.nearest_chunks(qdf, cdf, 4, metric).collect()) and len(got) == 36
    with pytest.raises(ValueError):
        knn.nearest_chunks(qdf, cdf, 4, "l2sq", index=index)
    with pytest.raises(ValueError):
        vector_index.extend(index, spark.createDataFrame([("z", [1.0])], "id string, vector array<float>"), "z")


def test_repeated_rows_and_questions(spark):
    cdf = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.9, 0.0]), (None, [1.0, 0.0]), ("c", [0.0, 1.0])],
                                "id string, vector array<float>")
    qdf = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "qid bigint, vector array<float>")
    got = sorted((r.qid, r.rk, r.id) for r in knn.nearest_chunks(qdf, cdf, k=2).collect())
    assert got == [(1, 1, "a"), (1, 1, "c"), (1, 2, "b"), (1, 2, "b")]


def test_knn_parts_and_slabs(spark, monkeypatch):
    # several groups and slabs give the same hits, and questions are not shuffled with every tile they visit
    rng = np.random.default_rng(5)
    Q, C = rng.normal(size=(41, 8)).astype(np.float32), rng.normal(size=(300, 8)).astype(np.float32)
    cids = ["c%03d" % i for i in range(300)]
    qdf, cdf = frames(spark, np.vstack([Q, Q[:2]]), C, cids)
    index = vector_index.build_index(cdf, leaf_rows=5)
    monkeypatch.setattr(vector_index, "GROUP", 4)
    monkeypatch.setattr(vector_index, "SLAB", 300 * 8 * 8 // 3)
    monkeypatch.setattr(vector_index, "TILE", 16)
    df = vector_index.search(index, qdf, k=4, block=2)
    want = brute(np.vstack([Q, Q[:2]]).astype(np.float64), range(43), C.astype(np.float64), cids, 4)
    got = df.collect()
    for qi in range(43):
        assert [r.id for r in sorted((r for r in got if r.qid == qi), key=lambda r: r.rk)] == [c for c, _ in want[qi]]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan or "RepartitionById" in plan or "DirectShuffle" in plan, plan
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert not any("block" in x for x in joins), joins


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (0.0, 1e-4), (300.0, 1.0), (0.0, 1e20), (0.0, 1e-25)])
def test_hits_sifted_in_single_precision_are_exact(metric, shift, scale):
    rng = np.random.default_rng(11)
    C = (rng.integers(-3, 4, size=(700, 16)) + shift + 0.5) * scale          # small integers: many ties
    Q = np.vstack([C[:40] * 1.0, (rng.normal(size=(24, 16)) + shift) * scale])
    C[600:] = C[:100] * (1 + 1e-9)
    rank = rng.permutation(len(C))
    with np.errstate(over="ignore", invalid="ignore"):
        qn, cn = (Q * Q).sum(1), (C * C).sum(1)
        r, c = (x.ravel() for x in np.indices((len(Q), len(C))))
        D = np.round(knn._exact(Q, C, qn, cn, r, c, metric), knn.ROUND).reshape(len(Q), len(C)) + 0.0
    want = [sorted(range(len(C)), key=lambda j: (D[i, j], rank[j]))[:5] for i in range(len(Q))]
    kth = np.array([D[i, w[-1]] for i, w in enumerate(want)])
    for limit in (np.full(len(Q), np.inf), kth):
        r, c, d = knn._hits(Q, C, rank, limit, 5, metric)
        assert [c[r == i].tolist() for i in range(len(Q))] == want
        assert (d == D[r, c]).all()


def test_hits_of_plain_vectors_need_no_product_in_double_precision(monkeypatch):
    # The double-precision sieve took some ten times as long a pair
    rng = np.random.default_rng(12)
    Q, C = rng.normal(size=(64, 32)), rng.normal(size=(2048, 32))
    want = np.sort(((Q[:, None] - C[None]) ** 2).sum(2), 1)[:, :3]

    def never(*_):
        raise AssertionError("the sieve in double precision")

    monkeypatch.setattr(knn, "_near_double", never)
    _, _, d = knn._hits(Q, C, np.arange(len(C)), np.full(len(Q), np.inf), 3, "l2sq")
    assert np.allclose(d.reshape(-1, 3), want, atol=1e-6)


def test_grid_sends_tiles_once_while_questions_fit_a_group():
    parts, slabs = vector_index._grid(17_000, 900_000, 64, 6)
    assert parts == 1 and slabs >= 12
    parts, slabs = vector_index._grid(900_000, 3_000, 64, 6)       # few chunks: the questions are cut instead
    assert slabs <= 2 and parts * slabs >= 12
    assert vector_index._grid(0, 1, 4, 6) == (1, 1)


def test_sample_of_many_rows_sorts_few(spark, monkeypatch):
    # the same rows as by sorting all, also where many rows share few ids
    df = spark.range(2000).selectExpr("id", "array(cast(id as double)) as v")
    few = spark.range(2000).selectExpr("id % 3 as id", "array(cast(id % 3 as double)) as v")
    whole = [r.v for r in df.selectExpr("v", "xxhash64(id) as h").orderBy("h").limit(50).collect()]
    seen = []
    real = type(df).orderBy
    monkeypatch.setattr(type(df), "orderBy", lambda self, *c: (seen.append(self.count()), real(self, *c))[1])
    assert vector_index._sample(df, 2000, 50).to_pylist() == whole
    assert seen and seen[0] < 300
    assert len(vector_index._sample(few, 2000, 50)) == 50
