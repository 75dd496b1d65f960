"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are normalised and rotated (a fixed random rotation); cosine >= t is squared
distance <= D = 2 (1 - t).  The rotated coordinates are split into blocks, and D into one
budget per block in proportion to the block's share of the variance (on a bounded sample;
any shares are right).  If two vectors lie within D, at least one block of them lies
within its budget, so the pairs of rows that are this near in some block hold every link;
they are verified exactly, in double precision.

Rows of one vector are classed first.  A tree of median cuts, fitted on the sample, puts near classes into
groups of bounded size; every two groups meet once, and a group is sent whole, to half of the others: there
are ``GROUPS`` of them while they fit ``HELD``, so what is shuffled grows with the input.  A task cuts its two
groups into boxes of at most ``BOX`` rows.  Two boxes are compared only in the blocks in which their distance
is within the budget, by one product of matrices a block in single precision, with room for its rounding.
The tasks emit link counts per class and a spanning forest, never pairs.  Where boxes exclude nothing
(vectors close to uniform) the products stay quadratic; their memory is bounded.

Vectors of each length are joined among themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and form components of their own, as do vectors of different lengths with each
other; exact copies link with each other; rows that repeat an id and vector count once, and an
id with several vectors has a row for each; null ids take no part; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import Forest, Scratch, components, vectors, whole

THRESHOLD = 0.95
BLOCKS = 4
SAMPLE = 2048
SLOT, GROUPS, HELD = 1024, 24, 1 << 24      # least rows of a group; groups of one length, while one holds at most 16 MB of vectors
BOX, SPAN = 256, 16                         # rows of a box; boxes that one box meets at once
DEPTH = 8                                   # cuts above a leaf of the tree
SLACK = 1e-6
SINGLE = 1e-5                               # rounding of a block's squared distance in single precision (at most 4)


def _rotation(dim: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _widest(T: np.ndarray) -> int:
    return int(T.var(0).argmax())


class _Plan:
    """Rotation, blocks, budgets and the tree of cuts for vectors of one length."""

    def __init__(self, dim: int, blocks: int, threshold: float, sample: np.ndarray | None):
        blocks = min(blocks, dim)
        self.dim, self.R = dim, _rotation(dim)
        edges = np.linspace(0, dim, blocks + 1).astype(int)
        self.part = [slice(edges[i], edges[i + 1]) for i in range(blocks)]
        T = np.zeros((0, dim)) if sample is None else self.turn(sample)
        spread = T.var(0) if len(T) else np.ones(dim)
        share = np.array([spread[p].sum() + 1e-3 / blocks for p in self.part])
        self.budget = 2 * (1 - threshold) * (1 + SLACK) * share / share.sum()
        self.axis, self.at = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, np.inf)
        rows = {0: T}
        for i in range(len(self.at)):
            own = rows.pop(i)
            if len(own) > 1:
                self.axis[i] = _widest(own)
                self.at[i] = np.median(own[:, self.axis[i]])
            left = own[:, self.axis[i]] <= self.at[i]
            rows[2 * i + 1], rows[2 * i + 2] = own[left], own[~left]

    def turn(self, V: np.ndarray) -> np.ndarray:
        return _unit(V) @ self.R.T

    def leaf(self, T: np.ndarray) -> np.ndarray:
        node = np.zeros(len(T), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (T[np.arange(len(T)), self.axis[node]] > self.at[node])
        return node - len(self.at)


def _boxes(T: np.ndarray) -> list[np.ndarray]:
    """Rows of near vectors, at most ``BOX`` each: halved again and again at the median of the widest axis."""
    done, todo = [], [np.arange(len(T))]
    while todo:
        at = todo.pop()
        if len(at) <= BOX:
            done.append(at)
        else:
            half = len(at) // 2
            at = at[np.argpartition(T[at, _widest(T[at])], half)]
            todo += [at[half:], at[:half]]
    return done


class _Group:
    """The rows of a group in boxes: ids, copies, vectors, and per block the factors of squared distances."""

    def __init__(self, rows: pa.StructArray, p: _Plan):
        rep, copies, v = rows.flatten()
        V = vectors(v, p.dim)
        T = p.turn(V)
        boxes = _boxes(T)
        at = np.concatenate(boxes)
        self.rep, self.copies, self.V, T = rep.to_numpy()[at], copies.to_numpy()[at], V[at], T[at]
        self.edges = np.concatenate([[0], np.cumsum([len(x) for x in boxes])])
        self.low, self.high = (f.reduceat(T, self.edges[:-1], axis=0) for f in (np.minimum, np.maximum))
        sq, one = [np.square(T[:, q]).sum(1) for q in p.part], np.ones(len(T))
        self.left = [np.column_stack([-2 * T[:, q], s, one]).astype(np.float32) for q, s in zip(p.part, sq, strict=True)]
        self.right = [np.column_stack([T[:, q], one, s]).astype(np.float32) for q, s in zip(p.part, sq, strict=True)]


def _near(a: _Group, b: _Group, p: _Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` that are within the budget in some block (within one group each pair once)."""
    gap = np.empty((len(a.low), len(b.low), len(p.part)))
    for i in range(len(a.low)):
        d = np.square(np.maximum(np.maximum(a.low[i] - b.high, b.low - a.high[i]), 0))
        gap[i] = np.column_stack([d[:, q].sum(1) for q in p.part])
    reach = (gap <= p.budget * (1 + SLACK) + 1e-12) & (gap.sum(2) <= p.budget.sum() * (1 + SLACK) + 1e-12)[:, :, None]
    room = np.empty(BOX * SPAN * BOX, np.float32)
    flags = np.empty((2, len(room)), bool)
    for i, lo in ((i, lo) for i in range(len(a.low)) for lo in range(i if a is b else 0, len(b.low), SPAN)):
        see = reach[i, lo:lo + SPAN]
        if not see.any():
            continue
        r0, r1, c0, c1 = a.edges[i], a.edges[i + 1], b.edges[lo], b.edges[min(lo + SPAN, len(b.low))]
        n = (r1 - r0) * (c1 - c0)
        near = flags[0, :n].reshape(r1 - r0, c1 - c0)
        near[:] = False
        for q in np.flatnonzero(see.any(0)).tolist():
            boxes = np.flatnonzero(see[:, q])
            f0, f1 = b.edges[lo + boxes[0]], b.edges[lo + boxes[-1] + 1]
            n = (r1 - r0) * (f1 - f0)
            sq, own = room[:n].reshape(r1 - r0, f1 - f0), flags[1, :n].reshape(r1 - r0, f1 - f0)
            np.matmul(a.left[q][r0:r1], b.right[q][f0:f1].T, out=sq)
            np.less_equal(sq, np.float32(p.budget[q] * (1 + SLACK) + SINGLE), out=own)
            near[:, f0 - c0:f1 - c0] |= own
        x, y = np.nonzero(near)
        x, y = x + r0, y + c0
        if a is b:
            x, y = x[x < y], y[x < y]
        if len(x):
            yield x, y


def _meet(a: _Group, b: _Group, p: _Plan, threshold: float) -> pa.RecordBatch:
    """Links of two groups: counts per class (``a = b``) and a spanning forest (``a <> b``)."""
    off = 0 if a is b else len(a.rep)
    rep = a.rep if a is b else np.concatenate([a.rep, b.rep])
    links = np.zeros(len(rep), np.int64)
    forest = Forest(len(rep))
    tree: list = []
    for m, n in _near(a, b, p):
        for at in range(0, len(m), 65536):
            x, y = m[at:at + 65536], n[at:at + 65536]
            X, Y = a.V[x], b.V[y]
            cos = (X * Y).sum(1) / (np.sqrt((X * X).sum(1)) * np.sqrt((Y * Y).sum(1)))
            x, y = x[cos >= threshold], y[cos >= threshold]
            np.add.at(links, x, b.copies[y])
            np.add.at(links, y + off, a.copies[x])
            tree += [(rep[s], rep[t]) for s, t in zip(x.tolist(), (y + off).tolist(), strict=True) if forest.join(s, t)]
    got = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([rep[got], np.array([t[i] for t in tree], np.int64)])) for i in (0, 1)]
        + [pa.array(np.concatenate([links[got], np.zeros(len(tree), np.int64)]))], ["a", "b", "n"])


def meetings(groups: DataFrame) -> DataFrame:
    """Rows of a group ``g`` of ``groups`` ones, for every group ``a`` that it is sent to (itself included, ``d = 0``):
    the ``groups / 2`` before it in a circle, so every two groups meet once."""
    return (groups.withColumn("d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("groups") / 2))))
                  .withColumn("a", F.pmod(F.col("g") - F.col("d"), F.col("groups")))
                  .filter((F.col("d") * 2 != F.col("groups")) | (F.col("a") < F.col("g"))))


def near_duplicates(df: DataFrame, ids: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD,
                    blocks: int = BLOCKS, slot: int = SLOT) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per id and vector."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vecdup")
    base = df.select(F.col(ids).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")) \
             .filter(F.col("id").isNotNull())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    flagged = base.distinct().withColumn("ok", F.coalesce(whole("v") & (norm > 0) & (norm < float("inf")), F.lit(False)))
    members = flagged.filter("ok").select("id", "v")
    alone = flagged.filter("not ok").select("id")
    # classes of equal vectors, numbered
    classes = scratch.table(members.groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
                                   .withColumn("rep", F.monotonically_increasing_id()))

    # per length: rotation, blocks, and from a bounded sample their shares of the variance and the tree
    sample: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("low"), "low").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    held = {dim: _Plan(dim, blocks, threshold, np.array(rows)) for dim, rows in sample.items()}

    def plan(dim: int) -> _Plan:
        if dim not in held:
            held[dim] = _Plan(dim, blocks, threshold, None)
        return held[dim]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            size = pc.list_value_length(whole_batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                b = whole_batch.filter(pa.array(size == dim))
                leaf = plan(dim).leaf(plan(dim).turn(vectors(b.column("v"), dim)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), dim, np.int64)), pa.array(leaf), *b.columns],
                                                 ["dim", "leaf", *b.schema.names])

    placed = scratch.table(classes.select("rep", "copies", "v").mapInArrow(
        place, "dim bigint, leaf bigint, rep bigint, copies bigint, v array<double>"))
    # leaves side by side, cut into groups: a class takes a place in its leaf's span by a hash
    same = Window.partitionBy("dim")
    size = F.greatest(F.lit(slot).cast("bigint"), F.least(F.floor(HELD / (8 * F.col("dim"))), F.ceil(F.col("total") / GROUPS)))
    spans = (placed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("start", F.sum("n").over(same.orderBy("leaf")) - F.col("n"))
                   .withColumn("total", F.sum("n").over(same)).withColumn("size", size)
                   .withColumn("groups", F.ceil(F.col("total") / F.col("size"))))
    group = F.floor((F.col("start") + F.pmod(F.xxhash64("rep"), F.col("n"))) / F.col("size"))
    groups = scratch.table(placed.join(spans, ["dim", "leaf"]).withColumn("g", group).groupBy("dim", "groups", "g")
                                 .agg(F.collect_list(F.struct("rep", "copies", "v")).alias("rows")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for b in batches:
            for i, h in enumerate(b.select(["dim", "a", "d"]).to_pylist()):
                other = _Group(b.column("rows")[i].values, plan(h["dim"]))
                if h["d"] == 0:
                    key, own = (h["dim"], h["a"]), other
                if key == (h["dim"], h["a"]):           # a group that no class fell into meets nothing
                    yield _meet(own, other, plan(h["dim"]), threshold)

    sent = meetings(groups).repartitionById(GROUPS, F.pmod(F.col("dim") + F.col("a"), F.lit(GROUPS)).cast("int"))
    found = scratch.table(sent.select("dim", "a", "d", "rows").sortWithinPartitions("dim", "a", "d")
                              .mapInArrow(compare, "a bigint, b bigint, n bigint"))
    links = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("a <> b"), scratch)
    # back to all members of a class; a component is named by its smallest id
    named = (classes.join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
                    .select("v", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                            F.coalesce("component", "rep").alias("c")))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    out = members.join(named.join(lowest, "c").select("v", "n_links", "component_id"), "v")
    single = alone.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
                          F.col("id").alias("component_id"))
    return (out.select(F.col("id").alias("vec_id"), "n_links", "component_id").unionByName(single)
               .withColumn("kept", F.col("vec_id") == F.col("component_id")))
