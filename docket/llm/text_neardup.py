"""Near-duplicate texts by ProbMinHash over weighted word shingles.

A text's shingles are its runs of five words (the whole text, if shorter), weighted by
1 + ln(how often they occur): with plain counts one line repeated hundreds of times would
make otherwise different texts alike.  Every shingle starts a Poisson process whose rate is its weight and whose points fall on random registers of
the signature; a register keeps the shingle of its earliest point, and a process ends once
its next point is later than all registers.  Two signatures agree in a register with
probability equal to the probability Jaccard index of the weighted shingles.

Registers are banded; texts that share a band are candidates, and link if the exact Jaccard
index of their distinct shingles is at least the threshold.  Repeats can put the weighted index
far below that one, so a text has a second family of bands, whose shingles weigh the same and
whose registers agree with probability equal to the index that links: it is this family that
finds the links, whatever repeats.  A text that repeats no shingle has the same bands in both
families and holds them once.  Equal texts are one class from the start.  Candidates are gathered through
connected components of the bands (ids only); a large component is dealt into slots
of bounded words whose pairs meet in tasks, and a task skips pairs it has already
connected, so that a group of copies costs no list of its pairs.

Defined results: a text without words (null, empty, blank) is near nothing; texts of any
length are taken whole; rows that repeat an id and text count once; an id with several texts
has a row per text, and each of these is compared; null ids take no part, or with ``null_ids``
join by their text and come after all ids; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import Forest, Scratch, byte_slices, components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6             # a pair at 0.8 shares an equal-weight band with probability 1 - (1 - 0.8^6)^24 = 0.9993
SLOT_TEXTS, SLOT_WORDS = 256, 400_000

# Multipliers of a common 64-bit mixing function.
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of all distinct shingles, by text and hash."""
    import xxhash
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.utf8_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    flat = split.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)
    doc, flat = doc[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    word = each[flat.indices.to_numpy()] if len(doc) else np.zeros(0, np.uint64)
    n = np.bincount(doc, minlength=len(texts))
    # a slot per word, at least ``words`` for a text that has any
    room = np.where(n > 0, np.maximum(n, words), 0)
    start, first = np.cumsum(room) - room, np.cumsum(n) - n
    line = np.zeros(int(room.sum()) + words, np.uint64)
    line[start[doc] + np.arange(len(doc)) - first[doc]] = word
    count = np.where(n > 0, room - words + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = start[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    h = np.zeros(len(at), np.uint64)
    for i in range(words):
        h = _mix(h * np.uint64(31) + line[at + i] + np.uint64(i))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """ProbMinHash signatures (texts x size) from weighted shingles."""
    time = np.full(texts * size, np.inf)
    sig = np.zeros(texts * size, np.uint64)
    limit = np.full(texts, np.inf)
    t = np.zeros(len(h))
    rate = 1 + np.log(weight)
    rnd = 0
    while len(h):
        x = _mix(h + np.uint64(int(_GOLD) * (2 * rnd + 1) % (1 << 64)))
        t = t - np.log1p(-((x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)) / rate
        live = t < limit[owner]                   # later points of the others come later still
        owner, h, t, rate, x = owner[live], h[live], t[live], rate[live], x[live]
        reg = owner * size + (_mix(x + _GOLD) % np.uint64(size)).astype(np.int64)
        np.minimum.at(time, reg, t)
        won = t == time[reg]
        sig[reg[won]] = h[won]
        seen = np.unique(owner)
        limit[seen] = time.reshape(texts, size)[seen].max(axis=1)
        rnd += 1
    return sig.reshape(texts, size)


def jaccard(ha: np.ndarray, hb: np.ndarray) -> float:
    """Jaccard index of two sets (hashes ascending)."""
    if not len(ha) or not len(hb):
        return 0.0
    if len(ha) > len(hb):
        ha, hb = hb, ha
    both = int((hb[np.minimum(np.searchsorted(hb, ha), len(hb) - 1)] == ha).sum())
    return both / (len(ha) + len(hb) - both)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """What signatures estimate, exactly, for two weighted sets (hashes ascending): the sum
    over shared d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    if not len(ha) or not len(hb):
        return 0.0
    if len(ha) > len(hb):
        ha, wa, hb, wb = hb, wb, ha, wa
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    if not both.any():
        return 0.0
    a, b = wa[both].astype(float), wb[at[both]].astype(float)
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    # elements of a ratio not below d's count by a, the others by b
    below = np.searchsorted(ratio, ratio, side="left")
    sum_a = only_a + np.append(np.cumsum(a[::-1])[::-1], 0.0)[below]
    sum_b = only_b + np.append(0.0, np.cumsum(b))[below]
    return float((1.0 / (sum_a / a + sum_b / b)).sum())


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for i in range(bands):
        x = np.full(len(sig), i + 1, np.uint64)
        for j in range(rows):
            x = _mix(x * np.uint64(31) + sig[:, i * rows + j])
        out[:, i] = x
    return out


def band_texts(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Add ``bands`` (array<bigint>; empty without words; those of equal weights and, if a shingle
    repeats, those of the weights behind them) and ``n_words`` (distinct shingles)."""

    @F.arrow_udf("struct<bands array<bigint>, n int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            done = []
            for part in byte_slices(arr):
                owner, h, w = shingles(part)
                n = np.bincount(owner, minlength=len(part))
                equal = band_hashes(signatures(owner, h, np.ones_like(w), len(part), bands * rows), bands, rows).view(np.int64)
                has, again = np.flatnonzero(n), np.unique(owner[w > 1])
                own = np.isin(owner, again)
                sig = signatures(np.searchsorted(again, owner[own]), h[own], w[own], len(again), bands * rows)
                size = np.zeros(len(part), np.int64)
                size[has] = bands
                size[again] += bands
                ends = np.concatenate([[0], np.cumsum(size)])
                b = np.zeros(int(ends[-1]), np.int64)
                b[ends[has][:, None] + np.arange(bands)] = equal[has]
                b[ends[again][:, None] + bands + np.arange(bands)] = band_hashes(sig, bands, rows).view(np.int64)
                done.append(pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(b)),
                     pa.array(n.astype(np.int32))], ["bands", "n"]))
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct([("bands", pa.list_(pa.int64())), ("n", pa.int32())]))

    own = [c for c in docs.columns if c not in ("bands", "n_words")]
    return (docs.select(*own, run(F.col(text)).alias("__b"))
                .select(*own, F.col("__b.bands").alias("bands"), F.col("__b.n").alias("n_words")))


def text_key(text: str = "text") -> list:
    """128 bits of a text, equal for equal texts: (k1, k2)."""
    return [F.xxhash64(F.col(text), F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), F.col(text)).alias("k2")]


def _at(id_: str, to: str, keys: tuple = ("k1", "k2")) -> list:
    """Join keys of an id (null or not) and the bits of a text."""
    return [F.coalesce(F.col(id_), F.lit(0)).alias(f"{to}id"), F.col(id_).isNull().alias(f"{to}no"),
            *[F.col(k).alias(f"{to}{k}") for k in keys]]


def _found(docs: DataFrame, doc_id: str, text: str, threshold: float, bands: int, rows: int, slot_texts: int,
           slot_words: int, null_ids: bool) -> DataFrame:
    """What near_duplicates returns, with ``n`` rows and ``n_words`` of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "textdup")
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    if not null_ids:
        base = base.filter(F.col("id").isNotNull())
    base = base.select("id", "text", *text_key())
    slim = scratch.table(band_texts(base, "text", bands, rows).drop("text"))
    reps = slim.filter("n_words > 0").groupBy("k1", "k2").agg(
        F.min(F.struct(F.col("id").isNull().alias("no"), "id", "n_words", "bands")).alias("r"))
    # rep is a number of the text, not an id: an id may hold several texts
    reps = scratch.table(reps.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), "r.id", "r.n_words", "r.bands"))

    # texts that share a band hang on the band's smallest; a hot band is a skewed join, which splits
    banded = reps.select("rep", F.explode(F.array_distinct("bands")).alias("band"))
    low = banded.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    star = banded.select("rep", "band").join(low.select("band", "lo"), "band").select("rep", "lo").filter("rep <> lo")
    group = scratch.table(components(star, scratch, "rep", "lo").withColumnRenamed("id", "rep"))

    # groups are dealt into slots of bounded texts and words; small groups share tasks
    inside = group.join(reps, "rep")
    size = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    size = size.withColumn("slots", F.greatest(F.ceil(F.col("n") / slot_texts), F.ceil(F.col("w") / slot_words)))
    size = scratch.table(size)
    words = size.filter("slots = 1").agg(F.sum("w").alias("w")).first()["w"] or 0
    bins = max(1, -(-words // slot_words))
    dealt = (inside.join(size, "component")
                   .withColumn("s", F.pmod(F.xxhash64("rep"), F.col("slots")))
                   # slot s meets itself and all others; the pair (s, t) is the task of s * slots + t, s <= t
                   .withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)))
                   .withColumn("task", F.when(F.col("slots") == 1, F.pmod(F.xxhash64("component"), F.lit(bins)))
                               .otherwise(F.xxhash64("component", F.least("s", "t"), F.greatest("s", "t"))))
                   .withColumn("side", F.when(F.col("s") == F.col("t"), 2).when(F.col("s") < F.col("t"), 0).otherwise(1)))
    # a text is read from the rows of its smallest id
    sent = dealt.select(*_at("id", "__"), "rep", "component", "bands", "task", "side")
    work = base.select("text", *_at("id", "__")).join(sent, ["__id", "__no", "__k1", "__k2"]) \
               .select("rep", "text", "component", "bands", "task", "side")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep")          # the same text: an id and text may stand in several rows
        owner, h, _ = shingles(pa.array(pdf["text"], pa.large_string()))
        cut = np.searchsorted(owner, np.arange(len(pdf) + 1))
        rep, side = pdf["rep"].to_numpy(), pdf["side"].to_numpy()
        bands_ = pdf["bands"].to_numpy()
        where = pd.DataFrame({"c": pdf["component"].to_numpy(), "i": np.arange(len(pdf))})
        out: list = []
        for _, rows_ in where.groupby("c")["i"]:
            k = rows_.to_numpy()
            if len(k) < 2:
                continue
            width = max(len(bands_[i]) for i in k)
            B, sd = np.stack([np.resize(bands_[i], width) for i in k]), side[k]     # one family stands for both
            share = np.zeros((len(k), len(k)), np.int16)
            for i in range(B.shape[1]):
                share += B[:, i][:, None] == B[:, i][None]
            ok = np.triu(share > 0, 1)
            if sd[0] != 2:
                ok &= sd[:, None] != sd[None]
            x, y = np.nonzero(ok)
            best = np.argsort(-share[x, y], kind="stable")       # likely pairs first
            x, y = x[best], y[best]
            forest = Forest(len(k))
            while len(x):
                for s, t in zip(x[:64].tolist(), y[:64].tolist(), strict=True):
                    if forest.find(s) != forest.find(t):
                        a, b = slice(cut[k[s]], cut[k[s] + 1]), slice(cut[k[t]], cut[k[t] + 1])
                        if jaccard(h[a], h[b]) >= threshold:
                            forest.join(s, t)
                            out.append((rep[k[s]], rep[k[t]]))
                x, y = x[64:], y[64:]
                root = np.array([forest.find(i) for i in range(len(k))])
                open_ = root[x] != root[y]
                x, y = x[open_], y[open_]
        return pd.DataFrame({"a": [p[0] for p in out], "b": [p[1] for p in out]}, dtype="int64")

    links = scratch.table(work.groupBy("task").applyInPandas(compare, "a bigint, b bigint"))
    comp = components(links, scratch).withColumnRenamed("id", "rep")
    linked = reps.select("rep", "id", "k1", "k2").join(comp, "rep")
    head = linked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")).alias("head"))
    head = linked.select("rep", "component").join(head, "component").select("rep", "head")
    own = F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")
    classes = reps.select("k1", "k2", "rep", F.col("id").alias("class_id"), own.alias("own")).join(head, "rep", "left") \
                  .select("k1", "k2", "class_id", F.coalesce("head", "own").alias("head"))
    out = slim.groupBy("id", "k1", "k2", "n_words").agg(F.count(F.lit(1)).alias("n")).join(classes, ["k1", "k2"], "left")
    # a document without words has no class and is its own
    kept = F.col("head").isNull() | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("k1") == F.col("head.k1"))
                                     & (F.col("k2") == F.col("head.k2")))
    return out.select(F.col("id").alias("doc_id"), "k1", "k2", F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
                      kept.alias("kept"), "n", "n_words")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, slot_texts: int = SLOT_TEXTS,
                    slot_words: int = SLOT_WORDS, null_ids: bool = False) -> DataFrame:
    """``doc_id, k1, k2, class_id, component_id, kept``: one row per document (id and text);
    class_id is the smallest id with the same text, component_id the smallest id of its group
    of near duplicates, kept whether the document is the group's first (by id, k1 and k2)."""
    return _found(docs, doc_id, text, threshold, bands, rows, slot_texts, slot_words, null_ids).drop("n", "n_words")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
             bands: int = BANDS, rows: int = ROWS, slot_texts: int = SLOT_TEXTS, slot_words: int = SLOT_WORDS,
             null_ids: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the group's first document;
    of several, the first as JSON.  Rows without words stay, and without ``null_ids`` rows with a null id."""
    found = _found(docs, doc_id, text, threshold, bands, rows, slot_texts, slot_words, null_ids)
    at = ["__id", "__no", "__k1", "__k2"]
    some = found.filter((F.col("n_words") > 0) & (~F.col("kept") | (F.col("n") > 1))).select(*_at("doc_id", "__"), "kept")
    some = Scratch(docs.sparkSession, "textkeep").table(some)
    own = docs.columns
    k1, k2 = text_key(text)
    keyed = (docs.select("*", F.col(doc_id).cast("bigint").alias("__i"), k1.alias("__a"), k2.alias("__b"))
                 .select(*own, *_at("__i", "__", ("__a", "__b"))).withColumnsRenamed({"____a": "__k1", "____b": "__k2"}))
    kept = keyed.join(some.drop("kept"), at, "left_anti").select(*own)
    again = some.filter("kept").drop("kept")
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(c) for c in own])
    one = keyed.join(again, at, "left_semi").groupBy(*at).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return kept.unionByName(one.select("__row.*"))
