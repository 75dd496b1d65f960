"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Every source is read in blocks of ``block_rows`` rows, in a fixed order (by MD5 of
the key).  With target weight w, block b of a source is released at slot floor(b / w) and
due at ceil((b + 1) / w); in every slot the released block with the earliest deadline goes next.
So at any moment each source is less than one block away from its target share, for the
weights as they are given, however long the mix.

The slots are cut in frames of ``FRAME``, one row each, whose schedules are folded side by side.  A
frame starts from a guess of how many blocks each source has had by then; where the frame before
ends otherwise, it is folded again from there, until all frames agree, which makes the whole the one
earliest-deadline-first schedule.  (How often depends on the sparsest source: its guess can be
wrong for as long as one of its blocks may wait.)  A frame's row holds two numbers per source, and
a slot looks at every source: the fold costs slots x sources, in frames that run side by side.

Nothing is dropped: the mix ends when every source has been read through once, and
sources that are due more rows by then start again (``mix_epoch`` counts).

Defined results: a null source is a source of its own; rows with equal keys keep
apart (ordered by the other given columns' hash; fully equal rows are interchangeable);
sources share the weights of those that are there; one without a positive target weight gets
``LEAST`` of their sum; an empty table gives an empty table; columns named like the added
ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.llm.common import Scratch

BLOCK_ROWS = 16
FRAME = 1000
LEAST = 0.001
EDGE = 1e-12            # b / w this near an integer is that integer: weights are doubles
BUCKET_ROWS = 1000
ADDED = ("mix_epoch", "mix_slot", "mix_pos")


def targets(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``counts`` (src, n) as one row ``s``: every source's name, rows and share, by name; the shares sum to 1.

    Without ``weights`` a source's weight is n to the power 0.75, which lifts small sources."""
    if weights is None:
        weight = F.sqrt(F.col("n") * F.sqrt(F.col("n")))
    else:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        weight = F.greatest(F.coalesce(named[F.col("src")], F.lit(0.0)), F.lit(0.0)) if weights else F.lit(0.0)
    one = counts.select("src", "n", weight.alias("w")).groupBy().agg(F.sort_array(F.collect_list(F.struct("src", "n", "w"))).alias("s"))
    total = lambda s: F.aggregate(F.transform(s, lambda x: x["w"]), F.lit(0.0), lambda a, w: a + w)
    given = one.withColumn("sum", total("s"))
    least = F.when(F.col("sum") > 0, F.col("sum") * LEAST).otherwise(F.lit(1.0))
    full = given.withColumn("s", F.transform("s", lambda x: F.struct(
        x["src"].alias("src"), x["n"].alias("n"), F.when(x["w"] > 0, x["w"]).otherwise(least).alias("w"))))
    return full.withColumn("sum", total("s")).select(F.transform("s", lambda x: F.struct(
        x["src"].alias("src"), x["n"].alias("n"), (x["w"] / F.col("sum")).alias("w"))).alias("s")).filter(F.size("s") > 0)


def _fold(frames: DataFrame, frame: int) -> DataFrame:
    """``(j, w, start)`` with ``seq``, the source and block number of every slot of frame j, and ``end``,
    the blocks each source has had after it."""
    def step(acc, t):
        def bid(a, i):
            w = F.get(F.col("w"), i)
            free = F.floor(a / w * (1 + EDGE) + EDGE)
            due = F.ceil((a + 1) / w * (1 - EDGE) - EDGE)
            return F.struct((free > t).alias("early"), F.when(free > t, free).otherwise(due).alias("key"),
                            i.alias("i"), a.alias("nth"))
        return F.struct(F.array_min(F.transform(acc["had"], bid)).alias("win"), acc["had"].alias("had"), acc["seq"].alias("seq"))

    def take(acc):
        return F.struct(
            F.transform(acc["had"], lambda a, i: F.when(i == acc["win"]["i"], a + 1).otherwise(a)).alias("had"),
            F.concat(acc["seq"], F.array(F.struct(acc["win"]["i"].alias("i"), acc["win"]["nth"].alias("nth")))).alias("seq"))

    zero = F.struct(F.col("start").alias("had"), F.array().cast("array<struct<i int, nth bigint>>").alias("seq"))
    first = F.col("j") * frame
    run = F.aggregate(F.sequence(first, first + (frame - 1)), zero, lambda acc, t: take(step(acc, t)))
    return frames.select("j", "w", "start", run.alias("r")).select("j", "w", "start", F.col("r.had").alias("end"), F.col("r.seq").alias("seq"))


def schedule(sources: DataFrame, scratch: Scratch, block_rows: int, frame: int = FRAME) -> DataFrame:
    """The earliest-deadline-first schedule until the last first-pass block is due: ``(i, nth, slot)``, the
    block nth of source i (its place in ``s``)."""
    w = F.transform("s", lambda x: x["w"])
    due = F.array_max(F.transform("s", lambda x: F.ceil(F.ceil(x["n"] / block_rows) / x["w"])))
    frames = sources.select(w.alias("w"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((due - 1) / frame))).alias("j"))
    # the guess: what is due by then, and of what is under way the earliest deadlines
    at = F.col("j") * frame
    base = F.transform("w", lambda x: F.floor(at * x))
    frames = frames.withColumn("base", base).withColumn("more", at - F.aggregate("base", F.lit(0).cast("bigint"), lambda a, x: a + x))
    under = F.filter(F.transform("w", lambda x, i: F.struct(F.ceil((F.get("base", i) + 1) / x).alias("d"), i.alias("i"),
                                                            (at * x > F.get("base", i)).alias("go"))), lambda x: x["go"])
    chosen = F.transform(F.slice(F.array_sort(under), F.lit(1), F.greatest(F.col("more"), F.lit(0)).cast("int")), lambda x: x["i"])
    start = F.transform("base", lambda a, i: a + F.array_contains(F.col("chosen"), i).cast("bigint"))
    cur, path = scratch.write(_fold(frames.withColumn("chosen", chosen).withColumn("start", start), frame))
    while True:
        ends = cur.select((F.col("j") + 1).alias("j"), F.col("end").alias("before"))
        wrong, wpath = scratch.write(cur.join(ends, "j").filter(F.col("start") != F.col("before"))
                                        .select("j", "w", F.col("before").alias("start")))
        if not wrong.limit(1).count():
            break
        right = cur.join(wrong.select("j"), "j", "left_anti").select("j", "w", "start", "end", "seq")
        nxt, npath = scratch.write(right.unionByName(_fold(wrong, frame)))
        scratch.drop(path)
        scratch.drop(wpath)
        cur, path = nxt, npath
    return (cur.select("j", F.posexplode("seq").alias("p", "x"))
               .select("x.i", "x.nth", (F.col("j") * frame + F.col("p")).alias("slot")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id",
        block_rows: int = BLOCK_ROWS, frame: int = FRAME) -> DataFrame:
    """All rows of ``docs`` with their place in the mix: ``mix_epoch`` (times the source was
    read before), ``mix_slot`` (block place) and ``mix_pos`` (row place, from 0)."""
    scratch = Scratch(docs.sparkSession, "mix")
    own = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*own, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("__src"),
                       F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("__md"))
    # a bucket is a range of MD5 values, so buckets keep the order within a source
    rows = rows.withColumn("__h", F.xxhash64(*own))
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("__bkt", F.floor(
        F.conv(F.substring("__md", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)).cast("bigint"))
    counts = scratch.table(rows.groupBy("__src", "__bkt").agg(F.count(F.lit(1)).alias("__c")))
    before = counts.select("__src", "__bkt", (F.sum("__c").over(
        Window.partitionBy("__src").orderBy("__bkt")) - F.col("__c")).alias("__before"))
    names = {f"={k}": v for k, v in weights.items()} if weights is not None else None
    sources = scratch.table(targets(counts.groupBy(F.col("__src").alias("src")).agg(F.sum("__c").alias("n")), names))
    each = sources.select(F.posexplode("s").alias("i", "x")).select("i", F.col("x.src").alias("__src"), F.col("x.n").alias("__n"))
    plan = scratch.table(schedule(sources, scratch, block_rows, frame).join(each, "i").select("__src", "__n", F.col("nth").alias("__b"), "slot"))

    # the mix ends with the last first-pass block of any source
    size = F.lit(block_rows).cast("bigint")
    horizon = plan.filter(F.col("__b") == F.ceil(F.col("__n") / size) - 1).agg(F.max("slot")).first()[0]
    slots = plan.filter(F.col("slot") <= F.lit(-1 if horizon is None else horizon))
    quota = slots.groupBy("__src").agg(F.first("__n").alias("__n"), (F.count(F.lit(1)) * size).alias("__quota"))

    order = Window.partitionBy("__src", "__bkt").orderBy("__md", key, "__h")
    placed = (rows.join(before, ["__src", "__bkt"])
                  .withColumn("__i", F.col("__before") + F.row_number().over(order) - 1)
                  .join(quota, "__src")
                  .withColumn("mix_epoch", F.explode(F.sequence(
                      F.lit(0).cast("bigint"), F.floor((F.col("__quota") - 1 - F.col("__i")) / F.col("__n")))))
                  .withColumn("__k", F.col("__i") + F.col("mix_epoch") * F.col("__n"))
                  .withColumn("__b", F.floor(F.col("__k") / size)))
    return (placed.join(slots.select("__src", "__b", F.col("slot").alias("mix_slot")), ["__src", "__b"])
                  .withColumn("mix_pos", F.col("mix_slot") * size + F.col("__k") % size)
                  .select(*own, *ADDED))
