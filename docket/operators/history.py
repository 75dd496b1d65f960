"""Question history: drop blanks and adjacent repeats (W2), recent list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.functions.text import ellipsis, trim_js

BUCKET_TURNS = 1 << 20


def drop_repeats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 text: str = "question", bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """Trimmed questions, blanks dropped, a question equal to the one kept
    just before it (same conversation) dropped.

    The "previous question" is a lag.  A window over a whole conversation would
    put one very long conversation into one task, so turns are cut into buckets
    of ``bucket_turns``: the lag runs inside each bucket, and the first row of a
    bucket takes the last question of the nearest earlier non-empty bucket (a
    window over one row per bucket).
    """
    nb = (turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                       trim_js(F.col(text)).alias("q"))
               .filter(F.col("q").isNotNull() & (F.col("q") != ""))
               .withColumn("_b", F.floor(F.col("turn") / bucket_turns)))
    inner = nb.withColumn("_prev", F.lag("q").over(Window.partitionBy("conv", "_b").orderBy("turn")))
    last = nb.groupBy("conv", "_b").agg(F.max_by("q", "turn").alias("_last"))
    carry = last.select("conv", "_b", F.lag("_last").over(Window.partitionBy("conv").orderBy("_b"))
                        .alias("_carry"))
    j = inner.join(carry, ["conv", "_b"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    kept = j.filter(prev.isNull() | (prev != F.col("q")))
    return kept.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("q").alias(text))


def recent_questions(kept: DataFrame, n: int = 8, conv: str = "conv_id", turn: str = "turn",
                     text: str = "question", width: int = 60) -> DataFrame:
    """W3 + T3: the last ``n`` kept questions per conversation, newest first,
    with a label cut at ``width`` characters.  Planned as a group limit, applied
    partially before the shuffle."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    r = kept.withColumn("rk", F.row_number().over(w).cast("bigint")).filter(F.col("rk") <= n)
    return r.select(conv, "rk", F.col(text).alias("question"), ellipsis(F.col(text), width).alias("label"))
