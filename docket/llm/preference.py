"""Preference formatting of chosen and rejected conversations.

For every pair the longest common prefix of turns (equal role and text, turn by turn)
is rendered once as the prompt; the rest of either side follows as its completion.
The result has one row per rendered turn, ordered by ``(part, turn, nth)`` within a pair,
with the code points that carry training loss: so a conversation of any length stays
many rows and is never gathered in one task.  ``assemble`` joins rows of bounded
conversations to one record per pair.

Defined results: rows with a null pair or turn take no part; equal rows of one side count
once; different rows with equal turn numbers are ordered by role and text; a null role or
text renders as empty and equals only null; a pair on one side only has no prompt; pairs
with equal sides have a prompt and no completion; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRAINED = "assistant"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    rows = (df.filter(F.col(pair).isNotNull() & F.col(turn).isNotNull())
              .select(F.col(pair).alias("pair_id"), F.col(turn).alias("turn"),
                      F.col(role).alias("role"), F.col(text).alias("text")).distinct())
    order = Window.partitionBy("pair_id", "turn").orderBy("role", "text")
    return rows.withColumn("nth", F.row_number().over(order))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """``(pair_id, part, turn, nth, role, rendered, train_from, train_to)``: part is prompt,
    chosen or rejected; loss falls on code points train_from .. train_to (exclusive) of
    ``rendered``, which is the text and end mark of the assistant's turns in completions."""
    a, b = _turns(chosen, pair, turn, role, text), _turns(rejected, pair, turn, role, text)
    at = ["pair_id", "turn", "nth"]
    both = a.withColumn("side", F.lit("chosen")).join(
        b.withColumn("side", F.lit("rejected"))
         .select(*at, F.col("role").alias("r_role"), F.col("text").alias("r_text"), F.col("side").alias("r_side")),
        at, "full_outer")
    same = (F.col("side").isNotNull() & F.col("r_side").isNotNull()
            & F.col("role").eqNullSafe(F.col("r_role")) & F.col("text").eqNullSafe(F.col("r_text")))
    both = both.withColumn("same", same).withColumn("pos", F.struct("turn", "nth"))
    # the first position at which the sides differ ends the prefix
    split = both.filter(~F.col("same")).groupBy("pair_id").agg(F.min("pos").alias("first"))
    cut = both.join(split, "pair_id", "left").withColumn(
        "prefix", F.col("first").isNull() | (F.col("pos") < F.col("first")))
    sides = F.when(F.col("prefix"), F.array(F.struct(
        F.lit("prompt").alias("part"), F.col("role").alias("role"), F.col("text").alias("text")))).otherwise(
        F.filter(F.array(
            F.when(F.col("side").isNotNull(), F.struct(F.lit("chosen").alias("part"), F.col("role").alias("role"),
                                                       F.col("text").alias("text"))),
            F.when(F.col("r_side").isNotNull(), F.struct(F.lit("rejected").alias("part"), F.col("r_role").alias("role"),
                                                         F.col("r_text").alias("text")))), lambda x: x.isNotNull()))
    out = cut.select(*at, F.explode(sides).alias("x")).select(*at, "x.*")
    head = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE))
    rendered = F.concat(head, F.coalesce("text", F.lit("")), F.lit(END))
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED, F.lit(False))
    return out.select("pair_id", "part", "turn", F.col("nth").cast("bigint").alias("nth"), "role",
                      rendered.alias("rendered"),
                      F.when(trained, F.length(head)).otherwise(0).cast("bigint").alias("train_from"),
                      F.when(trained, F.length(rendered)).otherwise(0).cast("bigint").alias("train_to"))


def assemble(rows: DataFrame) -> DataFrame:
    """One record per pair: prompt, chosen, rejected, and the trained spans of both completions
    as arrays of (from, to).  Gathers a pair's turns in one row: for conversations that fit one."""
    part = lambda p: F.filter("all", lambda x: x["part"] == p)
    text = lambda p: F.array_join(F.transform(part(p), lambda x: x["rendered"]), "")

    def spans(p: str):
        start = F.struct(F.lit(0).cast("bigint").alias("at"),
                         F.array().cast("array<struct<`from` bigint, `to` bigint>>").alias("o"))
        return F.aggregate(
            part(p), start,
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["rendered"])).alias("at"),
                F.when(x["train_to"] > x["train_from"], F.concat(acc["o"], F.array(F.struct(
                    (acc["at"] + x["train_from"]).alias("from"), (acc["at"] + x["train_to"]).alias("to")))))
                 .otherwise(acc["o"]).alias("o")),
            lambda acc: acc["o"])

    row = F.struct("turn", "nth", "part", "rendered", "train_from", "train_to")
    return (rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(row)).alias("all"))
                .select("pair_id", text("prompt").alias("prompt"), text("chosen").alias("chosen"),
                        text("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"),
                        spans("rejected").alias("rejected_spans")))
