"""A corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and reread as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import bpe, lang_id, mixing, secret_scan, text_neardup
from docket.llm.common import Scratch

MIN_SCORE = 0.4     # a document whose best language gets less is rejected

#: SQL cannot express the trained model, the signatures or the vocabulary; see tests/llm.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the model knows, go."""
    model = lang_id.fit(docs)
    out = lang_id.identify(docs, model, pred="__pred", score="__score")
    if not model["names"]:          # nothing labelled to learn from: only the letter test holds
        return out.filter(F.col("text").rlike(r"\p{L}")).select(*docs.columns)
    return out.filter((F.col("__pred") != lang_id.UND) & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return text_neardup.keep_one(docs, null_ids=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    found = secret_scan.scan_secrets(docs, out="__secrets").withColumn("text", secret_scan.redact("text", "__secrets"))
    return found.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast("bigint"))
                            .otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; sources below their target weight repeat."""
    return (mixing.mix(docs).repartitionByRange("mix_pos").sortWithinPartitions("mix_pos")
            .select(*docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("secret_scan", secrets),
          ("source_mixing", mix_sources), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for _, stage in STAGES:
        docs, new = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(path)
        path = new
    return docs
