"""URL filtering by host rules and mined association rules (DataFrame functions only).

Given host/path rules decide first.  For the other urls Spark's FP-growth mines
combinations of url tokens (all host labels, path segments and parameters of the query)
that go with blocked labels; tokens that are too rare among blocked urls to be part of any
rule are left out first.  Rules under the least confidence, support or lift are dropped, and the rest
are posted in an inverted index under their rarest token, so that a url meets only
rules one of whose tokens it holds.

Defined results: a null url, or one without ``://``, has empty host and path, fits no
rule and is allowed; urls are judged once each and repeated rows repeat the verdict;
without labelled rows nothing is mined; null labels count as not blocked; an empty
table gives an empty table; columns named like the added ones are replaced.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import ready

# The given rules (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.5, 1.2
BLOCKED = "=block"
ADDED = ("host", "path", "rule", "verdict", "confidence")


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    there = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return (F.when(there, host).otherwise(""),
            F.when(there, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts so."""
    hit = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):      # the longest is tested first
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        hit = F.when(fits, F.lit(rule)).otherwise(hit)
    return hit


def query_part(url: str = "url") -> Column:
    """What stands between the first ``?`` and ``#``; empty without ``://``."""
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    there = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    return F.when(there, F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)).otherwise("")


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens, told apart by a prefix: host labels, path segments, parameters."""
    words = lambda c, sep: F.filter(F.split(c, sep), lambda x: x != "")
    mark = lambda a, m: F.transform(a, lambda x: F.concat(F.lit(m), x))
    return F.array_distinct(F.concat(mark(words(host, r"\."), "h:"), mark(words(path, "/"), "p:"), mark(words(query, "&"), "q:")))


def mine(labelled: DataFrame, url: str = "url", blocked: str = "blocked", min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules ``(tokens, confidence, support, anchor)`` whose consequence is a blocked label."""
    spark = ready(labelled.sparkSession)
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double, anchor string")
    every = (labelled.select(tokens(*host_path(url), query_part(url)).alias("tok"), F.coalesce(blocked, F.lit(False)).alias("b"))
                     .filter((F.size("tok") > 0) | F.col("b")))
    least = ceil(min_support * every.count())
    # a rule's set with the block is frequent, so each of its tokens is with the block; these
    # are at most (mean tokens of a url / min_support), as in FP-growth's own item list
    often = (every.filter("b").select(F.explode("tok").alias("t")).groupBy("t").count()
                  .filter(F.col("count") >= least).select("t"))
    often = [r["t"] for r in often.collect()]
    if not often:
        return none
    known = F.array(*[F.lit(t) for t in often])
    items = every.select(F.concat(F.array_intersect("tok", known), F.when(F.col("b"), F.array(F.lit(BLOCKED)))
                                  .otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    single = (model.freqItemsets.filter(F.size("items") == 1)
                   .select(F.col("items")[0].alias("token"), "freq"))
    rules = (model.associationRules
             .filter((F.col("consequent")[0] == BLOCKED) & (F.col("lift") >= min_lift))
             .select(F.col("antecedent").alias("tokens"), "confidence", "support"))
    return (rules.withColumn("token", F.explode("tokens")).join(single, "token")
                 .groupBy("tokens", "confidence", "support")
                 .agg(F.min(F.struct("freq", "token"))["token"].alias("anchor")))


def judge(pages: DataFrame, mined: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict and, where a mined rule decides, its confidence."""
    ready(pages.sparkSession)
    host, path = host_path(url)
    own = [c for c in pages.columns if c not in ADDED]
    urls = (pages.select(F.col(url).alias("__url")).filter(F.col("__url").isNotNull()).distinct()
                 .select("__url", tokens(*host_path("__url"), query_part("__url")).alias("__tok"))
                 .withColumn("__t", F.explode("__tok")))
    index = mined.select(F.col("anchor").alias("__t"), F.col("tokens").alias("__need"), F.col("confidence").alias("__c"))
    hits = (urls.join(index, "__t").filter(F.size(F.array_except("__need", "__tok")) == 0)
                .groupBy("__url").agg(F.max("__c").alias("__c")))
    given = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.lit(None)
    out = (pages.select(*own, F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
                .withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
                .join(hits, "__url", "left"))
    verdict = F.when(F.col("rule").isNotNull(), given[F.col("rule")] if rules else F.lit(None)).otherwise(
        F.when(F.col("__c").isNotNull(), "block").otherwise("allow"))
    return out.select(*own, "host", "path", "rule", verdict.alias("verdict"),
                      F.when(F.col("rule").isNull(), F.col("__c")).alias("confidence"))
