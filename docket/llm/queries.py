"""Registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import (bpe, hard_negatives, html_wrappers, lang_id, mixing, periodic, preference, secret_scan, text_neardup,
                        token_counts, topk, url_rules, vec_neardup)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf, "documents")
    model = lang_id.fit(docs)
    texts = docs.select("doc_id", lang_id.held_out().alias("held_out"), "text")
    return lang_id.identify(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best rows by integer inner product of every 20th vector."""
    return topk.top_k(topk.prepare(_table(spark, sf, "embeddings")), lambda i: i % 20 == 0)


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every document in the mix of sources."""
    return (mixing.mix(_table(spark, sf, "documents").select("doc_id", "source"))
            .select("doc_id", "source", "mix_epoch", "mix_slot"))


def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Urls of pages whose id is labelled; blocked if toxic or of quality 0."""
    labels = _table(spark, sf, "labels").select(
        "doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    pages = _table(spark, sf, "pages").select("page_id", "url")
    return pages.join(labels, pages.page_id == labels.doc_id).select("url", "blocked")


def op4_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's url."""
    mined = url_rules.mine(page_labels(spark, sf))
    judged = url_rules.judge(_table(spark, sf, "pages").select("page_id", "url"), mined)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes of every document."""
    return bpe.round_trip(_table(spark, sf, "documents").select("doc_id", "text")).drop("text")


def derived_edits() -> F.Column:
    """Three edits per document at places drawn from its id: replace 12, delete 40, insert some."""
    place = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.coalesce(F.length("text"), F.lit(0)) + 1)
    row = lambda s, n, r: F.struct(s.alias("start"), (s + n).alias("end"), F.lit(r).alias("replacement"))
    return F.array(row(place(1), 12, " (revised) "), row(place(2), 40, ""), row(place(3), 0, " see also: new notes,\n"))


def op6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    docs = _table(spark, sf, "documents").select("doc_id", "text").withColumn("edits", derived_edits())
    out = token_counts.count_with_edits(docs)
    return out.select("doc_id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded",
                      F.sha2("edited", 256).alias("edited_sha256"))


def op7_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of near-equal vectors."""
    return vec_neardup.near_duplicates(_table(spark, sf, "embeddings"))


def op8_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Class and group of near duplicates of every document."""
    out = text_neardup.near_duplicates(_table(spark, sf, "documents"), null_ids=True)
    return out.select("doc_id", "class_id", "component_id", "kept")


def chosen_rejected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every conversation as chosen; as rejected, with its last assistant turn cut to half."""
    chosen = _table(spark, sf, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = (chosen.filter(F.col("role") == preference.TRAINED).groupBy("pair_id")
                  .agg(F.max("turn").alias("last")))
    half = F.col("text").substr(F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    cut = (F.col("role") == preference.TRAINED) & (F.col("turn") == F.col("last"))
    rejected = chosen.join(last, "pair_id", "left").select(
        "pair_id", "turn", "role", F.when(cut, half).otherwise(F.col("text")).alias("text"))
    return chosen, rejected


def op9_preference(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered turns of prompt, chosen and rejected side of every conversation."""
    return preference.format_preferences(*chosen_rejected(spark, sf))


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secret spans of every document."""
    found = secret_scan.scan_secrets(_table(spark, sf, "documents").select("doc_id", "text"))
    of = lambda k: F.filter("secrets", lambda x: x["kind"] == k)
    base = F.filter("secrets", lambda x: x["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
                        secret_scan.span_text("secrets").alias("spans"))


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth (by checksum of the id) repeat a stretch of their words to the end."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(periodic.WORD), 0)
    n = F.size("__w").cast("bigint")
    a = F.col("__g") % n
    p = 1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8))
    at = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1),
                                     lambda i: F.get("__w", at(i).cast("int"))), " ")
    return (docs.withColumn("__g", g).withColumn("__w", F.when(h % 10 == 0, words))
                .withColumn("__a", F.when(n > 0, a)).withColumn("__p", F.when(n > 0, p))
                .withColumn("text", F.when(n > 0, again).otherwise(F.col("text")))
                .drop("__g", "__w", "__a", "__p"))


def op11_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of repeated words in every document, and its words without the repeats."""
    found = periodic.find_runs(looped(_table(spark, sf, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    b = found.withColumn("b", longest)
    return b.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("b.start").alias("start"),
                    (-F.col("b.l")).alias("length"), F.col("b.period").alias("period"),
                    F.floor(-1000 * F.col("b.l") / F.col("b.period")).alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is taken for the next one."""
    rows = hard_negatives.prepare(_table(spark, sf, "embeddings"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", noisy), lambda i: i % 100 == 0)


def op13_html(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    got = html_wrappers.extract(_table(spark, sf, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_topk, op3_mixing, op4_urls, op5_bpe, op6_counts, op7_vectors, op8_minhash,
    op9_preference, op10_secrets, op11_runs, op12_hard_negatives, op13_html)}


# The other queries rest on a trained model, a vocabulary or matching that SQL cannot express;
# tests/llm holds them against brute force.
SQL = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    "op3_mixing": """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s FROM documents),
n AS (SELECT s, count(*) AS n, sqrt(count(*) * sqrt(count(*))) AS w FROM d GROUP BY s),
o AS (SELECT list(s ORDER BY s) AS names, list(n ORDER BY s) AS ns, list(w ORDER BY s) AS raw FROM n),
arr AS (SELECT names, ns, list_transform(raw, lambda x: x / list_reduce(raw, lambda p, q: p + q)) AS w FROM o),
hm AS (SELECT list_max(list_transform(range(1, len(w) + 1), lambda i: ceil(((ns[i] + 15) // 16) / w[i])::BIGINT)) AS h FROM arr),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS had, NULL::BIGINT AS src, NULL::BIGINT AS nth FROM arr
  UNION ALL
  SELECT t + 1, list_transform(had, lambda a, i: CASE WHEN i = win THEN a + 1 ELSE a END), win, had[win]
  FROM (SELECT t, had, list_sort(list_transform(range(1, len(w) + 1), lambda i:
          {'e': floor(had[i] / w[i] * (1 + 1e-12::DOUBLE) + 1e-12::DOUBLE) > t,
           'k': CASE WHEN floor(had[i] / w[i] * (1 + 1e-12::DOUBLE) + 1e-12::DOUBLE) > t THEN floor(had[i] / w[i] * (1 + 1e-12::DOUBLE) + 1e-12::DOUBLE)
                     ELSE ceil((had[i] + 1) / w[i] * (1 - 1e-12::DOUBLE) - 1e-12::DOUBLE) END, 'i': i}))[1].i AS win FROM edf, arr, hm WHERE t < h)),
plan AS (SELECT names[src] AS s, ns[src] AS n, nth, t - 1 AS slot FROM edf, arr WHERE src IS NOT NULL),
hz AS (SELECT max(slot) AS z FROM plan WHERE nth = (n + 15) // 16 - 1),
p AS (SELECT plan.* FROM plan, hz WHERE slot <= z),
quota AS (SELECT s, any_value(n) AS n, count(*) * 16 AS q FROM p GROUP BY s),
i AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS i FROM d),
e AS (SELECT i.*, n, unnest(range(0, (q - 1 - i) // n + 1)) AS mix_epoch FROM i JOIN quota USING (s) WHERE i < q)
SELECT doc_id, source, mix_epoch::BIGINT AS mix_epoch, slot AS mix_slot
FROM e JOIN p ON p.s = e.s AND p.nth = (i + mix_epoch * e.n) // 16""",
    "op7_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, min(r.b) AS component_id,
       v.vec_id = min(r.b) AS kept
FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id""",
    "op8_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, text,
       list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT class_id, w FROM d WHERE doc_id = class_id AND len(w) > 0),
s AS (SELECT DISTINCT class_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT class_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c)),
z AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
j AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN z x ON x.class_id = a JOIN z y ON y.class_id = b WHERE m / (x.n + y.n - m) >= 0.8),
r AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CASE WHEN len(w) > 0 THEN class_id ELSE doc_id END AS class_id,
       coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN k ON k.a = d.class_id""",
    "op9_preference": """
WITH c AS (SELECT conv_id AS pair_id, turn, role, text,
                  max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
two AS (SELECT pair_id, turn, role, text AS a,
        CASE WHEN role = 'assistant' AND turn = last THEN substr(text, 1, length(text) // 2) ELSE text END AS b FROM c),
f AS (SELECT *, min(CASE WHEN a IS DISTINCT FROM b THEN turn END) OVER (PARTITION BY pair_id) AS first FROM two),
o AS (SELECT pair_id, 'prompt' AS part, turn, role, a AS text FROM f WHERE first IS NULL OR turn < first
      UNION ALL SELECT pair_id, 'chosen', turn, role, a FROM f WHERE turn >= first
      UNION ALL SELECT pair_id, 'rejected', turn, role, b FROM f WHERE turn >= first),
t AS (SELECT *, '<|' || role || '|>' || chr(10) AS h, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM o)
SELECT pair_id, part, turn, 1::BIGINT AS nth, role, rendered,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(h) ELSE 0 END::BIGINT AS train_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(rendered) ELSE 0 END::BIGINT AS train_to
FROM t""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""",
}
