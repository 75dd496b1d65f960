"""Answer context: concatenated hits (A3), top source (A4), link lookup (J4),
prompt (P11) and answer defaults (P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.text import clean_context, js_or, render_answer, strip_extension
from docket.session import cut


def _grams(c: Column, g: int) -> Column:
    """Distinct substrings of length ``g`` (empty when the text is shorter)."""
    n = F.length(c) - g + 1
    return F.when(n >= 1, F.array_distinct(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, g)))
    ).otherwise(F.array().cast("array<string>"))


def link_by_contains(names: DataFrame, index: DataFrame, name_col: str = "name",
                     pos: str = "pos", path: str = "path", link: str = "link",
                     out_col: str = "link", gram: int = 3) -> DataFrame:
    """For each name, the link of the first index entry (by ``pos``) whose
    path contains the name, letter case ignored; null when none does.

    No pair of (name, path) is formed blindly.  Equal paths are one row, the first.  The n-grams of
    the names are counted in the paths, and a name looks up only its rarest n-gram (a path holding
    the name must hold every n-gram of it); candidates are verified with ``contains`` and reduced to
    the first path per name before they are shuffled, so a name that most paths hold costs one row
    per task.  No link travels: it is looked up by the position found.  All joins are equi-joins
    on n-grams of names only; the n-grams of paths are shuffled, never broadcast.
    """
    idx = index.groupBy(F.lower(F.col(path)).alias("_lp")).agg(
        F.min(F.struct(F.col(pos).alias("p"), F.col(link).isNotNull().alias("has"), F.col(link).alias("l"))).alias("_at"))
    idx = cut(idx.filter(F.col("_lp").isNotNull()).select("_lp", F.col("_at.p").alias("_pos"), F.col("_at.l").alias("_link")), "paths")
    ln = cut(names.select(F.lower(F.col(name_col)).alias("_ln")).filter(F.col("_ln").isNotNull()).distinct(), "names")
    glen = F.least(F.length("_ln"), F.lit(gram))
    nonempty = ln.filter(F.length("_ln") > 0)
    ng = nonempty.select("_ln", F.explode(
        F.transform(F.sequence(F.lit(1), F.length("_ln") - glen + 1),
                    lambda i: F.substring(F.col("_ln"), i, glen))).alias("_g"))
    wanted = ng.select("_g", F.length("_g").alias("_n")).distinct()
    sized = F.array(*[F.struct(F.lit(g).alias("n"), _grams(F.col("_lp"), g).alias("g")) for g in range(1, gram + 1)])
    sizes = [r[0] for r in nonempty.select(glen.alias("n")).distinct().collect()]       # at most ``gram`` numbers
    kinds = F.flatten(F.transform(F.filter(sized, lambda x: x["n"].isin(sizes or [0])), lambda x: x["g"]))
    held = idx.select("_pos", F.explode(kinds).alias("_g"))
    freq = held.join(wanted, "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (ng.join(freq, "_g", "left")
                .groupBy("_ln")
                .agg(F.min_by("_g", "_df").alias("_g"),
                     F.count(F.when(F.col("_df").isNull(), 1)).alias("_missing"))
                .filter(F.col("_missing") == 0)
                .select("_ln", "_g"))
    # n-grams are many times the bytes of the paths that Spark knows: by its estimate it would broadcast them
    found = (idx.select("_pos", "_lp", F.explode(kinds).alias("_g")).hint("merge").join(rarest, "_g")
                .filter(F.col("_lp").contains(F.col("_ln")))
                .groupBy("_ln").agg(F.min("_pos").alias("_pos"))
                .join(idx.select("_pos", "_link"), "_pos").select("_ln", F.col("_link").alias("_hit")))
    # The empty name is contained in every path: the first path wins.
    first = idx.agg(F.min_by("_link", "_pos")).scalar()
    found = found.unionByName(ln.filter(F.col("_ln") == "").select("_ln", first.alias("_hit")))
    return (names.withColumn("_ln", F.lower(F.col(name_col)))
                 .join(found, "_ln", "left")
                 .drop("_ln")
                 .withColumnRenamed("_hit", out_col))


def hit_payload(hits: DataFrame, chunks: DataFrame, c_id: str = "id", c_text: str = "content",
                c_source: str = "source", q_id: str = "qid") -> DataFrame:
    """Hits with the text and source of their chunk: ``(qid, id, rk, _t, _src)``.

    One join serves both the context (A3) and the source (A4).  The hits (k
    rows per question) are written to the checkpoint folder, so Spark knows their bytes
    and broadcasts them only under its own threshold in bytes; beyond it, a shuffle join.
    """
    h = cut(hits.select(F.col(q_id).alias("qid"), "id", "rk"))
    payload = chunks.select(F.col(c_id).alias("id"), F.col(c_text).alias("_t"),
                            F.col(c_source).alias("_src"))
    return h.join(payload, "id")


def concat_context(hits: DataFrame, chunks: DataFrame | None = None, c_id: str = "id",
                   c_text: str = "content", q_id: str = "qid") -> DataFrame:
    """A3: per question, hit texts joined by newline in rank order, then cleaned.

    ``chunks=None`` means ``hits`` already carries the payload (``hit_payload``).
    """
    if chunks is None:
        j = hits.select("qid", "rk", "_t")
    else:
        j = hit_payload(hits, chunks.withColumn("_nosrc", F.lit(None).cast("string")),
                        c_id=c_id, c_text=c_text, c_source="_nosrc", q_id=q_id)
    agg = j.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rk", "_t"))).alias("_h"),
        F.count(F.lit(1)).alias("n_hits"))
    return agg.select(
        F.col("qid").alias(q_id),
        clean_context(F.array_join(F.transform("_h", lambda x: F.coalesce(x["_t"], F.lit(""))), "\n"))
        .alias("context"),
        "n_hits")


def top_source(hits: DataFrame, chunks: DataFrame | None, index: DataFrame | None,
               c_id: str = "id", c_source: str = "source", q_id: str = "qid",
               pin: bool = True) -> DataFrame:
    """A4: source of the rank-1 hit, as a label (T4) and a link (J4); null when absent or empty."""
    if chunks is None:
        top = hits.filter(F.col("rk") == 1).select("qid", F.nullif(F.col("_src"), F.lit("")).alias("_src"))
    else:
        rows = hit_payload(hits.filter(F.col("rk") == 1),
                           chunks.withColumn("_notext", F.lit(None).cast("string")),
                           c_id=c_id, c_text="_notext", c_source=c_source, q_id=q_id)
        top = rows.select("qid", F.nullif(F.col("_src"), F.lit("")).alias("_src"))
    top = top.withColumn("source_label", strip_extension("_src"))
    if index is not None and pin:
        # One row per question, read twice below (names to broadcast, then the
        # join back): cut its lineage so the search behind it runs once.
        # (``pin=False`` when ``hits`` is already a written table.)
        top = cut(top)
    if index is None:
        top = top.withColumn("source_link", F.lit(None).cast("string"))
    else:
        named = top.filter(F.col("_src").isNotNull())
        linked = link_by_contains(named, index, name_col="_src", out_col="source_link")
        top = top.filter(F.col("_src").isNull()).withColumn(
            "source_link", F.lit(None).cast("string")).unionByName(linked)
    return top.select(F.col("qid").alias(q_id), "source_label", "source_link")


PROMPT_TEMPLATE = (
    "Answer the question using only the notes below. If the notes do not hold the "
    "answer, reply: Not in notes.\n\nNOTES:\n{context}\n\nQUESTION:\n{question}\n\nANSWER:\n")


def build_prompt(question, context, template: str = PROMPT_TEMPLATE) -> Column:
    """The prompt handed to a text model (our own wording)."""
    parts = template.split("{context}")
    head, tail = parts[0], parts[1]
    mid, end = tail.split("{question}")
    q = F.col(question) if isinstance(question, str) else question
    c = F.col(context) if isinstance(context, str) else context
    return F.concat(F.lit(head), F.coalesce(c, F.lit("")), F.lit(mid),
                    F.coalesce(q, F.lit("")), F.lit(end))


def answer_defaults(df: DataFrame, form: str = "cli") -> DataFrame:
    """P10: fill the missing answer, label and link as the command line or the page shows them."""
    if form == "cli":
        return df.select(
            *[c for c in df.columns if c not in ("answer", "source_label", "source_link")],
            js_or("answer", "No answer returned").alias("answer"),
            js_or("source_label", "No source label").alias("source_label"),
            js_or("source_link", "No source link").alias("source_link"))
    if form == "page":
        body = render_answer(js_or("answer", "No answer provided."))
        link = F.nullif(F.col("source_link"), F.lit(""))
        block = F.concat(F.lit('<br><br><div><strong>Source PDF:</strong> <a href="'), link,
                         F.lit('" target="_blank">'), js_or("source_label", "Open PDF"),
                         F.lit("</a></div>"))
        return df.withColumn("html", F.when(link.isNotNull(), F.concat(body, block)).otherwise(body))
    raise ValueError("form is 'cli' or 'page'")


FILE_BASE_URL = "http://localhost:3000/files/"


def lookup_file(requests: DataFrame, stored: DataFrame, name_col: str = "name",
                base_url: str = FILE_BASE_URL) -> DataFrame:
    """Each request with ``status`` ('missing' for no name, 'not_found',
    'ok') and ``file_url`` when found.  An exact key join; no file system access."""
    names = stored.select(F.col(name_col).alias("_n")).distinct().withColumn("_hit", F.lit(True))
    j = requests.join(names, requests[name_col] == names["_n"], "left")
    empty = F.col(name_col).isNull() | (F.col(name_col) == "")
    status = (F.when(empty, F.lit("missing"))
               .when(F.col("_hit").isNotNull(), F.lit("ok"))
               .otherwise(F.lit("not_found")))
    return j.select(*requests.columns, status.alias("status"),
                    F.when(~empty & F.col("_hit").isNotNull(),
                           F.concat(F.lit(base_url), F.col(name_col))).alias("file_url"))
