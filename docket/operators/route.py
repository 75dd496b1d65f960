"""Question routing: fields (R1-R3), candidate files (R4), dispatch (R5), classify.

Candidate test (R4), per question and file, on the lower-cased path:
  module m (when m is present and not 0): path holds 'module m', 'module_m', 'mod m' or 'm.'
  semester s (likewise): path holds 'srd sem', 'sth sem', 'snd sem' or 'sst sem'
  subject j (when present): path holds j
If no file passes, every file is a candidate.

Instead of testing every (question, file) pair, each file lists the keys it
passes (every m, s and j it would accept; a handful per path), and questions
meet files by an equi-join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.route import (REPLY_FOUND, REPLY_MISSING, REPLY_NOT_FOUND, REPLY_OTHER, SUBJECTS,
                                    classify, extract_module, extract_semester, extract_subject)

ANY_NUM = -1
ANY_SUBJ = ""


def route_fields(questions: DataFrame, q_col: str = "question", subjects=SUBJECTS) -> DataFrame:
    """Add ``module``, ``semester`` and ``subject``."""
    return questions.withColumns({
        "module": extract_module(q_col),
        "semester": extract_semester(q_col),
        "subject": extract_subject(q_col, subjects),
    })


def _prefixes(r: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, F.lit(1), i))


def _suffixes(r: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.length(r)))


def _as_numbers(strs: Column) -> Column:
    """Digit strings without a leading zero, as distinct BIGINTs (0 never filters)."""
    kept = F.filter(strs, lambda s: ~s.startswith("0"))
    return F.array_distinct(F.filter(F.transform(kept, lambda s: s.try_cast("bigint")),
                                     lambda x: x.isNotNull()))


def module_keys(lp: Column) -> Column:
    """Every module number m for which the lower-cased path passes the module test."""
    after = F.regexp_extract_all(lp, F.lit(r"(?:module |module_|mod )([0-9]+)"), F.lit(1))
    before_dot = F.regexp_extract_all(lp, F.lit(r"([0-9]+)\."), F.lit(1))
    return _as_numbers(F.concat(F.flatten(F.transform(after, _prefixes)),
                                F.flatten(F.transform(before_dot, _suffixes))))


def semester_keys(lp: Column) -> Column:
    """Every semester number s for which the lower-cased path passes the semester test."""
    runs = F.regexp_extract_all(lp, F.lit(r"([0-9]+)(?:rd|th|nd|st) sem"), F.lit(1))
    return _as_numbers(F.flatten(F.transform(runs, _suffixes)))


def subject_keys(lp: Column, subjects=SUBJECTS) -> Column:
    return F.filter(F.array(*[F.lit(s.name) for s in subjects]), lambda s: lp.contains(s))


def file_keys(index: DataFrame, path: str = "path", subjects=SUBJECTS) -> DataFrame:
    """Index rows with the arrays of module, semester and subject keys they pass."""
    lp = F.lower(F.col(path))
    return index.withColumns({"_mods": module_keys(lp), "_sems": semester_keys(lp),
                              "_subs": subject_keys(lp, subjects)})


def question_keys(questions: DataFrame, q_col: str = "question", subjects=SUBJECTS) -> DataFrame:
    f = route_fields(questions, q_col, subjects)
    return f.withColumns({
        "_mk": F.when(F.col("module") > 0, F.col("module")).otherwise(F.lit(ANY_NUM)).cast("bigint"),
        "_sk": F.when(F.col("semester") > 0, F.col("semester")).otherwise(F.lit(ANY_NUM)).cast("bigint"),
        "_jk": F.coalesce(F.col("subject"), F.lit(ANY_SUBJ)),
    })


def exploded_file_keys(index: DataFrame, path: str, subjects) -> DataFrame:
    fk = file_keys(index, path, subjects)
    any_n = F.array(F.lit(ANY_NUM).cast("bigint"))
    return (fk.withColumn("_mk", F.explode(F.concat(F.col("_mods"), any_n)))
              .withColumn("_sk", F.explode(F.concat(F.col("_sems"), any_n)))
              .withColumn("_jk", F.explode(F.concat(F.col("_subs"), F.array(F.lit(ANY_SUBJ)))))
              .filter((F.col("_mk") != ANY_NUM) | (F.col("_sk") != ANY_NUM) | (F.col("_jk") != ANY_SUBJ))
              .drop("_mods", "_sems", "_subs"))


def _has_filter() -> Column:
    return (F.col("_mk") != ANY_NUM) | (F.col("_sk") != ANY_NUM) | (F.col("_jk") != ANY_SUBJ)


def candidate_files(questions: DataFrame, index: DataFrame, q_id: str = "qid",
                    q_col: str = "question", pos: str = "pos", path: str = "path",
                    link: str = "link", subjects=SUBJECTS) -> DataFrame:
    """``(qid, pos, path, link, all_files)``.

    Questions whose filters pass some files get one row per such file.  A
    question with no filter, or whose filters pass nothing, gets one row with
    ``all_files = true`` standing for every file of the index.
    """
    qk = question_keys(questions, q_col, subjects).select(F.col(q_id).alias("qid"), "_mk", "_sk", "_jk")
    files = exploded_file_keys(index.select(F.col(pos).alias("pos"), F.col(path).alias("path"),
                                             F.col(link).alias("link")), "path", subjects)
    matched = qk.filter(_has_filter()).join(files, ["_mk", "_sk", "_jk"]) \
                .select("qid", "pos", "path", "link", F.lit(False).alias("all_files"))
    rest = qk.join(matched.select("qid").distinct(), "qid", "left_anti").select(
        "qid", F.lit(None).cast(index.schema[pos].dataType).alias("pos"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("link"),
        F.lit(True).alias("all_files"))
    return matched.unionByName(rest)


SET_BITS = 1 << 15         # positions of one bitmap


def candidate_sets(questions: DataFrame, index: DataFrame, q_col: str = "question", pos: str = "pos",
                   path: str = "path", subjects=SUBJECTS) -> DataFrame:
    """R4 as sets: ``(_mk, _sk, _jk, bucket, bitmap, n)``, the files that pass a combination of tests, as
    bitmaps of positions (bit b of bucket u stands for position u * SET_BITS + b), for every combination
    that some question asks.  Buckets without a file have no row; a combination without any passes nothing.

    Each single test (a module, a semester, a subject) becomes bitmaps by partial aggregates, whatever
    number of files passes it; a combination intersects the bitmaps of its tests.  Questions refer to a set by
    its combination, so no question meets a file.
    """
    at = F.col(pos)
    files = file_keys(index.select(at.cast("bigint").alias("_pos"), F.col(path).alias("_path")), "_path", subjects)
    test = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))
    passed = files.select("_pos", F.explode(F.concat(test("m", F.col("_mods")), test("s", F.col("_sems")), test("j", F.col("_subs")))).alias("t"))
    bucket = F.floor(F.col("_pos") / SET_BITS)
    single = passed.groupBy("t.kind", "t.value", bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("_pos", F.lit(SET_BITS))).alias("bitmap"))
    asked = question_keys(questions, q_col, subjects).select("_mk", "_sk", "_jk").filter(_has_filter()).distinct()
    tests = F.filter(F.array(
        F.when(F.col("_mk") != ANY_NUM, F.struct(F.lit("m").alias("kind"), F.col("_mk").cast("string").alias("value"))),
        F.when(F.col("_sk") != ANY_NUM, F.struct(F.lit("s").alias("kind"), F.col("_sk").cast("string").alias("value"))),
        F.when(F.col("_jk") != ANY_SUBJ, F.struct(F.lit("j").alias("kind"), F.col("_jk").alias("value")))), lambda t: t.isNotNull())
    each = asked.withColumn("_tests", tests).select("_mk", "_sk", "_jk", F.size("_tests").alias("_n"), F.explode("_tests").alias("_t")) \
                .select("_mk", "_sk", "_jk", "_n", F.col("_t.kind").alias("kind"), F.col("_t.value").alias("value"))
    both = each.join(single, ["kind", "value"]).groupBy("_mk", "_sk", "_jk", "bucket").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    return (both.filter(F.col("_c") == F.col("_n")).select("_mk", "_sk", "_jk", "bucket", "bitmap", F.bitmap_count("bitmap").alias("n"))
                .filter("n > 0"))


def set_positions(bucket: str = "bucket", bitmap: str = "bitmap") -> Column:
    """The positions that a bitmap of ``candidate_sets`` holds, ascending."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(bitmap), (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    full = F.filter(F.transform(F.sequence(F.lit(0), F.lit(SET_BITS // 8 - 1)), lambda i: F.struct(i.alias("i"), byte(i).alias("b"))),
                    lambda x: x["b"] > 0)
    bits = F.flatten(F.transform(full, lambda x: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(x["b"] / F.pow(F.lit(2), k)) % 2 == 1), lambda k: x["i"] * 8 + k)))
    return F.transform(bits, lambda b: F.col(bucket) * SET_BITS + b)


def candidate_summary(questions: DataFrame, index: DataFrame, q_id: str = "qid",
                      q_col: str = "question", pos: str = "pos", path: str = "path",
                      subjects=SUBJECTS) -> DataFrame:
    """R4 aggregated without listing pairs: ``(qid, n_candidates, first_pos, first_path, all_files)``.

    Files are grouped by key first (one row per key), so the join with the
    questions emits one row per question.
    """
    idx = index.select(F.col(pos).alias("pos"), F.col(path).alias("path"))
    per_key = (exploded_file_keys(idx, "path", subjects)
               .groupBy("_mk", "_sk", "_jk")
               .agg(F.count(F.lit(1)).alias("_n"), F.min_by("path", "pos").alias("_fp"),
                    F.min("pos").alias("_f")))
    # Totals over the whole index, as scalar subqueries (computed once).
    tn = idx.agg(F.count(F.lit(1))).scalar()
    tfp = idx.agg(F.min_by("path", "pos")).scalar()
    tf = idx.agg(F.min("pos")).scalar()
    qk = question_keys(questions, q_col, subjects).select(F.col(q_id).alias("qid"), "_mk", "_sk", "_jk")
    j = qk.join(per_key, ["_mk", "_sk", "_jk"], "left")
    all_files = (~_has_filter()) | F.col("_n").isNull()
    return j.select(
        "qid",
        F.when(all_files, tn).otherwise(F.col("_n")).alias("n_candidates"),
        F.when(all_files, tf).otherwise(F.col("_f")).alias("first_pos"),
        F.when(all_files, tfp).otherwise(F.col("_fp")).alias("first_path"),
        all_files.alias("all_files"))


def dispatch(classified: DataFrame, file_match: DataFrame | None, retrieval: DataFrame | None,
             q_id: str = "qid", category: str = "category") -> DataFrame:
    """One answer row per question by category.

    ``file_match``: ``(qid, path, link)`` for notes requests; ``retrieval``:
    ``(qid, answer, source_label, source_link, context, prompt)`` for notes
    questions.  Each branch is a filter; branches meet in a union.
    """
    base = classified.select(F.col(q_id).alias("qid"), "question",
                             F.when(F.col(category).isin("SMALL_TALK", "DIRECT_NOTES_REQUEST",
                                                         "NOTES_QUERY", "MISSING"), F.col(category))
                             .otherwise(F.lit("OTHER")).alias("category"))
    null_s = F.lit(None).cast("string")
    small = base.filter(F.col("category") == "SMALL_TALK").select(
        "qid", "question", "category", null_s.alias("answer"), null_s.alias("source_label"),
        null_s.alias("source_link"), null_s.alias("context"))
    other = base.filter(F.col("category").isin("OTHER", "MISSING")).select(
        "qid", "question", "category",
        F.when(F.col("category") == "MISSING", REPLY_MISSING).otherwise(REPLY_OTHER).alias("answer"),
        null_s.alias("source_label"), null_s.alias("source_link"), null_s.alias("context"))
    notes_req = base.filter(F.col("category") == "DIRECT_NOTES_REQUEST")
    if file_match is not None:
        fm = file_match.select(F.col(q_id).alias("qid"), F.col("path").alias("_p"), F.col("link").alias("_l"))
        notes_req = notes_req.join(fm, "qid", "left")
        found = F.nullif(F.col("_l"), F.lit("")).isNotNull()
        notes_req = notes_req.select(
            "qid", "question", "category",
            F.when(found, F.lit(REPLY_FOUND)).otherwise(F.lit(REPLY_NOT_FOUND)).alias("answer"),
            F.when(found, F.col("_p")).alias("source_label"),
            F.when(found, F.col("_l")).alias("source_link"), null_s.alias("context"))
    else:
        notes_req = notes_req.select("qid", "question", "category", F.lit(REPLY_NOT_FOUND).alias("answer"),
                                     null_s.alias("source_label"), null_s.alias("source_link"),
                                     null_s.alias("context"))
    notes_q = base.filter(F.col("category") == "NOTES_QUERY")
    if retrieval is not None:
        r = retrieval.select(F.col(q_id).alias("qid"), "answer", "source_label", "source_link", "context")
        notes_q = notes_q.join(r, "qid", "left")
    else:
        notes_q = notes_q.select("qid", "question", "category", null_s.alias("answer"),
                                 null_s.alias("source_label"), null_s.alias("source_link"),
                                 null_s.alias("context"))
    cols = ["qid", "question", "category", "answer", "source_label", "source_link", "context"]
    return (small.select(cols).unionByName(other.select(cols))
            .unionByName(notes_req.select(cols)).unionByName(notes_q.select(cols)))


def classify_questions(questions: DataFrame, q_col: str = "question") -> DataFrame:
    """R6 + T9: add ``category`` by the rule table."""
    return questions.withColumn("category", classify(q_col))
