"""Question routing column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket.functions._util import col as _col
from docket.functions.text import WS


@dataclass(frozen=True)
class Subject:
    name: str
    keywords: tuple[str, ...]


# The subject map must equal the reference's for routing to agree.
# Order matters: the first subject with a matching keyword wins.
SUBJECTS: tuple[Subject, ...] = (
    Subject("os", ("os", "operating system", "deadlock", "scheduling", "paging")),
    Subject("dsa", ("dsa", "data structures", "stack", "queue", "trees", "graphs")),
    Subject("ddco", ("ddco", "digital logic", "logic gates", "microprocessor")),
    Subject("maths", ("math", "mathematics", "probability", "statistics", "regression")),
)

# The four category names and the fixed replies.
CATEGORIES = ("SMALL_TALK", "DIRECT_NOTES_REQUEST", "NOTES_QUERY", "OTHER", "MISSING")
REPLY_MISSING = "Question missing"
REPLY_NOT_FOUND = "Not in notes."
REPLY_FOUND = "Here are the notes."
REPLY_OTHER = "We are on an educational platform. Ask academic questions or request notes."


def extract_module(q) -> Column:
    """Number after 'module' (any case), else null."""
    digits = F.regexp_extract(_col(q), rf"(?i)module[{WS}]*[-_ ]*([0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def extract_semester(q) -> Column:
    """R2: number before an optional st/nd/rd/th and 'sem' (any case), else null."""
    digits = F.regexp_extract(_col(q), rf"(?i)([0-9]+)[{WS}]*(st|nd|rd|th)?[{WS}]*sem", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def extract_subject(q, subjects=SUBJECTS, word_boundary: bool = False) -> Column:
    """First subject, in rule order, with a keyword contained in the lower-cased text.

    By default a keyword matches inside a longer word ('those' holds 'os'), as
    in the reference; ``word_boundary=True`` asks for whole words instead.  The
    rules are configuration (a handful of rows), so they become one
    ``CASE WHEN`` expression instead of a join.
    """
    import re
    lq = F.lower(_col(q))
    out = None
    for s in subjects:
        cond = None
        for k in s.keywords:
            c = (lq.rlike(r"(?:^|[^a-z0-9_])" + re.escape(k) + r"(?:[^a-z0-9_]|\z)")
                 if word_boundary else lq.contains(k))
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(s.name)) if out is None else out.when(cond, F.lit(s.name))
    return out if out is not None else F.lit(None).cast("string")


# Our own rule table standing in for the remote classifier (R6).  Patterns are
# matched against the lower-cased question, first hit wins.
_B0 = r"(?:^|[^a-z0-9_])"   # explicit word edges: the same in every regex engine
_B1 = r"(?:[^a-z0-9_]|\z)"
CLASSIFY_RULES: tuple[tuple[str, str], ...] = (
    ("NOTES_QUERY", _B0 + r"(?:explain|what|why|how|define|definition|difference|describe|derive|"
                    r"solve|compare|summari[sz]e|list)" + _B1 + r"|\?[ \t\n\r]*\z"),
    ("DIRECT_NOTES_REQUEST", _B0 + r"(?:notes|pdf|syllabus|material|slides)" + _B1),
    ("SMALL_TALK", r"^[ \t\n\r]*(?:hi|hello|hey|thanks|thank you|good (?:morning|evening|night)|bye|ok|cool)"
                   + _B1),
)


def classify(q, rules=CLASSIFY_RULES) -> Column:
    """MISSING for a null or empty question, else category by rule table; nothing matching gives OTHER."""
    lq = F.lower(_col(q))
    out = F.when(F.coalesce(lq, F.lit("")) == "", F.lit("MISSING"))
    for cat, pat in rules:
        cond = lq.rlike(pat)
        out = out.when(cond, F.lit(cat))
    return out.otherwise(F.lit("OTHER"))
