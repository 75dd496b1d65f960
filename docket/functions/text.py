"""Text column functions (Column -> Column), all JVM-side.

Lengths and substrings count code points, not UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket.functions._util import col as _col

# Whitespace as a script-language regex understands ``\s`` (Java's ``\s`` is ASCII only).
WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Line terminators as a script-language regex understands ``.`` and ``^``/``$`` with m.
NL = r"\n\r\u2028\u2029"


def trim_js(c) -> Column:
    """Remove leading and trailing whitespace of every kind (not just spaces)."""
    return F.regexp_replace(_col(c), rf"^[{WS}]+|[{WS}]+\z", "")


def is_blank(c) -> Column:
    """True for null or whitespace-only text."""
    c = _col(c)
    return c.isNull() | ~c.rlike(rf"[^{WS}]")


def collapse_ws(c, repl: str = " ") -> Column:
    return F.regexp_replace(_col(c), rf"[{WS}]+", repl)


def clean_context(c) -> Column:
    """Keep printable ASCII and newline, squeeze whitespace runs to one space, trim."""
    kept = F.regexp_replace(_col(c), r"[^\x20-\x7E\n]", "")
    return F.trim(F.regexp_replace(kept, r"[ \n]+", " "))


def snippet(c, n: int = 300) -> Column:
    """First ``n`` characters with whitespace runs made single spaces."""
    return collapse_ws(F.substring(F.coalesce(_col(c), F.lit("")), 1, n))


def ellipsis(c, n: int = 60) -> Column:
    """Cut to ``n`` characters and mark the cut."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def strip_extension(c) -> Column:
    """T4: drop one final ``.pdf`` in any letter case."""
    return F.regexp_replace(_col(c), r"(?i)\.pdf\z", "")


def safe_filename(c) -> Column:
    """T5: runs of characters a file system refuses become one underscore."""
    return F.regexp_replace(_col(c), r'[\\/:"*?<>|]+', "_")


def render_answer(c) -> Column:
    """Light markup to HTML, in the fixed order bold, bullets, numbered items,
    list wrapping, paragraph breaks, line breaks, trim.  Null or empty gives ''."""
    line = rf"[^{NL}]"
    bol = rf"(?<![^{NL}])"   # at start of input or after a line terminator
    eol = rf"(?![^{NL}])"    # at end of input or before a line terminator
    s = F.coalesce(_col(c), F.lit(""))
    s = F.regexp_replace(s, rf"\*({line}*?)\*", "<strong>$1</strong>")
    s = F.regexp_replace(s, rf"{bol}\* ({line}*){eol}", "<li>$1</li>")
    s = F.regexp_replace(s, rf"{bol}[0-9]+\. ({line}*){eol}", "<li>$1</li>")
    s = F.regexp_replace(s, r"(<li>[\s\S]*?</li>)", "<ul>$1</ul>")
    s = F.regexp_replace(s, r"\n{2,}", "<br><br>")
    s = F.regexp_replace(s, r"\n", "<br>")
    return trim_js(s)


def content_id(name, doc_index, chunk_id, text) -> Column:
    """SHA-1 hex of name, document position, chunk position and chunk text,
    concatenated with no separator."""
    return F.sha1(F.concat(_col(name), _col(doc_index).cast("string"),
                           _col(chunk_id).cast("string"), _col(text)))


def _quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def tag_runs(c, tag: str) -> Column:
    """Every text run between ``<tag>`` and ``</tag>`` on one line, shortest first."""
    t = _quote(tag)
    return F.regexp_extract_all(_col(c), F.lit(rf"<{t}>([^{NL}]*?)</{t}>"), F.lit(1))


def normalize_reply(c) -> Column:
    """Trim and upper-case a category reply."""
    return F.upper(trim_js(c))


def doc_name(*cols) -> Column:
    """First non-empty of the given name columns, else 'unknown'."""
    return F.coalesce(*[F.nullif(_col(c).cast("string"), F.lit("")) for c in cols],
                      F.lit("unknown"))


def base_name(c) -> Column:
    """The part after the last slash or backslash."""
    return F.regexp_extract(_col(c), r"([^\\/]*)\z", 1)


def file_url(name, base: str = "http://localhost:3000/files/") -> Column:
    """Base URL followed by the file name."""
    return F.concat(F.lit(base), _col(name))


def js_or(c, default: str) -> Column:
    """``c || default`` for a string: null and '' both take the default."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))
