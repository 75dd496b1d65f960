"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page's tree (``page_tree``) is folded: neighbours of one key, and sequences that repeat,
become repeated groups.  The folded pages of a host are aligned one after the other: equal keys
merge (and their children align in turn), a key that one side lacks becomes optional, texts
become slots.  What results is a wrapper: a regular expression of tags, slots, ``?`` and ``+``,
without alternatives, that matches every page it was made of.

The wrapper, with the text that its slots hold on all pages of the host, tells where the article
is: in the ``article`` element with most text, else the main element, else the container that
holds most of what is not marked as menu, footer, advert and so on.  Slots in marked parts go, as do
single slots (other than headings and paragraphs) that hold the same text on many pages of the host beside others
that vary.  A page of a shape without that part is judged on its own.

Pages of one host and folded shape share one row before anything is grouped; the shapes of
a host are merged in groups of bounded size, round by round, so a host may hold any share of
the pages.  Pages meet the slots to keep by host and shape; html is not shuffled unless that table
outgrows Spark's broadcast threshold.

Defined results: a null or empty html has an empty text; a null url, or one without ``://``, has
the empty host; texts of any length are read whole; rows that repeat repeat their result; a null
page id is kept; an empty table gives an empty table; columns named like the added ones are
replaced.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import Scratch, ready
from docket.llm.page_tree import read

PERIOD = 4          # longest sequence folded as one repeated group
WIDE = 150          # more children than that become one group matched in any order
FAN = 128           # wrappers merged in one task
SHARE, ENOUGH = 0.6, 0.25
STATIC_PAGES = 8    # a text on at least so many pages of a host, and no other there, is the host's
MIXED = "(*)"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
OWN = (*HEADINGS, "p")      # blocks of prose: never taken for text of the host


# Wrapper nodes are lists: [key, repeated, optional, children], a slot [SLOT, repeated, optional,
# [chars, pages, low, high, own]]: characters, pages, smallest and greatest checksum of its texts,
# and while one page is folded the numbers of its texts.
SLOT = "#"


def _merge(a: list, b: list) -> list:
    """Two nodes of one key as one."""
    if a[0] == SLOT:
        (c, n, lo, hi, own), (c2, n2, lo2, hi2, more) = a[3], b[3]
        own.extend(more)
        kids: list = [c + c2, n + n2, min(lo, lo2), max(hi, hi2), own]
    elif a[0] == MIXED:
        kids = _mixed(a[3] + b[3])
    else:
        kids = _align(a[3], b[3])
    return [a[0], a[1] or b[1], a[2] or b[2], kids]


def _mixed(kids: list) -> list:
    by: dict[str, list] = {}
    for k in kids:
        by[k[0]] = _merge(by[k[0]], k) if k[0] in by else k
    return sorted(by.values(), key=lambda k: k[0])


def _wide(kids: list) -> list:
    if len(kids) <= WIDE and not any(k[0] == MIXED for k in kids):
        return kids
    return [[MIXED, True, True, _mixed(_opened(kids))]]


def _opened(kids: list) -> list:
    """The members of all groups, however nested."""
    return [x for k in kids for x in (_opened(k[3]) if k[0][0] == "(" else [k])]


def _grouped(kids: list, groups: list) -> list:
    """Single occurrences of the other side's repeated groups, taken as groups."""
    for g in groups:
        keys = [k[0] for k in g[3]]
        m, i = len(keys), 0
        while i + m <= len(kids):
            if [k[0] for k in kids[i:i + m]] == keys:
                kids = kids[:i] + [[g[0], False, False, kids[i:i + m]]] + kids[i + m:]
            i += 1
    return kids


def _common(a: list, b: list, each: int = 1) -> tuple[list, object]:
    """Table of the best common sequences of two lists of nodes from any two places on; a pair of one
    key gains ``each``, and the more the more text both hold."""
    ca, cb = [_chars(x) for x in a], [_chars(x) for x in b]

    def gain(i: int, j: int) -> int:
        return each + min(ca[i], cb[j]).bit_length() if a[i][0] == b[j][0] else 0

    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        here, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            here[j] = max(below[j], here[j + 1], below[j + 1] + gain(i, j))
    return best, gain


def _align(a: list, b: list) -> list:
    """The children of two nodes as one sequence; what one side lacks becomes optional."""
    ka, kb = [x[0] for x in a], [x[0] for x in b]
    if ka != kb:
        if MIXED in ka or MIXED in kb:
            return _wide(a + b)
        a = _grouped(a, [x for x in b if x[0][0] == "(" and x[0] not in ka])
        b = _grouped(b, [x for x in a if x[0][0] == "(" and x[0] not in kb])
        ka, kb = [x[0] for x in a], [x[0] for x in b]
    if ka == kb:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    best, gain = _common(a, b)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and gain(i, j) and best[i][j] == best[i + 1][j + 1] + gain(i, j):
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], a[i][1], True, a[i][3]])
            i += 1
        else:
            out.append([b[j][0], b[j][1], True, b[j][3]])
            j += 1
    return _wide(out)


def _fold(kids: list) -> list:
    """Neighbours of one key, then sequences of up to ``PERIOD`` keys that repeat, become one."""
    out: list = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1] = _merge(out[-1], k)
            out[-1][1] = True
        else:
            out.append(k)
    for m in range(2, PERIOD + 1):
        i, done = 0, []
        while i < len(out):
            keys = [k[0] for k in out[i:i + m]]
            j = i + m
            while len(keys) == m and [k[0] for k in out[j:j + m]] == keys:
                j += m
            if j > i + m:
                group = out[i:i + m]
                for at in range(i + m, j, m):
                    group = [_merge(x, y) for x, y in zip(group, out[at:at + m], strict=True)]
                done.append([f"({' '.join(keys)})", True, False, group])
                i = j
            else:
                done.append(out[i])
                i += 1
        out = done
    return _wide(out)


def _wrapper(node: list, texts: list[str]) -> list:
    """A page's tree as a folded wrapper of its own."""
    kids = []
    for k in node[1]:
        if isinstance(k, int):
            crc = zlib.crc32(texts[k].encode("utf-8", "surrogatepass"))
            kids.append([SLOT, False, False, [len(texts[k]), 1, crc, crc, [k]]])
        else:
            kids.append(_wrapper(k, texts))
    return [node[0], False, False, _fold(kids)]


def _slots(w: list) -> Iterator[list]:
    """The slots of a wrapper in order."""
    if w[0] == SLOT:
        yield w
    else:
        for k in w[3]:
            yield from _slots(k)


def _match(page: list, w: list, out: dict[int, list]) -> None:
    """Match a folded page with its host's wrapper: id of each of its slots -> the wrapper's slot."""
    if page[0] == SLOT:
        out[id(page)] = w
        return
    kids, wk = page[3], w[3]
    if [k[0] for k in kids] != [k[0] for k in wk]:
        if wk and wk[0][0] == MIXED:
            kids = _opened(kids)
        else:
            kids = _grouped(kids, [x for x in wk if x[0][0] == "(" and x[0] not in {k[0] for k in kids}])
    for k, x in zip(kids, _lcs(kids, wk), strict=True):
        if x is not None:
            _match(k, x, out)


def _lcs(kids: list, wk: list) -> list:
    """The wrapper child for every child of a page, by longest common sequence of keys."""
    if wk and wk[0][0] == MIXED and not (kids and kids[0][0] == MIXED):        # kids hold no groups here
        by = {k[0]: k for k in wk[0][3]}
        return [by.get(k[0]) for k in kids]
    if [k[0] for k in kids] == [k[0] for k in wk]:
        return wk
    best, gain = _common(kids, wk, 1 << 20)        # all children first: the wrapper holds them in order
    out, i, j = [], 0, 0
    while i < len(kids):
        if j < len(wk) and gain(i, j) and best[i][j] == best[i + 1][j + 1] + gain(i, j):
            out.append(wk[j])
            i, j = i + 1, j + 1
        elif j == len(wk) or best[i + 1][j] >= best[i][j + 1]:
            out.append(None)
            i += 1
        else:
            j += 1
    return out


# -- where the article is -----------------------------------------------------------------------

def _tag(w: list) -> str:
    return w[0].rstrip("!?*")


def _any(w: list, test) -> bool:
    return test(w) or (w[0] != SLOT and any(_any(k, test) for k in w[3]))


def _chars(w: list, marked=lambda k: False) -> int:
    if w[0] == SLOT:
        return w[3][0]
    return sum(_chars(k, marked) for k in w[3] if not marked(k))


def article_slots(root: list) -> set[int]:
    """Ids of the slots of a wrapper that hold article text."""
    total = _chars(root)

    def marked(k: list) -> bool:
        """Not article: by its tag; by its name, unless it holds the title or most of the text."""
        if k[0] == SLOT or k[0][0] == "(":
            return False
        if k[0][-1] == "!":
            return True
        return k[0][-1] == "?" and not (_any(k, lambda x: x[0] in ("main", "h1")) or _chars(k) > SHARE * total)

    open_chars = lambda k: 0 if marked(k) else _chars(k, marked)

    def topmost(w: list, test) -> list:
        if w[0] == SLOT or marked(w):
            return []
        return [w] if test(w) else [x for k in w[3] for x in topmost(k, test)]

    def heaviest(test):
        got = topmost(root, test)
        big = max(got, key=open_chars, default=None)
        return big if big is not None and open_chars(big) > ENOUGH * open_chars(root) else None

    region = heaviest(lambda w: _tag(w) == "article") or heaviest(lambda w: _tag(w) == "main") or heaviest(
        lambda w: w[0][-1] == "*")
    if region is None:
        region = root
        while region[0] != SLOT:
            boxes = [k for k in region[3] if k[0] != SLOT and (k[0][0] == "(" or _any(k, _is_box))]
            big = max(boxes, key=open_chars, default=None)
            if big is None or open_chars(big) < SHARE * open_chars(region) or not open_chars(big):
                break
            region = big

    kept: list[tuple[list, str, bool]] = []

    def walk(w: list, parent: str, again: bool) -> None:
        if w[0] == SLOT:
            kept.append((w, parent, again or w[1]))
        elif not marked(w):
            for k in w[3]:
                walk(k, _tag(w), again or w[1])

    walk(region, "", False)
    varies = any(s[3][2] != s[3][3] for s, _, _ in kept)
    same = lambda s, parent, again: (varies and not again and parent not in OWN and s[3][1] >= STATIC_PAGES
                                     and s[3][2] == s[3][3])
    return {id(s) for s, parent, again in kept if not same(s, parent, again)}


def _is_box(k: list) -> bool:
    """A container of blocks rather than a block of text."""
    return k[0] != SLOT and any(x[0] != SLOT for x in k[3]) and _tag(k) not in ("p", "ul", "ol", "dl", "table", *HEADINGS)


# -- on tables ----------------------------------------------------------------------------------

def _shape(w: list) -> list:
    return [w[0], int(w[1]), int(w[2])] + ([] if w[0] == SLOT else [[_shape(k) for k in w[3]]])


def _restore(shape: list, stats: Iterator) -> list:
    """A folded page's wrapper from its shape and the statistics of its slots in order."""
    if shape[0] == SLOT:
        return [SLOT, bool(shape[1]), bool(shape[2]), [*next(stats), []]]
    return [shape[0], bool(shape[1]), bool(shape[2]), [_restore(k, stats) for k in shape[3]]]


def _page(html: str | None) -> tuple[str, list, list[str], list[int]]:
    """Shape, wrapper, texts, and for each text its slot's number."""
    root, texts = read(html)
    w = _wrapper(root, texts)
    own = [0] * len(texts)
    for i, s in enumerate(_slots(w)):
        for t in s[3][4]:
            own[t] = i
    return json.dumps(_shape(w), separators=(",", ":")), w, texts, own


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def infer(pages: DataFrame, url: str = "url", html: str = "html", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``(host, wrapper)``, one per host, as JSON; and ``(host, key, keep)``: for every folded shape
    that the host's pages have (its MD5), which of its slots hold article text."""
    spark = ready(pages.sparkSession)
    scratch = scratch or Scratch(spark, "wrappers")

    @F.arrow_udf("struct<shape string, slots array<struct<chars bigint, crc bigint, crc2 bigint>>>")
    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            shapes, slots, ends = [], [], [0]
            for x in arr:
                shape, w, _, _ = _page(x.as_py())
                shapes.append(shape)
                slots += [(s[3][0], s[3][2], s[3][3]) for s in _slots(w)]
                ends.append(len(slots))
            item = pa.StructArray.from_arrays([pa.array([s[i] for s in slots], pa.int64()) for i in range(3)],
                                              ["chars", "crc", "crc2"])
            yield pa.StructArray.from_arrays([pa.array(shapes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item)],
                                             ["shape", "slots"])

    read_ = pages.select(host_of(url).alias("host"), fold(F.col(html)).alias("p"))
    read_ = read_.select("host", F.md5("p.shape").alias("key"), "p.shape", F.posexplode_outer("p.slots").alias("i", "s"))
    each = read_.groupBy("host", "key", "i").agg(
        F.min(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("shape"))).alias("shape"), F.sum("s.chars").alias("chars"),
        F.count(F.lit(1)).alias("n"), F.min("s.crc").alias("lo"), F.max("s.crc2").alias("hi"))
    shapes = scratch.table(each.groupBy("host", "key").agg(
        F.min("shape").alias("shape"),
        F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "chars", "n", "lo", "hi")))).alias("slots")))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in pdf.sort_values(["order", "wrapper"])["wrapper"]:
            w = json.loads(w)
            whole = w if whole is None else _merge(whole, w)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "order": [pdf["order"].min()], "wrapper": [json.dumps(whole)]})

    @F.pandas_udf("string")
    def restore(shape: pd.Series, slots: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(_restore(json.loads(s), ((r["chars"], r["n"], r["lo"], r["hi"]) for r in x)))
                          for s, x in zip(shape, slots, strict=True)])

    level = shapes.select("host", F.col("key").alias("order"), restore("shape", "slots").alias("wrapper"))
    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    path = None
    while True:
        groups = -(-most // FAN)
        dealt = level.withColumn("part", F.pmod(F.xxhash64("order"), F.lit(max(1, groups))))
        level, new = scratch.write(dealt.groupBy("host", "part").applyInPandas(join, "host string, order string, wrapper string"))
        scratch.drop(path)
        path = new
        if groups <= 1:
            break
        most = groups
    wrappers = level.select("host", "wrapper")

    @F.pandas_udf("array<boolean>")
    def keep(shape: pd.Series, slots: pd.Series, wrapper: pd.Series) -> pd.Series:
        got, last, host = [], None, None
        for s, x, text in zip(shape, slots, wrapper, strict=True):
            if text != last:
                last, host = text, json.loads(text)
                chosen = article_slots(host)
            page = _restore(json.loads(s), ((r["chars"], r["n"], r["lo"], r["hi"]) for r in x))
            to: dict[int, list] = {}
            _match(page, host, to)
            own = list(_slots(page))
            flags = [id(to[id(p)]) in chosen if id(p) in to else None for p in own]
            if None in flags or True not in flags:          # no such part on this page: judged on its own
                mine = article_slots(page)
                flags = [id(p) in mine if f is None or True not in flags else f for p, f in zip(own, flags, strict=True)]
            got.append(flags)
        return pd.Series(got)

    kept = scratch.table(shapes.join(wrappers, "host").select("host", "key", keep("shape", "slots", "wrapper").alias("keep")))
    return wrappers, kept


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """Add ``text``: the blocks of the article, in page order, joined by an empty line."""
    _, kept = infer(pages, url, html)

    @F.arrow_udf("struct<key string, slots array<int>, blocks array<string>>")
    def blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            shapes, slots, found, ends = [], [], [], [0]
            for x in arr:
                shape, _, texts, own = _page(x.as_py())
                shapes.append(shape)
                slots += own
                found += texts
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.array(shapes, pa.string()), pa.ListArray.from_arrays(ends, pa.array(slots, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(found, pa.string()))], ["key", "slots", "blocks"])

    own = [c for c in pages.columns if c != text]
    rows = (pages.select(*own, host_of(url).alias("__host"), blocks(F.col(html)).alias("__b"))
                 .withColumn("__key", F.md5("__b.key")))
    found = rows.join(kept.select(F.col("host").alias("__host"), F.col("key").alias("__key"), F.col("keep").alias("__keep")),
                      ["__host", "__key"], "left")
    article = F.filter("__b.blocks", lambda _, i: F.get("__keep", F.get("__b.slots", i)))
    return found.select(*own, F.coalesce(F.array_join(article, "\n\n"), F.lit("")).alias(text))
