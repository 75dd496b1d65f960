"""A page's html as a tree of blocks and text slots, for the wrappers of ``html_wrappers``.

Inline markup joins its text; every other element is a node, with end tags implied where html
leaves them out.  A node's key is its tag and a mark: ``!`` for tags that are never article text and
for names (class, id, role) of reader comments, ``?`` for other names that speak against it, ``*``
for names that speak of main content.
"""

from __future__ import annotations

import re
from html import unescape

# The html vocabulary.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math mfrac mi mn mo mrow msub "
                   "msup q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg canvas noframes".split())
HARD = frozenset("nav footer aside form button select menu dialog fieldset label".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer "
                     "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
          "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
# Words in class, id and role names.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                        "complementary consent contentinfo cookie cookies copyright dialog disqus footer form login masthead menu "
                        "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
                        "recommended related replies respond search share sharing sidebar signup social sponsor sponsored "
                        "subscribe subscription toolbar widget widgets".split())
TALK_WORDS = frozenset("comment comments disqus replies respond".split())
HEAD_WORDS = frozenset("header head topbar".split())
LAYOUT_WORDS = frozenset("has no with without".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
HOLDS_ALL = frozenset("html body article main".split())
DEEP = 200      # elements nested deeper than that add no node; their text goes to the node around

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _mark(tag: str, attrs: str, inside: bool) -> str:
    """The mark of an element; ``inside``: an article or main element is open around it."""
    if tag in HARD or (tag == "header" and not inside):
        return "!"
    if tag in HOLDS_ALL or not attrs:
        return ""
    mark = ""
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & LAYOUT_WORDS:
                continue
            if words & TALK_WORDS and not words & MAIN_WORDS:
                return "!"
            if words & ASIDE_WORDS or (not inside and words & HEAD_WORDS):
                return "?"
            if words & MAIN_WORDS:
                mark = "*"
    return mark


def read(html: str | None) -> tuple[list, list[str]]:
    """The page's tree, as nested ``[key, children]`` with an int for each text slot, and its texts
    (character references decoded, white space folded; none is empty)."""
    root: list = ["html", []]
    stack, texts, held = [root], [], []
    if not html:
        return root, texts
    n, at, inside = len(html), 0, 0
    over: list[str] = []                # open elements beyond DEEP
    spans: list[list] = []              # open inline nodes: depth, tag, inner elements of that tag
    quotes = True                       # whether quoted values may still be closed

    def end_block() -> None:
        if held:
            t = " ".join(unescape("".join(held)).split())
            held.clear()
            if t:
                stack[-1][1].append(len(texts))
                texts.append(t)

    def pop(to: int) -> None:
        nonlocal inside
        end_block()
        over.clear()
        while len(stack) > to:
            inside -= stack.pop()[0] in ("article", "main")
        while spans and spans[-1][0] >= to:
            spans.pop()

    def up(names, stop) -> int:
        """Depth of the nearest open element of ``names``, not looking past ``stop``; 0: none."""
        for d in range(len(stack) - 1, 0, -1):
            tag = stack[d][0].rstrip("!?*")
            if tag in names:
                return d
            if tag in stop:
                return 0
        return 0

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            held.append(html[at:])
            break
        if lt > at:
            held.append(html[at:lt])
        m = _TAG.match(html, lt)
        if m is None:                   # a bare < is text
            held.append("&lt;")
            at = lt + 1
            continue
        if m[1]:
            end = html.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag, start = m[4].lower(), m.end()
        stop = _ATTRS.match(html, start).end() if quotes else html.find(">", start)
        if quotes and (stop >= n or html[stop] != ">"):
            quotes = stop < n and html.find(html[stop], stop + 1) >= 0
            stop = html.find(">", start)
        if stop < 0:                    # an unfinished tag
            break
        at = stop + 1
        if m[3]:
            if tag in INLINE:
                if spans and spans[-1][1] == tag:
                    spans[-1][2] -= 1
                    if spans[-1][2] < 0:
                        pop(spans[-1][0])
            elif tag in over:
                end_block()
                del over[len(over) - 1 - over[::-1].index(tag):]
            elif d := up({tag}, ()):
                pop(d)
            continue
        attrs = html[start:stop]
        if tag in RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = n if end < 0 else end + 1
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                d = up({"p"}, HOLDS_ALL)
                pop(d) if d else end_block()
            continue
        mark = _mark(tag, attrs, inside > 0)
        if tag in INLINE and mark not in ("!", "?"):
            if spans and spans[-1][1] == tag:
                spans[-1][2] += 1
            continue
        end_block()
        if tag in ("html", "head"):
            continue
        if tag in CLOSES_P and (d := up({"p"}, HOLDS_ALL)):
            pop(d)
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            while d := up(names, stops):
                pop(d)
        if len(stack) > DEEP:
            over.append(tag)
            continue
        node: list = [tag + mark, []]
        stack[-1][1].append(node)
        if tag in INLINE:
            spans.append([len(stack), tag, 0])
        stack.append(node)
        inside += node[0] in ("article", "main")
    end_block()
    return root, texts
