"""Main text of pages: made pages of known text, wrappers that match what they were made of, edges."""

import html as H
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docket.llm import html_wrappers as W
from docket.llm import queries
from docket.llm.page_tree import read
from tests.conftest import SF001


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "Ökonom", "x<y", "a&b", "“q”", "naïve"]) for _ in range(n))


def made(rnd, i, kind):
    """A page and its article's blocks; ``kind`` is the layout of a host."""
    esc = lambda t: H.escape(t, quote=False)
    more = lambda rnd, n: esc(words(rnd, n))
    title = words(rnd, 6) + f" {i}"
    body, want = [], [title]
    for _ in range(rnd.randrange(2, 7)):
        t = words(rnd, rnd.randrange(20, 60)) + f" {i}"
        want.append(t)
        body.append(rnd.choice(["<p>{}</p>", "<p class='lead'>{}", "<p><b>{}</b></p>", "<blockquote><p>{}</p></blockquote>"]).format(esc(t)))
        if rnd.random() < .3:
            sub, items = words(rnd, 3), [words(rnd, 4) for _ in range(rnd.randrange(1, 4))]
            want += [sub, *items]
            body.append(f"<h2>{esc(sub)}</h2><ul>" + "".join(f"<li><span>{esc(x)}</span>" for x in items) + "</ul>")
    noise = {
        "nav": f"<nav><ul><li><a href='/'>Home {i}</a><li><a>News</a></ul></nav>",
        "notice": "<div class='cookie-notice'>We use cookies. <button>OK</button></div>",
        "ad": f"<div class='ad'>Buy {more(rnd, 8)}<span>now</span></div>",
        "side": f"<aside><h3>More</h3><p>{more(rnd, 30)}</p></aside>",
        "bar": f"<div id='sidebar'><p>{more(rnd, 30)}</p><p>{more(rnd, 10)}</p></div>",
        "form": "<form action='/s'><label>Mail</label><input name=a><textarea>text</textarea></form>",
        "comments": f"<section class='comments'><h2>Comments</h2><article><p>{more(rnd, 90)}</p></article><p>{more(rnd, 40)}</p></section>",
        "script": "<script>if (a < b) document.write('<p>no</p>');</script><style>p{}</style><!-- <p>no</p> -->",
        "foot": f"<footer><p>&copy; {i} somebody, {more(rnd, 10)}</p></footer>"}
    some = lambda *names: "".join(noise[n] for n in names if rnd.random() < .7)
    text = f"<h1>{esc(title)}</h1>" + "".join(x + (noise["ad"] if rnd.random() < .2 else "") for x in body)
    inner = {"article": f"<header><h1>Site</h1></header><article>{text}{some('form', 'script')}</article>",
             "main": f"<header>Site</header><main><div>{text}</div></main>",
             "named": f"<div class='header'>Site</div><div id=page><div class='post-content has-sidebar'>{text}</div>{some('bar')}</div>",
             "plain": f"<div><div>Site</div><div><div>{text}</div></div></div>"}[kind]
    page = (f"<!DOCTYPE html><html><head><title>{esc(title)}</title>{noise['script']}</head><body>{some('nav', 'notice', 'ad')}{inner}"
            f"{some('side', 'bar', 'comments', 'form')}{noise['foot']}" + ("</body></html>" if rnd.random() < .5 else ""))
    return page, "\n\n".join(" ".join(w.split()) for w in want)


def test_made_pages(spark):
    rnd = random.Random(4)
    rows = []
    for kind in ("article", "main", "named", "plain"):
        rows += [(f"{kind}-{i}", f"http://{kind}.example/{i}", *made(rnd, i, kind)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, want string")
    got = W.extract(df).collect()
    assert [r["page_id"] for r in got if r["text"] != r["want"]] == []


def test_wrappers_match_what_they_were_made_of():
    rnd = random.Random(9)
    pages = [W._page(made(rnd, i, rnd.choice(["article", "plain"]))[0]) for i in range(80)]
    whole = None
    for _, w, _, _ in pages:
        whole = w if whole is None else W._merge(whole, w)
    found = slots = 0
    for shape, w, texts, own in pages:
        to: dict = {}
        W._match(w, whole, to)
        found += sum(id(s) in to for s in W._slots(w))
        slots += len(list(W._slots(w)))
        assert sorted(set(own)) == list(range(len(list(W._slots(w)))))
        assert W._shape(W._restore(json.loads(shape), (s[3][:4] for s in W._slots(w)))) == json.loads(shape)
    assert found > .98 * slots          # grouping may hide a rare one, which is then judged on its own
    assert sum(s[3][0] for s in W._slots(whole)) == sum(len(t) for _, _, texts, _ in pages for t in texts)


@pytest.mark.parametrize("html,tree,texts", [
    ("<p>a<p>b<div>c</div>d", [["p", [0]], ["p", [1]], ["div", [2]], 3], ["a", "b", "c", "d"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", [["ul", [["li", [0, ["ul", [["li", [1]]]]]], ["li", [2]]]]], ["a", "b", "c"]),
    ("a &lt;b&gt; &amp;amp;  <i>c</i>d<br>e", [0], ["a <b> &amp; cd e"]),
    ("x<span class='ad'><span>y</span>z</span>w", [0, ["span?", [1]], 2], ["x", "yz", "w"]),
    ("1 < 2 <a title='>'>t</a> <p title=\"un>q</p>r", [0, ["p", [1]], 2], ["1 < 2 t", "q", "r"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", [["table", [["tr", [["td", [0]], ["td", [1]]]], ["tr", [["td", [2]]]]]]], ["a", "b", "c"]),
    ("<SCRIPT>a</script><!-- b --><style>c", [], []), ("", [], []), (None, [], []), ("text</p></div>more", [0], ["textmore"])])
def test_reading(html, tree, texts):
    assert read(html) == (["html", tree], texts)


def test_deep_wide_and_long_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>"
    tags = ["section", "p", "h2", "h3", "table", "ul", "pre", "dl"]
    rnd = random.Random(1)
    wide = "".join(f"<{t}>{i}</{t}>" for i, t in enumerate(rnd.choice(tags) for _ in range(3000)))
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(i, "http://h/", x) for i, x in enumerate([deep, wide, long])], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in W.extract(df).collect()}
    assert got[0] == "deep\n\nafter" and got[1].split("\n\n") == [str(i) for i in range(3000)]
    assert got[2].count("word word") == 50_000


def test_edges(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.example/x", "<article><p>t</p></article>"),
            (3, "http://A.example/x", "<article><p>t</p></article>"), (None, "http://a.example", "<nav>n</nav>"), (4, "http://a.example", "plain")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("text", F.lit("mine")).withColumn("host", F.lit("h")) \
              .withColumn("key", F.lit(0))
    got = sorted(((r["page_id"] or 0, r["text"]) for r in W.extract(df).collect()))
    assert got == [(0, ""), (1, ""), (2, ""), (3, "t"), (3, "t"), (4, "plain")]
    assert W.extract(df.limit(0)).count() == 0
    hosts = [("http://A.Bé.x:8/p", "a.bé.x:8"), ("://q?x", "q"), ("a://b://c", "b:"), ("//x", ""), (None, "")]
    made_ = spark.createDataFrame([(u,) for u, _ in hosts], "u string").select(W.host_of("u")).collect()
    assert [r[0] for r in made_] == [h for _, h in hosts]


def test_host_of_many_shapes_is_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 4)
    rnd = random.Random(6)
    rows = [(i, "http://one.example/", *made(rnd, i, "article")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, want string")
    wrappers, kept = W.infer(df)
    assert wrappers.count() == 1 and kept.count() > 16
    assert W.extract(df).filter("text <> want").count() == 0


def test_query_on_the_given_pages(spark):
    """The given pages hold their text in one article element of headings and paragraphs."""
    src = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    for r in queries.op13_html(spark, SF001).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", src[r["page_id"]])[1]
        blocks = [" ".join(H.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h\d)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
