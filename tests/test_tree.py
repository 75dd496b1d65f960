from pyspark.sql import functions as F

from docket.operators import tree as TR
from docket.sources import files as SRC


def index(spark, rows):
    return spark.createDataFrame([(i, p, l) for i, (p, l) in enumerate(rows)], "pos bigint, path string, link string")


def nodes(spark, rows):
    return {r.path: r for r in TR.library_tree(index(spark, rows)).collect()}


def test_tree_basic(spark):
    n = nodes(spark, [("A/x.pdf", "u1"), ("A/ B /y.pdf", "u2"), ("", "u3"), ("//", "u4")])
    assert set(n) == {"A", "A/B", "A/x.pdf", "A/B/y.pdf"}
    assert (n["A"].type, n["A/B"].type, n["A/B"].parent_path) == ("folder", "folder", "A")
    assert (n["A/B/y.pdf"].type, n["A/B/y.pdf"].link, n["A/B/y.pdf"].depth) == ("file", "u2", 3)
    assert not any(r.conflict for r in n.values())


def test_file_over_folder_keeps_children(spark):
    n = nodes(spark, [("A/x", "u1"), ("A", "u2")])
    assert (n["A"].type, n["A"].link, n["A"].conflict) == ("file", "u2", False)
    assert n["A/x"].parent_path == "A"


def test_folder_over_file_is_conflict(spark):
    n = nodes(spark, [("A", "u1"), ("A/x", "u2")])
    assert n["A"].conflict is True


def test_index_duplicate_keys(spark, tmp):
    p = f"{tmp}/idx.json"
    with open(p, "w") as f:
        f.write('{"b": "1", "a": "2", "b": "3"}')
    got = sorted(tuple(r) for r in SRC.scan_file_index(spark, p).collect())
    assert got == [(0, "b", "3"), (1, "a", "2")]
    assert SRC.scan_file_index(spark, f"{tmp}/missing.json").count() == 0


def test_folder_contents_and_json(spark):
    t = TR.library_tree(index(spark, [("A/x.pdf", "u1"), ("A/B/y.pdf", "u2"), ("C", "u3")]))
    assert sorted(r.name for r in TR.folder_contents(t, "A").collect()) == ["B", "x.pdf"]
    assert sorted(r.name for r in TR.folder_contents(t, None).collect()) == ["A", "C"]
    import json
    docs = {r.name: json.loads(r.json) for r in TR.tree_json(t).collect()}
    assert docs["A"]["children"]["B"]["children"]["y.pdf"]["link"] == "u2"
    assert docs["C"] == {"type": "file", "name": "C", "link": "u3"}


def test_folder_closure(spark):
    e = spark.createDataFrame([
        ("r", None, "root", True), ("f1", "r", "a:b.pdf", False), ("d", "r", "sub", True),
        ("f2", "d", "a/b.pdf", False), ("d2", "d", "deep", True), ("f3", "d2", "c.pdf", False),
        ("x", "y", "cyc1", True), ("y", "x", "cyc2", True), ("cy", None, "loop", True), ("x2", "cy", "in", True),
    ], "id string, parent_id string, name string, is_folder boolean")
    rows = {r.id: r for r in TR.folder_closure(e).collect()}
    assert set(rows) == {"f1", "f2", "f3"}
    assert rows["f3"].path == "root/sub/deep/c.pdf" and rows["f3"].depth == 4
    assert rows["f1"].safe_name == rows["f2"].safe_name == "a_b.pdf"
    # walk order: root's children by name: 'a:b.pdf' then 'sub' -> f2 is written last
    assert (rows["f1"].kept, rows["f2"].kept) == (False, True)
    cyc = spark.createDataFrame([("a", None, "a", True), ("b", "a", "b", True), ("a2", "b", "f", False)],
                                "id string, parent_id string, name string, is_folder boolean")
    assert TR.folder_closure(cyc).count() == 1


from hypothesis import given, settings
from hypothesis import strategies as st

_part = st.sampled_from(["a", "b", " c ", "", "d.pdf"])
_path = st.lists(_part, min_size=0, max_size=4).map("/".join)


@settings(max_examples=25, deadline=None)
@given(st.lists(_path, min_size=1, max_size=12))
def test_tree_properties(spark, paths):
    rows = [(i, p, "u%d" % i) for i, p in enumerate(paths)]
    t = {r.path: r for r in TR.library_tree(
        spark.createDataFrame(rows, "pos bigint, path string, link string")).collect()}
    # expected nodes and file ends from a direct walk
    entries, ends, nodes = {}, {}, set()
    for i, p in enumerate(paths):
        entries[p] = "u%d" % i          # a path given twice keeps its first place and its last link
    for p, link in entries.items():
        parts = [x.strip() for x in p.split("/") if x.strip()]
        for d in range(1, len(parts) + 1):
            nodes.add("/".join(parts[:d]))
        if parts:
            ends["/".join(parts)] = link
    assert set(t) == nodes
    for path, r in t.items():
        assert r.parent_path is None or r.parent_path in t
        assert r.type == ("file" if path in ends else "folder")
        assert r.link == ends.get(path)


def test_folder_closure_root_and_depth(spark):
    e = spark.createDataFrame([
        ("r", None, "root", True), ("d", "r", "sub", True), ("f1", "d", "a.pdf", False),
        ("d2", "d", "deep", True), ("f2", "d2", "b.pdf", False),
    ], "id string, parent_id string, name string, is_folder boolean")
    under_d = {r.id: r for r in TR.folder_closure(e, root="d").collect()}
    assert set(under_d) == {"f1", "f2"} and under_d["f2"].path == "deep/b.pdf" and under_d["f2"].depth == 2
    shallow = {r.id for r in TR.folder_closure(e, max_depth=3).collect()}
    assert shallow == {"f1"}


def test_tree_json_null_link_and_escaping(spark):
    import json
    t = TR.library_tree(index(spark, [('A/q"x.pdf', None), ("B", "u\\2")]))
    docs = {r.name: json.loads(r.json) for r in TR.tree_json(t).collect()}
    assert docs["A"]["children"]['q"x.pdf'] == {"type": "file", "name": 'q"x.pdf', "link": None}
    assert docs["B"]["link"] == "u\\2"


def test_folder_closure_is_not_cut_off(spark):
    rows = [(str(i), str(i - 1) if i else None, f"d{i}", True) for i in range(70)] + [("f", "69", "deep.pdf", False)]
    e = spark.createDataFrame(rows, "id string, parent_id string, name string, is_folder boolean")
    assert [(r.id, r.depth) for r in TR.folder_closure(e).collect()] == [("f", 71)]


def test_folder_closure_of_a_long_chain_takes_few_joins(spark, monkeypatch):
    written = []
    keep = TR.materialize
    monkeypatch.setattr(TR, "materialize", lambda df, name="": written.append(name) or keep(df, name))
    rows = [(i, i - 1 if i else None, f"d{i}", True) for i in range(1000)] + [(1000, 999, "deep.pdf", False), (1001, 3, "top.pdf", False)]
    e = spark.createDataFrame(rows, "id bigint, parent_id bigint, name string, is_folder boolean")
    got = {r.id: (r.depth, r.kept) for r in TR.folder_closure(e).collect()}
    assert got == {1000: (1001, True), 1001: (5, True)}
    assert written.count("paths") <= 11


def test_folder_closure_enters_a_cycle_once(spark):
    """A root inside a cycle: its own entry is met below it, and ends there."""
    e = spark.createDataFrame([("x", "a", "X", True), ("a", "x", "A", True), ("f", "a", "f.pdf", False), ("g", "x", "g.pdf", False)],
                              "id string, parent_id string, name string, is_folder boolean")
    assert sorted(r.path for r in TR.folder_closure(e, root="x").collect()) == ["A/X/g.pdf", "A/f.pdf", "g.pdf"]


def test_tree_json_pieces(spark, tmp):
    import json
    t = TR.library_tree(index(spark, [("A/x.pdf", "u1"), ("A/B/y.pdf", "u2"), ("A/B", "u3"), ("C", None)]))
    rows = sorted((r.name, r.ord, r.text) for r in TR.tree_json_rows(t).collect())
    whole = {n: "".join(x for m, _, x in rows if m == n) for n in ("A", "C")}
    assert whole == {r.name: r.json for r in TR.tree_json(t).collect()}
    assert json.loads(whole["A"])["children"]["B"]["children"]["y.pdf"]["link"] == "u2"
    # a folder of 100,000 children: short rows only
    many = spark.range(100_000).select(F.col("id").alias("pos"), F.format_string("big/%06d.pdf", "id").alias("path"), F.lit("u").alias("link"))
    TR.write_tree_json(TR.library_tree(many), f"{tmp}/json")
    text = "".join(r[0] for r in spark.read.text(f"{tmp}/json").withColumn("f", F.input_file_name()).withColumn(
        "i", F.monotonically_increasing_id()).orderBy("f", "i").select("value").collect())
    assert len(json.loads(text)["children"]) == 100_000
    assert TR.tree_json_rows(TR.library_tree(many)).agg(F.max(F.length("text"))).first()[0] < 100


def test_tree_json_query_gives_whole_documents(spark, tmp):
    import json
    from docket.plans import queries as Q
    rows = [(1, "http://a.com/x/1"), (2, "http://a.com/x/2"), (3, "http://a.com/y"), (4, "http://b.com/z"), (5, "http://a.com/x-1/q")]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp}/pages.parquet")
    df = Q.tree_json(spark, tmp)
    assert df.columns == ["name", "json"]
    docs = {r.name: json.loads(r.json) for r in df.collect()}
    assert set(docs) == {"a.com", "b.com"}
    assert docs["a.com"]["children"]["x"]["children"]["2.pdf"]["link"] == "http://a.com/x/2"
    assert list(docs["a.com"]["children"]) == ["x", "x-1", "y.pdf"]
