"""Library tree from a path -> link index (H1), folder contents (H3), folder walk
(H2) and nested JSON export (K4).

The tree is an adjacency table ``(path, parent_path, depth, name, type, link,
conflict)``: one row per node.  Node rules, over entries in index order:
- a path is split on '/', parts trimmed, empty parts dropped; empty paths skipped;
- the last part of an entry is a file carrying the entry's link, the others are folders;
- a node any entry ends at is a file; the last such entry's link wins; children are kept;
- ``conflict`` marks a node first created as a file that a later entry passes
  through (the point where the reference's tree builder fails).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.functions.text import safe_filename, trim_js
from docket.session import materialize


def index_entries(index: DataFrame, pos: str = "pos", path: str = "path", link: str = "link") -> DataFrame:
    """One entry per distinct path: first position, last link (object-key semantics)."""
    return index.groupBy(F.col(path).alias("path")).agg(
        F.min(pos).alias("pos"), F.max_by(link, pos).alias("link"))


def library_tree(index: DataFrame, pos: str = "pos", path: str = "path", link: str = "link") -> DataFrame:
    """H1.  All aggregates are partial, so a folder shared by many entries costs
    one row per map task before the shuffle."""
    e = index_entries(index, pos, path, link)
    parts = F.filter(F.transform(F.split(F.col("path"), "/"), lambda p: trim_js(p)), lambda p: p != "")
    e = e.filter(F.col("path").isNotNull() & (F.col("path") != "")).withColumn("_parts", parts)
    e = e.filter(F.size("_parts") > 0)
    nodes = e.select("pos", "link", F.size("_parts").alias("_n"),
                     F.posexplode("_parts").alias("_i", "name"), "_parts")
    nodes = nodes.select(
        "pos", "link", "name",
        F.array_join(F.slice("_parts", 1, F.col("_i") + 1), "/").alias("node"),
        F.when(F.col("_i") > 0, F.array_join(F.slice("_parts", 1, F.col("_i")), "/")).alias("parent_path"),
        (F.col("_i") + 1).cast("bigint").alias("depth"),
        (F.col("_i") + 1 == F.col("_n")).alias("_end"))
    g = nodes.groupBy("node").agg(
        F.first("name").alias("name"), F.first("parent_path").alias("parent_path"),
        F.first("depth").alias("depth"),
        F.bool_or("_end").alias("_file"),
        F.max_by(F.when(F.col("_end"), F.col("link")),
                 F.when(F.col("_end"), F.col("pos")).otherwise(F.lit(None))).alias("_link"),
        F.min_by("_end", "pos").alias("_first_end"),
        F.bool_or(~F.col("_end")).alias("_through"))
    return g.select(
        F.col("node").alias("path"), "parent_path", "depth", "name",
        F.when(F.col("_file"), F.lit("file")).otherwise(F.lit("folder")).alias("type"),
        F.when(F.col("_file"), F.col("_link")).alias("link"),
        (F.col("_first_end") & F.col("_through")).alias("conflict"))


def folder_contents(nodes: DataFrame, path: str | None) -> DataFrame:
    """H3: direct children of ``path`` (None: the top level)."""
    cond = F.col("parent_path").isNull() if path is None else (F.col("parent_path") == path)
    return nodes.filter(cond)


def folder_closure(entries: DataFrame, root=None, max_depth: int | None = None,
                   id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name",
                   folder_col: str = "is_folder") -> DataFrame:
    """H2: every file under ``root`` (None: entries without a parent), walked
    depth-first with siblings ordered by (name, id), as
    ``(id, path, depth, safe_name, kept)``.

    All files land in one flat folder under their safe name (T5), so among
    equal safe names the one written last in walk order is ``kept``.  A node
    already on its own ancestor path is not entered again, which ends every walk;
    ``max_depth`` stops it earlier on request.

    Plan: pointer doubling over parent ids.  Every entry starts as a path of one step that points to
    its parent; in a round each path that is not yet at the root is joined to the paths that its
    pointer names, so steps double, and a tree of depth d takes about log2(d) rounds of two equi-joins
    (each written to the checkpoint folder).  A path that meets a node twice is dropped, which ends
    every cycle.  The walk order is the array of (name, id) along the path, so no sibling ranking
    window is needed; the winner per safe name is a partial aggregate.
    """
    step = F.struct(F.col(name_col).alias("n"), F.col(id_col).alias("i"))
    e = entries.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.col(name_col).alias("name"),
                       F.col(folder_col).alias("is_folder"), F.array(step).alias("ord"))
    e = materialize(e, "entries")        # read by both sides of every join
    done = e.filter(F.col("up").isNull() if root is None else (F.col("up") == F.lit(root))).drop("up")
    open_ = e.filter(F.col("up").isNotNull())

    def onto(paths: DataFrame, keep: list[str]) -> DataFrame:
        """Open paths continued by ``paths`` of the folder they point to."""
        above = paths.filter("is_folder").select(F.col("id").alias("_id"), F.col("ord").alias("_ord"), *[F.col(c).alias(f"_{c}") for c in keep])
        met = open_.join(above, F.col("up") == F.col("_id")).select(
            "id", *[F.col(f"_{c}").alias(c) for c in keep], "name", "is_folder", F.concat("_ord", "ord").alias("ord"))
        once = F.size(F.array_distinct(F.transform("ord", lambda x: x["i"]))) == F.size("ord")
        short = F.size("ord") <= max_depth if max_depth is not None else F.lit(True)
        return met.filter(once & short)

    while open_.limit(1).count():
        more = materialize(onto(done, []), "paths")
        open_ = materialize(onto(open_, ["up"]), "open")
        done = done.unionByName(more)
    walk = done.filter(~F.col("is_folder")).select(
        "id", F.array_join(F.transform("ord", lambda x: x["n"]), "/").alias("path"), F.size("ord").cast("bigint").alias("depth"),
        "name", "ord").withColumn("safe_name", safe_filename("name"))
    if max_depth is not None:
        walk = walk.filter(F.col("depth") <= max_depth)
    walk = materialize(walk, "walk")
    winner = walk.groupBy("safe_name").agg(F.max_by("ord", "ord").alias("_w"))
    return (walk.join(winner, "safe_name")
                .select("id", "path", "depth", "safe_name", (F.col("ord") == F.col("_w")).alias("kept")))


def _json_str(c):
    """A JSON string literal of ``c`` (quotes and escapes included)."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r'^\{"k":(.*)\}$', 1)


def tree_json_rows(nodes: DataFrame) -> DataFrame:
    """K4: the tree as nested JSON, in pieces: ``(name, ord, text)`` per top-level node ``name``.

    Every node opens and closes with a row; ``ord`` is the node's place in a tour of the tree (its path,
    with a mark that sorts opening before the children and closing after them).  The texts of a
    top-level node in this order, one after the other, are its document.  No folder is held in one value:
    a node needs to know only whether it is its parent's first child and whether it has children,
    which are two equi-joins on unique keys.
    """
    nodes = nodes.select("path", "parent_path", "name", "type", "link")
    first = materialize(nodes.filter(F.col("parent_path").isNotNull()).groupBy("parent_path").agg(F.min("name").alias("_first")), "first")
    parents = first.select(F.col("parent_path").alias("_p"), F.lit(True).alias("_kids"))
    heads = first.select(F.col("parent_path").alias("_q"), F.col("_first"), F.lit(True).alias("_head"))
    t = (nodes.join(parents, F.col("path") == F.col("_p"), "left")
              .join(heads, (F.col("parent_path") == F.col("_q")) & (F.col("name") == F.col("_first")), "left"))
    name, below, holds = _json_str(F.col("name")), F.col("parent_path").isNotNull(), (F.col("type") == "folder") | F.col("_kids").isNotNull()
    opening = F.concat(
        F.when(below & F.col("_head").isNull(), F.lit(",")).otherwise(F.lit("")), F.when(below, F.concat(name, F.lit(":"))).otherwise(F.lit("")),
        F.lit('{"type":'), _json_str(F.col("type")), F.lit(',"name":'), name,
        F.when(F.col("type") == "file", F.concat(F.lit(',"link":'), F.when(F.col("link").isNull(), F.lit("null")).otherwise(
            _json_str(F.col("link"))))).otherwise(F.lit("")),
        F.when(holds, F.lit(',"children":{')).otherwise(F.lit("")))
    closing = F.when(holds, F.lit("}}")).otherwise(F.lit("}"))
    place = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("1"), x))
    ends = F.array(F.struct(F.lit("0").alias("m"), opening.alias("t")), F.struct(F.lit("2").alias("m"), closing.alias("t")))
    return (t.select(F.split("path", "/")[0].alias("name"), place.alias("_o"), F.explode(ends).alias("e"))
             .select("name", F.array_append("_o", F.col("e.m")).alias("ord"), F.col("e.t").alias("text")))


def write_tree_json(nodes: DataFrame, path: str) -> None:
    """The pieces of ``tree_json_rows`` as text files: read in file order, line by line without the line
    ends, they are the documents of all top-level nodes one after the other."""
    rows = tree_json_rows(nodes)
    rows.repartitionByRange("ord").sortWithinPartitions("ord").select("text").write.mode("overwrite").text(path)


def tree_json(nodes: DataFrame) -> DataFrame:
    """K4 as ``(name, json)`` with one text per top-level node: pieces are joined per child of the
    top-level node first, so the last group holds one text per child."""
    rows = tree_json_rows(nodes).withColumn("_k", F.get("ord", F.lit(1)))
    texts = lambda key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), "")
    return rows.groupBy("name", "_k").agg(texts("ord", "text").alias("_t")).groupBy("name").agg(texts("_k", "_t").alias("json"))
