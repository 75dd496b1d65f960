import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_check import TABLES, digest

FAST = ["knn_top5", "rag_context", "top_source_link", "chunk_fixed", "tag_runs", "render_answer",
        "route_fields", "candidate_files", "fuzzy_best", "recent_questions", "library_tree",
        "folder_closure", "lookup_file", "pack_batches", "hash_embed", "answer_batch",
        "chunk_recursive", "dispatch", "knn_cosine", "pair_distance", "snippets", "document_names",
        "collection_records", "whole_replies", "answer_forms", "collection_size", "top_folders",
        "top1_source", "archive_text", "upsert_twice", "whole_docs", "json_rows", "file_bytes",
        "tree_json", "model_lengths", "answer_stream", "ingest_archives"]


def test_whole_replies_match_oracle(spark, con):
    """The end of every turn reaches T9: nothing is cut but the whitespace put around it."""
    rows = [tuple(r) for r in E.queries()["whole_replies"](spark, SF001).collect()]
    r = con.execute(E.oracle_sql()["whole_replies"])
    cols = [d[0] for d in r.description]
    assert digest(["conv_id", "turn", "reply"], rows) == digest(cols, r.fetchall())
    texts = con.execute("SELECT conv_id, turn, text FROM conversations").fetchall()
    assert sorted(rows) == sorted((c, t, x.strip().upper()) for c, t, x in texts)


def test_whole_docs_match_oracle(spark, con):
    """No real text is replaced; the null and empty texts are further rows."""
    rows = [tuple(r) for r in E.queries()["whole_docs"](spark, SF001).collect()]
    r = con.execute(E.oracle_sql()["whole_docs"])
    assert digest(["name", "text_md5"], rows) == digest([d[0] for d in r.description], r.fetchall())
    texts = con.execute("SELECT source || '-' || doc_id, md5(text) FROM documents").fetchall()
    assert set(texts) <= set(rows) and len(rows) == 3 * len(texts)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["qid", "question", "category", "answer", "source_label", "source_link",
                          "context", "prompt"]


def test_every_query_has_a_callable():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_sf0001(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    r = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in r.description]
    orows = r.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
