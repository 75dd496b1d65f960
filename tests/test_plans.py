"""Plan invariants over every registered query (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TOP_K = ["knn_top5", "knn_cosine", "recent_questions"]


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    from docket.plans.queries import QUERIES
    for name in QUERIES:
        fn = E.queries()[name]
        qe = fn(spark, SF001)._jdf.queryExecution()
        out[name] = qe.executedPlan().toString()
    return out


def test_no_pair_joins(plans):
    bad = {n: k for n, p in plans.items()
           for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in p}
    assert bad == {}


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_is_group_limited(plans, name):
    assert "WindowGroupLimit" in plans[name]


def test_scans_are_pruned(spark):
    df = E.queries()["clean_context"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
