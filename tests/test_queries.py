"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from compare import compare, connect

from reviewlake.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    problem, rows, _, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert problem is None
    assert rows > 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.endswith("_stream")))
def test_plan_has_no_cross_join(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["lookup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    plan = QUERIES["severity_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan


def test_row_local_work_does_not_shuffle(spark, sf_dir):
    from reviewlake.catalog.base import table
    from reviewlake.operators import redact, retrieval

    docs = table(spark, sf_dir, "documents")
    for df in (redact.inspect(docs), retrieval.embed(docs, id_col="doc_id", text_col="text")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_are_shuffled_once(spark, sf_dir):
    from reviewlake.catalog.scan import sources
    from reviewlake.operators.rules import find

    plan = find(sources(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    by_file = [x for x in plan.splitlines() if "Exchange hashpartitioning(file_id" in x]
    assert len(by_file) == 1


def test_guidelines_need_no_python_in_tasks(spark):
    from reviewlake.operators import language

    plan = language.guidelines(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "RDD" not in plan
    assert language.guidelines(spark, []).count() == 0
