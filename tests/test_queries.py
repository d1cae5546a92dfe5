"""Every query against its SQL in DuckDB, and guards on plans."""

import pytest

from pactlake.plans.queries import QUERIES, SQL
from tests.conftest import SF, canonical


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())


def test_flagship_has_no_failed_read(spark):
    rows = QUERIES["infer_then_validate"](spark, SF).collect()
    assert {r.check_type for r in rows} >= {"required", "type", "enum", "range", "statistical_drift"}
    assert [r for r in rows if r.status == "CRITICAL" and r.check_type == "uuid_pattern"]  # integer ids named _id are no UUIDs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fused_validation_scans_once(spark):
    assert plan_of(QUERIES["validate_fused"](spark, SF)).count("FileScan") == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_python_in_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))  # of what is left to do where jobs run while it is built
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "CartesianProduct"))


@pytest.mark.parametrize("name", ["contains_pairs", "blast_radius", "contamination_depth", "violation_texts"])
def test_names_are_joined_without_nested_loops(spark, name):
    assert "NestedLoop" not in plan_of(QUERIES[name](spark, SF))


def test_links_of_files_are_joined_by_an_equality(spark):
    from pactlake.plans import graphs

    links = graphs._of(spark, SF, graphs.LINK_JOIN)
    assert "NestedLoop" not in plan_of(links) and "Join" in plan_of(links)
    assert canonical(links.columns, links.collect()) == canonical(links.columns, graphs._of(spark, SF, graphs.LINK_SQL).collect())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
