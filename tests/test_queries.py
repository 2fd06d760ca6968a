"""Every registered query against its SQL counterpart, and plan shapes that must hold at scale."""

import pytest
from compare import difference

from sitemarks.plans.oracles import ORACLES
from sitemarks.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert name in ORACLES
    assert difference(QUERIES[name](spark, SF), ORACLES[name], SF) is None


def test_no_stray_oracles():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["detection_result", "html_evidence", "page_resources", "multi_portal_pages"])
def test_page_queries_only_spread_the_small_scan(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")


def test_filter_on_a_result_runs_no_regex_twice(spark):
    plan = _plan(QUERIES["multi_portal_pages"](spark, SF))
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("regexp_extract" in line or "RLIKE" in line for line in filters)


@pytest.mark.parametrize("name", ["summary_flags", "hub_ids_by_page", "resume_pending", "run_statistics", "catalog_theta_join"])
def test_no_nested_loops(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_limit_is_applied_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(QUERIES["retry_queue"](spark, SF))


def test_evidence_is_deduplicated_by_hashing(spark):
    plan = _plan(QUERIES["evidence_all"](spark, SF))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_id_only_reads_do_not_read_pages(spark):
    plan = QUERIES["network_evidence"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html:string" not in plan
