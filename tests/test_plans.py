"""Plan checks: no Python in the plans, pushdown reaches the scan, bounded
top-k per group."""
import pytest

from meshwork.plans.registry import load_all

SF = "/root/testdata/sf0.001"
QUERIES, _ = load_all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert marker not in plan


def test_filter_pushed_to_scan(spark):
    plan = _plan(QUERIES["filter_rows"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderstatus)" in plan \
        or "GreaterThan(o_totalprice" in plan


def test_column_pruning(spark):
    plan = _plan(QUERIES["rate_by_dimension"](spark, SF))
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_top_values_limit_before_shuffle(spark):
    plan = _plan(QUERIES["profile_top_values"](spark, SF))
    assert "WindowGroupLimit" in plan



def test_rates_take_one_scan_and_one_exchange(spark):
    for key in ("rate_by_dimension", "avg_by_dimension", "status_cross_count", "aggregate_measures"):
        plan = _plan(QUERIES[key](spark, SF))
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan, key


def test_glossary_matching_has_no_nested_loop_over_phrases(spark):
    for key in ("resolve_terms", "enrich_queries"):
        assert "NestedLoop" not in _plan(QUERIES[key](spark, SF)) and "Cartesian" not in _plan(QUERIES[key](spark, SF)), key
