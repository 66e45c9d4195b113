"""Stored facts are used until the content or the contract changes."""
import pytest
from pyspark.sql import functions as F

from meshwork.operators import contract as C
from meshwork.operators import profile as P
from meshwork.operators import quality as D
from meshwork.operators.assessment_store import AssessmentStore
from meshwork.plans.session import together
from meshwork.plans.views import VIEWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def contract(spark):
    return P.small_cached(C.infer_contract("o", spark.read.parquet(f"{SF}/orders.parquet")))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_it_equals_a_fresh_assessment(spark, contract, tmp_path):
    store, views = AssessmentStore(spark, str(tmp_path)), {}
    for name in ("orders_nulls", "orders_badvals"):
        df, fresh = VIEWS[name](spark, SF), None
        fresh = D.assess("o", df, contract, as_of="2024-01-01")
        for _ in range(2):
            got = store.assess("o", df, contract, as_of="2024-01-01")
            for part in ("dimensions", "columns", "report", "outliers", "rare_values", "duplicates"):
                assert rows(getattr(got, part)) == rows(getattr(fresh, part)), part
        views[name] = df
    assert len(store.log.batches()) == 2


def test_facts_are_made_anew_only_when_something_changed(spark, contract, tmp_path, monkeypatch):
    made, facts_of = [], D.facts_of
    monkeypatch.setattr(D, "facts_of", lambda *a, **k: made.append(a[0]) or facts_of(*a, **k))
    store, df = AssessmentStore(spark, str(tmp_path)), VIEWS["orders_nulls"](spark, SF)
    store.facts("o", df, contract)
    store.facts("o", df.repartition(3).orderBy("o_custkey"), contract)
    AssessmentStore(spark, str(tmp_path)).facts("o", df, contract)
    assert made == ["o"]
    store.facts("o", df.where("o_orderkey > 0"), contract)
    assert len(made) == 2
    looser = contract.withColumn("nullable", F.lit(True))
    store.facts("o", df, looser)
    store.facts("o", df, looser.unionByName(looser.withColumn("product", F.lit("another"))))
    assert len(made) == 3
    store.facts("o", df)
    store.facts("p", df)
    assert len(made) == 5


def test_a_stored_report_scans_small_tables_without_an_exchange(spark, contract, tmp_path):
    store, df = AssessmentStore(spark, str(tmp_path)), VIEWS["orders_dups"](spark, SF)
    plan = store.assess("o", df, contract).report._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "Exchange hashpartitioning" not in plan


def test_jobs_run_together_and_fail_together(spark):
    assert together(lambda: spark.range(5).count(), lambda: 2) == [5, 2] and together() == []
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1, lambda: 1 // 0)
