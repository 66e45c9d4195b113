"""The reference's own domain on a small in-memory telco sample: graph
build, the five demo questions, publish, sample rows and usage append."""
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwork.operators import catalog as M
from meshwork.operators import graph as G
from meshwork.operators import graph_queries as Q
from meshwork.operators import profile as P
from meshwork.sources import products as S

ROWS = [
    ("C1", "Male", 1, 5, "Month-to-month", "Fiber optic", "Electronic check", "Yes", 80.0, "Yes", "too pricey"),
    ("C2", "Female", 0, 40, "Two year", "DSL", "Mailed check", "No", 50.5, "No", "fine"),
    ("C3", "Female", 1, 2, "Month-to-month", "Fiber optic", "Electronic check", "No", 90.25, "Yes", "slow"),
    ("C4", "Male", 0, 70, "One year", "No", "Bank transfer", "No", 20.0, "No", None),
    ("C5", "Male", 1, 12, "Month-to-month", "DSL", "Credit card", "Yes", 60.0, "Yes", "support"),
    ("C6", "Female", 0, 30, "One year", "Fiber optic", "Credit card", "Yes", 85.0, "No", "ok"),
    ("C7", "Male", 1, 1, "Month-to-month", "Fiber optic", "Mailed check", "No", 75.0, "No", ""),
    ("C8", "Female", 0, 60, "Two year", "", "Bank transfer", "No", 25.0, "No", "great"),
]
COLS = ["customerID", "gender", "SeniorCitizen", "tenure", "Contract", "InternetService",
        "PaymentMethod", "TechSupport", "MonthlyCharges", "Churn", "CustomerFeedback"]


def half_up(x, n=2):
    """Spark and DuckDB round ties away from zero on the decimal text."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


@pytest.fixture(scope="module")
def telco(spark):
    return spark.createDataFrame(ROWS, COLS)


def test_demo_questions(spark, telco):
    g = G.build_graph(telco, G.TELCO_GRAPH)
    pdf = pd.DataFrame(ROWS, columns=COLS)
    out = Q.business_questions(g)
    rate = {r.contract_type: (r.total_customers, r.churned, r.churn_rate_pct)
            for r in out["churn_rate_by_contract"].collect()}
    for c, grp in pdf.groupby("Contract"):
        n, k = len(grp), int((grp.Churn == "Yes").sum())
        assert rate[c] == (n, k, half_up(k / n * 100))
    senior = out["churned_seniors_on_fibre"].first().senior_churned
    assert senior == int(((pdf.SeniorCitizen == 1) & (pdf.Churn == "Yes")
                          & (pdf.InternetService == "Fiber optic")).sum())
    avg = {r.payment_method: r.avg_charges for r in out["avg_charge_by_payment"].collect()}
    for m, grp in pdf.groupby("PaymentMethod"):
        assert avg[m] == half_up(grp.MonthlyCharges.mean())
    assert out["customers_with_tech_support"].first().with_tech_support == 3
    fb = {r.customerID for r in out["feedback_of_churned"].collect()}
    assert fb == set(pdf[pdf.Churn == "Yes"].customerID)
    # empty InternetService value: a node exists, no edge (as in the reference)
    assert g.nodes.where((F.col("label") == "InternetService") & (F.col("key") == "")).count() == 1
    assert g.edges.where(F.col("rel") == "USES_INTERNET").count() == 7


def test_publish_sample_and_usage(spark, telco, tmp_path):
    reg = S.publish_product({}, "telco_churn_with_all_feedback", telco)
    assert spark.table("telco_churn_with_all_feedback").count() == 8
    assert "telco_churn_with_all_feedback" in reg
    first3 = [r.customerID for r in P.sample_rows(telco, 3, "customerID").collect()]
    assert first3 == ["C1", "C2", "C3"]
    usage = spark.createDataFrame(
        [("telco", "q1", ["Churn", "Contract"], "analyst", None)] * 11, M.USAGE_SCHEMA)
    path = str(tmp_path / "usage")
    M.record_usage(usage, path)
    M.record_usage(usage, path)
    log = spark.read.parquet(path)
    assert M.usage_summary(log).first().total_queries == 22
    recs = M.recommendations(
        spark.createDataFrame([("telco", 8, 65.0, "D", "auto-detected", False)],
                              "product string, row_count long, quality_score double, "
                              "quality_grade string, owner string, contract_compliant boolean"),
        spark.createDataFrame([("telco", "CustomerFeedback", 2)],
                              "product string, column_name string, null_count long"),
        log)
    assert {r.rule for r in recs.collect()} == {"low_score", "low_grade", "contract", "owner",
                                                "usage", "nulls"}
