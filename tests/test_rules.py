"""Hand-made cases on both sides of each threshold of the reference rules."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwork.functions import text as X
from meshwork.operators import contract as C
from meshwork.operators import governance as E
from meshwork.operators import catalog as M
from meshwork.operators import profile as P
from meshwork.operators import quality as D
from meshwork.operators.quantiles import exact_quantiles


def _col_with_nulls(spark, n_rows, n_null):
    rows = [(i, None if i < n_null else "v") for i in range(n_rows)]
    return spark.createDataFrame(rows, "id int, x string")


@pytest.mark.parametrize("n_null,expected", [(50, None), (51, "Warning"), (200, "Warning"),
                                             (201, "CRITICAL")])
def test_null_thresholds(spark, n_null, expected):
    df = _col_with_nulls(spark, 1000, n_null)
    issue = D.column_completeness("t", df).where(F.col("column_name") == "x").first().issue
    if expected is None:
        assert issue is None
    else:
        assert issue.startswith(expected)


@pytest.mark.parametrize("dups,expected", [(10, None), (11, "Warning"), (50, "Warning"),
                                           (51, "CRITICAL")])
def test_duplicate_thresholds(spark, dups, expected):
    rows = [(i,) for i in range(1000 - dups)] + [(0,)] * dups
    df = spark.createDataFrame(rows, "id int")
    r = D.duplicate_rows("t", df).first()
    assert r.duplicate_rows == dups
    assert (r.issue is None) if expected is None else r.issue.startswith(expected)


def test_duplicates_hash_and_exact_agree_with_nulls(spark):
    rows = [(1.0, None), (None, 1.0), (1.0, None), (2.0, -0.0), (2.0, 0.0), (float("nan"), 1.0),
            (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    h = D.duplicate_rows("t", df).first().duplicate_rows
    e = D.duplicate_rows("t", df, exact=True).first().duplicate_rows
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    assert h == e == int(pdf.duplicated().sum())


@pytest.mark.parametrize("score,grade", [(59.9, "F"), (60, "D"), (70, "C"), (80, "B"),
                                         (89.96, "B"), (90, "A")])
def test_grades(spark, score, grade):
    df = spark.createDataFrame([(float(score),)], "s double")
    assert df.select(D.grade(F.col("s")).alias("g")).first().g == grade


@pytest.mark.parametrize("hours,score", [(24, 100.0), (24.5, 80.0), (48, 80.0), (48.5, 60.0),
                                         (168, 60.0), (168.5, 30.0), (None, 80.0)])
def test_timeliness(spark, hours, score):
    as_of = dt.datetime(2024, 3, 1)
    if hours is None:
        lm = None
    else:
        lm = spark.createDataFrame([(as_of - dt.timedelta(hours=hours),)],
                                   "last_modified timestamp")
    dim = D.timeliness_dimension("t", spark, lm, as_of.isoformat(sep=" "))
    assert dim.first().score == score


def test_mixed_types_boundary(spark):
    # 9 of 10 numeric -> not mixed (share must be below 90 %); 8 of 10 -> mixed
    for k, flagged in [(9, False), (8, True), (0, False)]:
        rows = [(str(i),) for i in range(k)] + [("x",)] * (10 - k)
        df = spark.createDataFrame(rows, "c string")
        issue = D.mixed_type_columns("t", df).first().issue
        assert (issue is not None) == flagged


def test_numeric_looking_matches_pandas(spark):
    vals = ["1", " 12 ", "1e5", "inf", "-inf", "NaN", "1d", "2f", "abc", "", "0x10", "1,000", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r.ok for r in df.select(X.looks_numeric(F.col("c")).alias("ok")).collect()]
    want = list(pd.to_numeric(pd.Series(vals), errors="coerce").notna())
    assert got == want


@pytest.mark.parametrize("distinct,flag", [(5, False), (6, True)])
def test_rare_values_needs_more_than_five_values(spark, distinct, flag):
    rows = [("common",)] * 3000 + [(f"r{i}",) for i in range(distinct - 1)]
    df = spark.createDataFrame(rows, "c string")
    r = D.rare_value_columns("t", df).first()
    assert (r.issue is not None) == flag


def test_outlier_share_uses_all_rows(spark):
    vals = [float(i % 10) for i in range(95)] + [1000.0] * 5 + [None] * 2
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = D.outlier_columns("t", df).first()
    assert r.outliers == 5
    assert r.outlier_pct == round(5 / 102 * 100, 2)
    assert r.issue is None  # 4.9 % is not above 5 %


def test_categorical_limit(spark):
    rows = [(f"v{i}", f"w{i % 20}") for i in range(21)]
    df = spark.createDataFrame(rows, "a string, b string")
    cols = {r.column_name for r in P.categorical_profile(df).collect()}
    assert cols == {"b"}


def test_quantiles_match_pandas_in_every_mode(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=5000), 2)
    x[:1500] = 0.25
    pdf = pd.DataFrame({"x": x})
    df = spark.createDataFrame(pdf)
    probs = [0, 0.1, 0.25, 0.5, 0.75, 1]
    want = pdf.x.quantile(probs).values
    for kw in ({}, {"small": 50, "accuracy": 200}):
        got = (exact_quantiles(df, ["x"], probs, **kw).toPandas().sort_values("p").value.values)
        assert np.allclose(want, got, atol=1e-12, rtol=0)


def test_quantiles_with_heavy_ties_and_many_values(spark):
    """More equal values than a band may hold, beside many distinct ones."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.full(4000, 3.5), np.full(2500, -1.0), rng.normal(size=6000), np.full(300, np.nan)])
    pdf = pd.DataFrame({"x": x, "y": np.arange(len(x)) % 7})
    probs = [0, 0.01, 0.2, 0.3, 0.5, 0.68, 0.9, 1]
    got = exact_quantiles(spark.createDataFrame(pdf), ["x", "y"], probs, small=40, accuracy=100).toPandas()
    for c in ("x", "y"):
        own = got[got.column_name == c].sort_values("p").value.values
        assert np.allclose(pdf[c].quantile(probs).values, own, atol=1e-12, rtol=0)


def test_equal_values_of_odd_types_count_once(spark):
    df = spark.sql("""select * from values
        (array('a, b'), 0.0D, map('k', 1, 'l', 2), parse_json('{"a":1}')),
        (array('a', 'b'), -0.0D, map('l', 2, 'k', 1), parse_json('{"a":1}')),
        (array('a', 'b'), double('nan'), null, null) as t(a, z, m, v)""")
    counts = {r.column_name: r.distinct_count for r in P.distinct_counts(df).collect()}
    assert counts == {"a": 2, "z": 1, "m": 1, "v": 1}
    nulls = {r.column_name: r.null_count for r in P.column_profile(df).collect()}
    assert nulls == {"a": 0, "z": 1, "m": 1, "v": 1}


def test_repeated_ids_stay_single_rows(spark):
    from meshwork.operators import graph as G
    from meshwork.operators import graph_queries as Q
    df = spark.createDataFrame([("c1", "One year", "Yes", 10.0), ("c1", "One year", "Yes", 10.0),
                                ("c1", "One year", "No", 10.0), ("c2", "One year", "No", 20.0)],
                               "customerID string, Contract string, Churn string, MonthlyCharges double")
    g = G.build_graph(df, G.TELCO_GRAPH)
    r = Q.rate_by_dimension(g, "HAS_CONTRACT", "HAS_CHURN_STATUS", "Yes").first()
    assert (r.total, r.positives, r.rate_pct) == (4, 2, 50.0)
    m = Q.aggregate_measures(g, "MonthlyCharges", "HAS_CONTRACT").first()
    assert (m.row_count, m.sum_value, m.avg_value) == (4, 50.0, 12.5)
    assert Q.match_1hop(g, "HAS_CONTRACT", "contract_type").count() == 4


def test_score_drop_alert_boundary(spark):
    rows = [("p", dt.date(2024, 1, 1), 80.0), ("p", dt.date(2024, 1, 2), 70.0),
            ("p", dt.date(2024, 1, 3), 59.9)]
    df = spark.createDataFrame(rows, "product string, assessed_at date, score double")
    alerts = M.quality_drop_alerts(df).collect()
    assert [a.message for a in alerts] == ["Quality dropped from 70.0 to 59.9"]


@pytest.mark.parametrize("query,status", [
    ("MATCH (n) RETURN n", "pass"),
    ("MATCH (n) SET n.x=1 RETURN n", "fail"),
    ("MATCH (n) RETURN n.offset", "pass"),
    ("select updated_at from t", "fail"),
    ("CREATE INDEX i", "pass"),
    ("CREATE (n)", "fail"),
    ("MATCH (n) RETURN n MERGE (m)", "pass"),
])
def test_validate_query(spark, query, status):
    df = spark.createDataFrame([(query,)], "query string")
    assert E.validate_queries(df).first().status == status


def test_extract_texts(spark):
    rows = [("```json\n{\"a\": 1}\n```",), ("see {\"b\": 2} here",), ("{broken",),
            ("Sure:\nMATCH (c) RETURN c\n\nNote: done",), ("```cypher\nMATCH (x) RETURN x\n```",),
            ("select 1 Explanation: x",), ("  plain  ",)]
    df = spark.createDataFrame(rows, "t string")
    body, brace = X.extract_json_candidate(F.col("t"))
    out = X.with_query_text(df.withColumn("b", brace), "t", "q").select("b", "q").collect()
    assert out[0].b == "{\"a\": 1}" and out[1].b == "{\"b\": 2}" and out[2].b == ""
    assert out[3].q == "MATCH (c) RETURN c"
    assert out[4].q == "MATCH (x) RETURN x"
    assert out[5].q == "select 1"
    assert out[6].q == "plain"


def test_pii_examples(spark):
    cols = spark.createDataFrame(
        [("t", c, i) for i, c in enumerate(["customerID", "PhoneService", "tenure", "page_id",
                                            "Churn"])],
        "product string, column_name string, ordinal int")
    got = {r.column_name: r.pattern_id for r in E.detect_pii_columns(cols).collect()}
    assert got == {"customerID": 1, "PhoneService": 4, "page_id": 7}


def test_contract_inference_and_violations(spark):
    clean = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k long, s string")
    cc = C.infer_contract("t", clean).collect()
    by = {r.column_name: r for r in cc}
    assert by["k"].unique and not by["k"].nullable and by["s"].allowed_values == ["a", "b"]
    messy = spark.createDataFrame([(1, "a"), (1, "z"), (None, None)], "k long, s string")
    v = {r.check for r in C.contract_violations("t", messy, C.infer_contract("t", clean)).collect()}
    assert v == {"nullable", "unique", "allowed"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert D.completeness_dimension("t", df).first().score == 0.0
    assert D.duplicate_rows("t", df).first().duplicate_rows == 0


def test_seed_index_and_summary(spark):
    import duckdb
    from meshwork.plans import semantic_suite as SS
    got = sorted(tuple(r) for r in SS.term_index(spark).select("key", "term", "key_order").collect())
    want = sorted(duckdb.sql(SS.TERM_INDEX_SQL).fetchall())
    assert got == want and len(got) == 26
    s = SS.semantic_summary(spark).first()
    assert (s.glossary_terms, s.annotated_products, s.total_annotations) == (7, 1, 23)
    assert s.domains == "customer,product,revenue"
