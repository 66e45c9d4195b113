"""Survey outputs that the first keys of their operators leave out."""
from meshwork.operators import catalog as M
from meshwork.operators import contract as C
from meshwork.operators import governance as E


def test_contract_terms(spark):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    contracts = C.default_contract(C.product_table(spark, ["t"]))

    def terms(last, **types):
        cc = spark.createDataFrame([("t", c, t, True, False, None, "") for c, t in types.items()], C.COLUMN_SCHEMA)
        modified = spark.createDataFrame([(last,)], "last_modified string")
        return {r.expectation: (r.actual, r.passed) for r in C.check_terms("t", df, cc, contracts, modified, "2024-01-02 00:00:00").collect()}
    assert terms("2024-01-01 00:00:00", k="int", s="string") == {"expected_type": (1.0, True), "max_age_hours": (24.0, True)}
    assert terms("2023-12-31 23:00:00", k="bigint", s="string") == {"expected_type": (0.5, False), "max_age_hours": (25.0, False)}
    assert terms(None, k=None) == {"expected_type": (None, True), "max_age_hours": (None, None)}


def test_no_check_has_no_newest_result(spark):
    rules = spark.createDataFrame([("G", "global", None)], "rule_id string, scope string, domain string")
    policies = spark.createDataFrame([], "product string, pii_columns array<string>")
    hist = E.compliance_history(spark.createDataFrame([], "product string, status string"))
    out = E.compliance_summary(rules, policies, hist).first()
    assert out.latest_results is None and out.rules_by_domain == [] and out.compliance_checks == 0


def test_usage_rows_of_runs(spark):
    runs = spark.createDataFrame([("q", ["a", "b"], {"a": ["x"], "b": ["y"]}, None, None), ("r", [], {}, "m", None), ("s", ["a"], None, "m", None)],
                                 "query string, products array<string>, relevant_columns map<string, array<string>>, user_role string, timestamp timestamp")
    got = sorted((r.product, r.query, r.columns_accessed, r.user_role) for r in M.usage_rows(runs).collect())
    assert got == [("a", "q", ["x", "y"], "analyst"), ("a", "s", [], "m"), ("b", "q", ["x", "y"], "analyst")]
