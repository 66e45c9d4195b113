"""Invalid values of a contract column: all as rows, a bounded message."""
from meshwork.operators import contract as C

ONE = "product string, column_name string, expected_type string, nullable boolean, unique boolean, allowed_values array<string>, description string"


def _violations(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    contract = spark.createDataFrame([("t", "s", "string", True, False, ["ok"], "")], ONE)
    return C.contract_violations("t", df, contract).collect(), C.invalid_values("t", df, contract).collect()


def test_many_invalid_values_are_rows_and_a_bounded_message(spark):
    values = [f"id-{i:06d}" for i in range(20_000)] + ["id-000007"] * 3 + ["ok", None]
    (violation,), rows = _violations(spark, values)
    assert {r.value: r.n for r in rows} == {v: 4 if v == "id-000007" else 1 for v in values[:20_000]}
    assert len(violation.message) < 2 * C.MESSAGE_CHARS
    assert "id-000007" in violation.message and "... (20000 values in all)] (allowed: [ok])" in violation.message


def test_long_invalid_values(spark):
    values = ["x" * 300_000 + str(i) for i in range(3)] + ["short"] * 2
    (violation,), rows = _violations(spark, values)
    assert sorted(r.value for r in rows) == sorted(set(values))
    assert violation.message == "s: invalid values [short, ... (4 values in all)] (allowed: [ok])"
    (violation,), _ = _violations(spark, values[:3])
    assert violation.message == "s: invalid values [... (3 values in all)] (allowed: [ok])"


def test_a_short_list_is_whole(spark):
    status = C.contract_status(C.default_contract(C.product_table(spark, ["t"])), C.contract_violations(
        "t", spark.createDataFrame([("b",), ("b",), ("a",)], "s string"),
        spark.createDataFrame([("t", "s", "string", True, False, ["ok"], "")], ONE))).first()
    assert status.violations == ["s: invalid values [a, b] (allowed: [ok])"] and status.violation_count == 1
