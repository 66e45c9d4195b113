"""The hashed column profile equals the one from value counts, and no column
is gathered in one task."""
import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from meshwork.operators import contract as C
from meshwork.operators import profile as P
from meshwork.operators import quality as D

NAN = float("nan")


def messy(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(1, 0.0, "a", day, Decimal("1.10"), True, ["x"]), (1, -0.0, "a", day, Decimal("1.10"), None, ["x"]),
            (2, NAN, "b", None, None, True, None), (None, None, None, day, Decimal("2.00"), False, ["x", "y"]),
            (7, 1.5, "", datetime.date(1999, 5, 6), Decimal("3.00"), False, ["x, y"])]
    df = spark.createDataFrame(rows, "i long, d double, s string, t date, c decimal(10,2), b boolean, l array<string>")
    return df.withColumn("z", F.col("t").cast("timestamp_ntz")).unionByName(df.withColumn("z", F.lit(None).cast("timestamp_ntz")))


def profile(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_hashes_count_as_texts_do(spark):
    df = messy(spark)
    lists = [("i", ["1", "01", "x"]), ("d", ["0.0", "-0.0", "1.50"]), ("s", ["a", "a", "zz"]), ("t", ["2024-01-01", "2024-1-1"]),
             ("c", ["1.10", "2"]), ("b", ["true"]), ("z", ["2024-01-01 00:00:00"]), ("l", []), ("absent", ["q"])]
    allowed = spark.createDataFrame(lists, "column_name string, allowed_values array<string>")
    vc = P.value_counts(df)
    assert profile(P.column_profile(df)) == profile(P.column_profile(df, vc))
    got = P.column_profile(df, allowed=allowed)
    assert profile(got) == profile(P.column_profile(df, vc, allowed))
    by = {r.column_name: (r.in_list, r.invalid_count, r.has_allowed) for r in got.collect()}
    assert by == {"i": (4, 2, True), "d": (4, 1, True), "s": (4, 2, True), "t": (6, 1, True), "c": (4, 2, True),
                  "b": (4, 1, True), "z": (3, 1, True), "l": (0, 0, False)}


def test_a_null_entry_leaves_open_what_is_invalid(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    allowed = spark.createDataFrame([("s", ["a", None])], "column_name string, allowed_values array<string>")
    for vc in (None, P.value_counts(df)):
        row = P.column_profile(df, vc, allowed).first()
        assert (row.in_list, row.invalid_count, row.null_count) == (1, 0, 1)


def test_values_meet_their_lists_without_a_sort_or_one_task_a_column(spark):
    df, limit = messy(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    allowed = P.small_cached(spark.createDataFrame([("s", ["a"])], "column_name string, allowed_values array<string>"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.column_profile(df, allowed=allowed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the cells are made by one scan; above their exchange no join reads them by column
    first = plan[:plan.index("Union")]
    assert "hashpartitioning(ordinal#" in first and "a#" in first.split("hashpartitioning(ordinal#")[-1].split(")")[0]


def test_a_stored_profile_gives_the_same_contract_and_violations(spark):
    df = messy(spark).select("i", "d", "s", "t")
    contract = P.small_cached(C.infer_contract("p", df.where("i = 1")))
    prof = P.small_cached(P.column_profile(df, allowed=D.allowed_lists("p", contract)))
    assert profile(C.infer_contract("p", df, prof=prof)) == profile(C.infer_contract("p", df))
    assert profile(C.contract_violations("p", df, contract, prof=prof)) == profile(C.contract_violations("p", df, contract))
    assert profile(P.column_facts(df, prof=prof)) == profile(P.column_facts(df))
