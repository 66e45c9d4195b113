"""Conditions against DuckDB, and rules on products that they do not fit."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from meshwork.functions.conditions import MAX_DEPTH, ConditionError, compile_condition
from meshwork.operators import domain_rules as R

SCHEMA = "a int, b double, s string, d date, t timestamp, f boolean, l array<int>, `odd name` string, date int"
ROWS = [(1, 1.5, "abc", "2024-01-31", "2024-01-31 10:00:00", True, [1], "x", 1),
        (-2, None, "A'b%", "1999-12-01", None, False, None, None, 2),
        (None, -3.25, "", None, "2024-02-01 00:00:00", None, [], 'q"', None),
        (7, 0.0, None, "2024-02-29", "2023-12-31 23:59:59", True, [2], "", 4),
        (2147483647, 1e300, " a_c ", "2024-01-01", "2024-01-01 00:00:00", False, [], "abc", 5)]


@pytest.fixture(scope="module")
def data(spark):
    names = ["a", "b", "s", "d", "t", "f", "l", "odd name", "date"]
    df = spark.createDataFrame(ROWS, "a int, b double, s string, d string, t string, f boolean, l array<int>, `odd name` string, date int")
    return df.withColumns({"d": F.col("d").cast("date"), "t": F.col("t").cast("timestamp")}).select(*(f"`{n}`" for n in names))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("""create table x(a int, b double, s varchar, d date, t timestamp, f boolean, l int[], "odd name" varchar, date int)""")
    con.executemany("insert into x values (?, ?, ?, ?, ?, ?, ?, ?, ?)", ROWS)
    return con


WRITTEN = [
    "a > 0", "NOT a > 0 Or b<=1.5", "a in (1, -2)", "a not in (1, 2.5)", "s like 'a%'", "s not like '%\\%%' ", "s = 'A''b%'",
    "b between -4 and 1.5 and a is not null", "b not between a and 3", "d >= date '2024-01-01'", "t < timestamp '2024-01-31 10:00:01'",
    "d = t", "f", "not f or f is null", "f = true", "length(s) > 2 and upper(s) <> s", "trim(lower(s)) = 'a_c'",
    "year(d) = 2024 and month(t) in (1, 2) or day(d) > 30", "abs(a) = 2", "a = b", "not (a = 1 or (b = 0 and not f))",
    "\"odd name\" = 'abc'", "date > 1", "1 = 1", "-1.5e2 < a", "a = date or s is null", "a between 1 and 7 and b = 0 or s = ''"]


@pytest.mark.parametrize("text", WRITTEN)
def test_conditions_mean_what_sql_means(data, duck, text):
    condition, used = compile_condition(text, data.schema)
    got = [r[0] for r in data.select(condition.alias("x")).collect()]
    sql = text.replace("like '%\\%%'", "like '%\\%%' escape '\\'")
    assert got == [r[0] for r in duck.execute(f"select {sql} from x order by rowid").fetchall()]
    assert used <= set(data.columns)


def test_random_conditions(data, duck):
    rng = random.Random(7)

    def condition(depth):
        kind = rng.random()
        if depth and kind < 0.55:
            return f"({condition(depth - 1)} {rng.choice(['and', 'or'])} {condition(depth - 1)})"
        if depth and kind < 0.7:
            return f"not {condition(depth - 1)}"
        return rng.choice([
            f"{rng.choice(['a', 'b', 'date'])} {rng.choice(['=', '<>', '<', '>='])} {rng.choice(['1', '-2', '0.5', 'a', 'b'])}",
            f"s {rng.choice(['=', '<', 'not like', 'like'])} {rng.choice(['''('abc')'''[1:-1], ''''%b%' '''])}",
            f"{rng.choice('abdtfs')} is {rng.choice(['', 'not '])}null", f"a {rng.choice(['', 'not '])}in (1, 7, -2)"])

    for _ in range(60):
        text = condition(4)
        column = compile_condition(text, data.schema)[0]
        got = [r[0] for r in data.select(column.alias("x")).collect()]
        assert got == [r[0] for r in duck.execute(f"select {text} from x order by rowid").fetchall()], text


REFUSED = ["", "a", "a >", "a > 'x'", "s > 1", "a = null", "c = 1", "A = 1", "l = l", "l in (1)", "a in ()", "a in (b)", "a like '1'",
           "s like s", "a > 1; drop table x", "a > 1 --", "(select 1) = 1", "reflect('java.lang.System', 'exit') = 1", "a = 1 or",
           "(a = 1", "a = 1)", "length(a) = 1", "exists (1)", "a + 1 > 2", "a / 0 = 1", "cast(s as int) = 1", "d = '2024-01-01'",
           "d = date '2024-13-01'", "not", "f = 1", "a between 1", "s like 'a\\b'", "not " * (MAX_DEPTH + 1) + "f",
           "(" * (MAX_DEPTH + 1) + "f" + ")" * (MAX_DEPTH + 1), "a = 1 and " * 600 + "a = 1", "\"a\"\" = 1", "`a` = 1", "year(a) = 1"]


@pytest.mark.parametrize("text", REFUSED, ids=range(len(REFUSED)))
def test_what_is_no_condition_is_refused(data, text):
    with pytest.raises(ConditionError):
        compile_condition(text, data.schema)


def rules(spark, rows):
    return spark.createDataFrame(rows, "domain string, rule_id string, name string, severity string, condition string")


def test_rules_are_counted_in_one_pass(spark, data):
    table = rules(spark, [("x", f"R{i:03}", "n", "error" if i % 2 else "info", f"a <> {i}") for i in range(150)]
                  + [("x", "Z1", "n", "error", None), ("x", "Z2", "n", "error", "nothing = 1"), ("y", "Y", "n", "error", "a = 0")])
    out = R.domain_checks({"p": data, "empty": data.limit(0), "free": data}, {"p": "x", "empty": "x"}, table)
    got = {(r["product"], r.rule_id): r for r in out.collect()}
    assert len(got) == 304 and not any(p == "free" for p, _ in got)
    for i in range(150):
        bad = [1, -2, None, 7, 2147483647].count(i)
        r = got["p", f"R{i:03}"]
        assert (r.rows_checked, r.offending_rows, r.unknown_rows) == (5, bad, 1)
        assert r.status == ("pass" if not bad else "fail" if i % 2 else "warning")
        assert got["empty", f"R{i:03}"].status == "pass" and got["empty", f"R{i:03}"].rows_checked == 0
    assert got["p", "Z1"].status == got["p", "Z2"].status == "error" and got["p", "Z1"].offending_rows is None


def test_quarantine_splits_the_rows(spark, data):
    table = rules(spark, [("x", "A", "n", "error", "a > 0"), ("x", "B", "n", "info", "b >= 0"), ("x", "C", "n", "info", "gone = 0")])
    bad = R.offending_rows(data, table, "x")
    assert [(r.a, r.broken_rules) for r in bad.collect()] == [(-2, ["A"]), (None, ["B"])]
    assert [r.a for r in R.clean_rows(data, table, "x").collect()] == [1, 7, 2147483647]
    assert R.offending_rows(data, table, "none").count() == 0 and R.clean_rows(data, table, "none").count() == 5


def test_only_the_named_columns_are_read(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = R.domain_checks({"orders": orders}, {"orders": "s"}, rules(spark, [("s", "1", "n", "error", "o_totalprice > 0"),
                                                                             ("s", "2", "n", "error", "o_totalprice < 9")]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "ReadSchema: struct<o_totalprice:double>" in plan
