"""Exact quantiles per group and service levels against plain Python."""
import math
import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import contract as C
from meshwork.operators import sla as A


def nearest_rank(values, q_percent):
    v = sorted(values)
    return v[max((len(v) * q_percent + 99) // 100, 1) - 1] if v else None


def groups(seed):
    rng = random.Random(seed)
    yield "normal", [rng.gauss(0, 1) for _ in range(500)]
    yield "ties", [rng.choice([1.0, 2.0]) for _ in range(400)]
    yield "one heavy value", [7.0] * 380 + [rng.random() for _ in range(20)]
    yield "heavy below the rank", [0.0] * 379 + [float(i) for i in range(1, 22)]
    yield "single", [3.0]
    yield "infinite", [math.inf] * 30 + [-math.inf] * 30 + [1.0] * 3
    yield "integers", [float(i % 37) for i in range(300)]
    yield None, [float(i) for i in range(100)]


@pytest.mark.parametrize("q, percent", [(0.95, 95), (0.5, 50), (0.0, 0), (1.0, 100)])
def test_bands_end_at_the_value_of_nearest_rank(spark, q, percent):
    data = dict(groups(int(q * 100)))
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("empty", None), ("empty", math.nan), ("ties", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    want = {k: (len(v), nearest_rank(v, percent)) for k, v in data.items()} | {"empty": (0, None)}
    for small in (1_000_000, 8):
        out = A.grouped_quantile(df, ["k"], "v", q, small=small).collect()
        assert {r.k: (r.n, r.quantile) for r in out} == want and len(out) == len(want)


def test_bands_that_sketches_narrow_many_times(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("a").alias("k"), (F.xxhash64("id") / 1e6).alias("v")).unionByName(
        spark.range(n).select(F.lit("b").alias("k"), F.floor(F.sqrt(F.col("id").cast("double"))).alias("v")))
    want = {r.k: (r.n, r.x) for r in df.groupBy("k").agg(
        F.count("*").alias("n"), F.expr("sort_array(collect_list(v))[cast(ceil(count(*) * 0.95) as int) - 1]").alias("x")).collect()}
    assert {r.k: (r.n, r.quantile) for r in A.grouped_quantile(df, ["k"], "v", 0.95, small=50).collect()} == want


def runs(spark, rows):
    return spark.createDataFrame(rows, "product string, started_at string, duration_ms double, ok boolean").withColumn(
        "started_at", F.col("started_at").cast("timestamp"))


ROWS = ([("a", f"2024-01-01 0{i % 5}:10:00", float(i), i != 7) for i in range(100)]
        + [("b", "2024-01-01 00:00:00", None, True), ("b", "2024-01-01 09:00:00", math.nan, None)])


def test_checks_against_the_contract(spark):
    contracts = C.default_contract(C.product_table(spark, ["a", "b", "never run"])).withColumn(
        "max_query_time_ms", F.lit(94))
    out = A.check_sla(contracts, A.service_levels(runs(spark, ROWS))).collect()
    got = {(r["product"], r.expectation): (r.threshold, r.actual, r.passed) for r in out}
    assert got == {("a", "availability_percent"): (99.0, 99.0, True), ("a", "max_query_time_ms"): (94.0, 94.0, True),
                   ("b", "availability_percent"): (99.0, 50.0, False), ("b", "max_query_time_ms"): (94.0, None, None),
                   ("never run", "availability_percent"): (99.0, None, None),
                   ("never run", "max_query_time_ms"): (94.0, None, None)}


def test_hourly_summaries_merge_and_count_once(spark, tmp_path):
    log, rows = A.SlaLog(spark, str(tmp_path / "sla")), runs(spark, ROWS)
    assert log.window().count() == 0
    parts = {"early": F.hour("started_at") < 2, "late": F.hour("started_at") >= 2}
    for name, which in parts.items():
        assert log.commit(name, rows.where(which))
    assert not log.commit("late", rows.where(parts["late"]))

    def summary(df):
        return {r["product"]: (r.requests, r.succeeded, r.timed, r.total_ms, r.max_ms)
                for r in df.collect()}
    want = {"a": (100, 99, 100, 4950.0, 99.0), "b": (2, 1, 0, None, None)}
    assert summary(log.window()) == want
    assert log.compact() and summary(log.window()) == want
    assert summary(log.window("2024-01-01 02:00:00", "2024-01-01 04:00:00")) == {"a": (40, 39, 40, 2000.0, 98.0)}
    bounds = {r["product"]: r for r in A.estimates(log.window()).collect()}
    assert bounds["a"].quantile_low <= 94 <= bounds["a"].quantile_high and bounds["b"].quantile_high is None
    assert A.estimates(log.hours()).count() == 7


def test_stored_sketches_start_the_search(spark, tmp_path):
    log, rows = A.SlaLog(spark, str(tmp_path / "sla")), runs(spark, ROWS)
    log.commit("all", rows)
    out = A.grouped_quantile(rows, ["product"], "duration_ms", 0.95, sketches=log.window(), small=5).collect()
    assert {r["product"]: r.quantile for r in out} == {"a": 94.0, "b": None}
