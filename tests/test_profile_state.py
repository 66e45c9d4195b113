"""The profile of a product that grows equals that of all its rows."""
import math
import shutil

import pytest
from pyspark.sql import functions as F

from meshwork.operators import profile as P
from meshwork.operators import quality as D
from meshwork.operators.profile_state import ProfileState

SCHEMA = "k long, t string, x double, d date, l array<int>, b boolean"


def rows(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi).select(
        (i % 7).alias("k"), F.when(i % 5 != 0, F.concat(F.lit("t"), (i % 3).cast("string"))).alias("t"),
        F.when(i % 11 == 0, F.lit(math.nan)).when(i % 13 == 0, None).otherwise((i % 17 - 8) / 4).alias("x"),
        F.date_add(F.lit("2024-01-01"), (i % 4).cast("int")).alias("d"), F.array((i % 2).cast("int")).alias("l"),
        (i % 6 == 0).alias("b"))


def table(df, *columns):
    out = df.select(*columns) if columns else df
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(map(near, r)) for r in out.collect()), key=repr)


@pytest.fixture
def state(spark, tmp_path):
    return ProfileState(spark, str(tmp_path / "p"), "p", spark.createDataFrame([], SCHEMA).schema)


def check(spark, state, everything):
    allowed = spark.createDataFrame([("t", ["t0", "t1"])], "column_name string, allowed_values array<string>")
    assert table(state.profile(allowed)) == table(P.column_profile(everything, allowed=allowed))
    columns = [c for c in P.column_stats(everything).columns]
    assert table(state.column_stats(), *columns) == table(P.column_stats(everything), *columns)
    assert table(state.duplicate_rows()) == table(D.duplicate_rows("p", everything))
    assert table(state.top_values(3)) == table(P.top_values(P.value_counts(everything), 3))
    assert table(state.completeness()) == table(D.completeness_dimension("p", everything))
    assert table(state.rare_values()) == table(D.rare_value_columns("p", everything))
    assert table(state.column_quality()) == table(D.column_quality("p", everything))
    x = everything.where(~F.isnan("x")).agg(F.stddev_samp("x")).first()[0]
    got = {r.column_name: r.std_value for r in state.deviations().collect()}
    assert math.isclose(got["x"], x, rel_tol=1e-9) and set(got) == {"k", "x"}


def test_appends_read_the_last_batch_only(spark, state, tmp_path):
    parts = [rows(spark, 0, 300), rows(spark, 300, 500), rows(spark, 100, 160)]
    for i, part in enumerate(parts):
        part.write.parquet(str(tmp_path / f"in{i}"))
        assert state.commit(f"batch {i}", spark.read.parquet(str(tmp_path / f"in{i}")))
        shutil.rmtree(tmp_path / f"in{i}")  # earlier batches cannot be read again
        assert not state.commit(f"batch {i}", spark.range(0).select(F.raise_error(F.lit("read")).alias("k")))
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    check(spark, state, everything)
    assert state.compact()
    check(spark, state, everything)


def test_removed_rows_are_taken_off(spark, state):
    state.commit("a", rows(spark, 0, 200))
    state.commit("b", added=rows(spark, 200, 250), removed=rows(spark, 0, 60))
    check(spark, state, rows(spark, 60, 250))
    state.compact()
    state.commit("c", removed=rows(spark, 60, 250))
    assert state.value_counts().count() == 0 and state.duplicate_rows().first().row_count == 0
    assert table(state.profile(), "column_name", "row_count", "distinct_count") == table(
        state.empty.transform(P.column_profile), "column_name", "row_count", "distinct_count")


def test_columns_are_taken_by_name_and_type(spark, state):
    df = rows(spark, 0, 50)
    state.commit("a", df.select("b", "l", F.col("k").cast("int").alias("k"), "d", "x", "t", F.lit(1).alias("more")))
    check(spark, state, df)
