"""Duplicate keys, fingerprints and quantile sketches: the same results from
fewer and cheaper steps."""
from pyspark.sql import functions as F

from meshwork.operators import quality as D
from meshwork.operators.fingerprint import content_fingerprint
from meshwork.operators.quantiles import exact_quantiles


def test_nulls_in_other_columns_are_other_rows(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (None, None)], "a int, b int")
    got = D.duplicate_rows("p", df).first()
    assert (got.row_count, got.duplicate_rows) == (4, 1)
    assert tuple(got)[:5] == tuple(D.duplicate_rows("p", df, exact=True).first())[:5]


def test_the_fingerprint_keeps_its_value(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (None, "a", -0.0), (3, None, float("nan")), (3, None, None)], "i int, s string, d double")
    df = df.unionByName(df)
    first, second, nulls = D.row_key(df)
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    sums = df.select(first, second, nulls).agg(F.count("*").alias("row_count"), wide("_h1", "_nm").alias("a"), wide("_nm", "_h2").alias("b"))
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    old = sums.select(F.sha2(F.concat_ws("|", F.lit(columns), "row_count", "a", "b"), 256)).first()[0]
    assert content_fingerprint("p", df).first().fingerprint == old


def test_ranks_of_one_band_share_a_sketch(spark, monkeypatch):
    made, sketch = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: made.append(a) or sketch(*a))
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("x"), (F.col("id") % 3).alias("y"))
    got = {(r.column_name, r.p): r.value for r in exact_quantiles(df, ["x", "y"], [0.25, 0.75], small=500).collect()}
    assert got == {("x", 0.25): 1249.75, ("x", 0.75): 3749.25, ("y", 0.25): 0.0, ("y", 0.75): 2.0}
    assert sum(len(a[1]) for a in made) >= 12 and len(made) <= 4
