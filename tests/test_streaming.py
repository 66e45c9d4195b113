"""Streaming logs give the same answers as the batch operators."""
import datetime as dt

from pyspark.sql import functions as F

from meshwork.operators import catalog as M
from meshwork.plans import catalog_suite as CS
from meshwork.streaming import logs as L

SF = "/root/testdata/sf0.001"


def test_usage_counts_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "_ckpt", lambda s, n: str(tmp_path / n))
    usage = CS.usage_log(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    log = str(tmp_path / "usage")
    for et in ("click", "view", "signup", "purchase", "error"):  # several appends
        L.append_log(usage.where(F.col("product") == et), log)
    out = str(tmp_path / "out")
    for q in L.start_usage_counts(spark, log, out, max_files_per_trigger=2):
        q.awaitTermination()
    got = {r.product: r.queries for r in L.read_snapshot(spark, f"{out}/products").collect()}
    want = {r.product: r.queries for r in M.top_products(usage, 100).collect()}
    assert got == want
    cols = {r.column_name: r.uses for r in L.read_snapshot(spark, f"{out}/columns").collect()}
    assert cols == {r.column_name: r.uses for r in M.top_columns(usage, 100).collect()}


def test_alert_stream_matches_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "_ckpt", lambda s, n: str(tmp_path / n))
    hist = CS.score_history(spark, SF).withColumn(
        "assessed_at", F.col("assessed_at").cast("timestamp"))
    path = str(tmp_path / "scores")
    days = sorted(r.d for r in hist.select(F.col("assessed_at").alias("d")).distinct().collect())
    for d in days:  # one append per day: the log grows in time order
        L.append_log(hist.where(F.col("assessed_at") == d), path)
    alerts = str(tmp_path / "alerts")
    L.start_alert_stream(spark, path, alerts, max_files_per_trigger=3).awaitTermination()
    got = sorted((r.product, r.assessed_at, r.message) for r in spark.read.parquet(alerts).collect())
    want = sorted((r.product, r.assessed_at, r.message)
                  for r in M.quality_drop_alerts(hist).collect())
    assert got == want and len(want) > 0


def test_alerts_of_a_large_batch_in_any_order(spark, tmp_path, monkeypatch):
    """One product, more rows than an Arrow batch holds, shuffled within the
    micro-batch; a second batch goes on from the first."""
    monkeypatch.setattr(L, "_ckpt", lambda s, n: str(tmp_path / n))
    n = 25_000
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    rows = spark.range(n).select(F.lit("p").alias("product"), at.alias("assessed_at"),
                                 (F.pmod(F.xxhash64("id"), F.lit(60)) + 40).cast("double").alias("score"))
    path, alerts = str(tmp_path / "scores"), str(tmp_path / "alerts")
    for part in ("id < 20000", "id >= 20000"):
        ids = spark.range(n).where(part)
        own = rows.join(ids.select(at.alias("assessed_at")), "assessed_at", "left_semi")
        L.append_log(own.orderBy(F.xxhash64("assessed_at")).coalesce(1), path)
        L.start_alert_stream(spark, path, alerts).awaitTermination()
    got = sorted((r.assessed_at, r.message) for r in spark.read.parquet(alerts).collect())
    want = sorted((r.assessed_at, r.message) for r in M.quality_drop_alerts(rows).collect())
    assert got == want and len(want) > 1000
