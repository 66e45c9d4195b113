"""Alerts over late scores and restarts equal the batch operator."""
import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import catalog as M
from meshwork.streaming import alerts as A
from meshwork.streaming import logs as L


def scores(spark, rows):
    return spark.createDataFrame(rows, "product string, minute long, score double").select(
        "product", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60).alias("assessed_at"), "score")


def run(spark, tmp_path, batches, **options):
    """Each batch is appended to the log and followed by a run of the stream
    from its checkpoint (a restart)."""
    path, out = str(tmp_path / "scores"), str(tmp_path / "alerts")
    for rows in batches:
        L.append_log(scores(spark, rows).coalesce(1), path)
        A.start_late_alert_stream(spark, path, out, **options).awaitTermination(120)
    return sorted((r["product"], r.assessed_at, r.message) for r in spark.read.parquet(out).collect())


def batch(spark, rows):
    return sorted((r["product"], r.assessed_at, r.message) for r in M.quality_drop_alerts(scores(spark, rows)).collect())


@pytest.fixture(autouse=True)
def places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "_ckpt", lambda s, n: str(tmp_path / "ckpt" / n))
    monkeypatch.setattr(A, "_ckpt", lambda s, n: str(tmp_path / "ckpt" / n))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_scores_late_by_less_than_the_delay(spark, tmp_path):
    rng = random.Random(3)
    rows = [(p, m, float(rng.randint(30, 100))) for p in ("a", "b", "c") for m in rng.sample(range(300), 60)]
    # within a window of 50 minutes any order, across micro-batches too
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 50))
    parts = [rows[k:k + 45] for k in range(0, len(rows), 45)]
    end = [("clock", 10_000, 50.0)], [("clock", 20_000, 50.0)]
    got = run(spark, tmp_path, [*parts, *end], delay="1 hour")
    assert got == batch(spark, rows) and len(got) > 20


def test_scores_behind_the_watermark_and_forgotten_products(spark, tmp_path):
    batches = [[("a", 0, 90.0), ("a", 10, 85.0)], [("clock", 500, 1.0)],
               [("a", 5, 10.0), ("a", 520, 60.0)],  # minute 5 is too late: 85 -> 60 is the drop
               [("clock", 1000, 1.0)], [("a", 9000, 10.0)],  # 60 -> 10, but a was forgotten by then
               [("a", 9010, 99.0), ("a", 9020, 20.0), ("a", 9020, 99.0)], [("clock", 20_000, 1.0)], [("clock", 30_000, 1.0)]]
    got = run(spark, tmp_path, batches, delay="1 hour", ttl_ms=24 * 3600 * 1000)
    assert [m for _, _, m in got] == ["Quality dropped from 85.0 to 60.0", "Quality dropped from 99.0 to 20.0"]
