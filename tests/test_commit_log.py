"""A batch counts once, whatever happened to its attempts."""
import pytest
from pyspark.sql import functions as F

from meshwork.operators import catalog as M
from meshwork.sources.commit_log import CommitLog
from meshwork.streaming import logs as L

SCHEMA = "k string, n long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(log):
    return sorted(tuple(r) for r in log.read().collect())


def test_retries_dead_attempts_and_rival_writers(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), SCHEMA)
    assert log.read().columns == ["k", "n"] and log.read().count() == 0 and log.batches() == []
    assert log.commit("a/1 .x", rows(spark, ("a", 1), ("a", 1)))
    assert not log.commit("a/1 .x", rows(spark, ("other", 9)))
    rows(spark, ("dead", 1)).write.parquet(f"{log.path}/data/b.0dead")  # no marker was set
    assert content(log) == [("a", 1), ("a", 1)]
    assert log.commit("b", rows(spark, ("b", 2)))
    # a second writer of the same batch that had looked before the first was done
    rows(spark, ("b", 2)).write.parquet(f"{log.path}/data/b.zz")
    log._mark("commits/b.zz")
    assert content(log) == [("a", 1), ("a", 1), ("b", 2)] and log.batches() == ["a/1 .x", "b"]
    assert content(CommitLog(spark, log.path, SCHEMA)) == content(log)
    assert sorted(tuple(r) for r in log.read(["b"]).collect()) == [("b", 2)]
    with pytest.raises(KeyError):
        log.read(["c"])
    with pytest.raises(ValueError):
        log.commit("", rows(spark))


def test_columns_in_any_order_and_empty_batches(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), SCHEMA)
    assert log.commit("1", spark.createDataFrame([(5, "x", True)], "n int, k string, more boolean"))
    assert log.commit("2", rows(spark))
    assert content(log) == [("x", 5)] and log.batches() == ["1", "2"]


def test_compaction_keeps_the_rows_and_the_batches(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), SCHEMA)
    assert not log.compact()
    for i in range(4):
        log.commit(str(i), rows(spark, ("k", i), ("k", 10)))
    before = log.read()  # a reader from before the compaction
    assert log.compact(lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    assert content(log) == [("k", 46)] and log.batches() == ["0", "1", "2", "3"]
    assert before.count() == 8
    assert not log.commit("2", rows(spark, ("k", 100)))
    log.commit("4", rows(spark, ("z", 1)))
    assert content(log) == [("k", 46), ("z", 1)]
    with pytest.raises(KeyError):
        log.read(["2"])
    assert log.compact()
    log._mark("compacted/7.broken", '["0", "1"')  # a writer that died in its marker
    assert content(log) == [("k", 46), ("z", 1)] and log.vacuum() == 6
    assert content(log) == [("k", 46), ("z", 1)]


def test_usage_of_a_retried_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "usage")
    usage = spark.createDataFrame([("telco", "q1", ["Churn"], "analyst", None)] * 11, M.USAGE_SCHEMA)
    assert M.commit_usage(usage, path, "run 1") and not M.commit_usage(usage, path, "run 1")
    assert M.usage_summary(M.committed_usage(spark, path).read()).first().total_queries == 11


def test_epochs_of_a_stream_that_are_run_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "_ckpt", lambda s, n: str(tmp_path / n))
    schema = ("query string, products array<string>, relevant_columns map<string, array<string>>, "
              "user_role string, timestamp timestamp")
    for i in range(3):
        spark.createDataFrame([(f"q{i}", ["a", "b"], {"a": ["x"], "b": ["y"]}, None, None)], schema) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    path = str(tmp_path / "usage")

    def record(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
        L.start_usage_recording(stream, path, name).awaitTermination()

    record("s")
    log = M.committed_usage(spark, path)
    assert log.read().count() == 6 and len(log.batches()) == 3
    # the stream lost its checkpoint and runs its epochs again
    monkeypatch.setattr(L, "_ckpt", lambda s, n: str(tmp_path / "fresh" / n))
    record("s")
    assert log.read().count() == 6 and len(log.batches()) == 3
