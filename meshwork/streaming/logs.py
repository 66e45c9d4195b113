"""The append-only logs as Structured Streaming jobs.

The reference keeps usage records, quality scores and lineage as lists that
only grow. Here they are file-backed tables that new batches are appended
to, and the statistics over them are incremental streaming queries:

* usage counts per product and per column: a streaming aggregation whose
  state has one row per product / column (small and bounded). Every
  micro-batch writes a snapshot folder of its own; ``read_snapshot`` takes
  the newest one that is complete, so no reader sees half of one;
* quality-drop alerts: the last score of each product is the state. Each
  micro-batch is put behind it and handed to the batch operator, whose
  window sorts a whole product (in Spark, spilling if it must) whatever the
  order in which its rows arrived. Alerts and state are written per epoch,
  so an epoch that is run again overwrites what it left.

Checkpoints live under the shared folder named by ``spark.checkpoint.dir``
so a restarted job resumes after an executor or driver loss.
"""
from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import USAGE_SCHEMA, commit_usage, quality_drop_alerts, usage_rows
from ..plans.session import checkpoint_dir

SCORE_SCHEMA = "product string, assessed_at timestamp, score double"


def _ckpt(spark: SparkSession, name: str) -> str:
    return posixpath.join(checkpoint_dir(spark), "streams", name)


def _complete(spark: SparkSession, folder: str) -> dict[int, str]:
    """Number -> path of the ``epoch=<number>`` folders that were written to
    the end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return {}
    found = {}
    for s in fs.listStatus(top):
        path = s.getPath()
        if path.getName().startswith("epoch=") and fs.exists(hadoop.Path(path, "_SUCCESS")):
            found[int(path.getName()[6:])] = path.toString()
    return found


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete snapshot of ``folder``."""
    found = _complete(spark, folder)
    return spark.read.parquet(found[max(found)])


def _drop_old(spark: SparkSession, folder: str, keep: int = 3) -> None:
    """Delete all but the newest complete snapshots (a reader may still use
    the last ones)."""
    found = _complete(spark, folder)
    for n in sorted(found)[:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(found[n])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_log(df: DataFrame, path: str) -> None:
    """Append one batch of log rows (usage, scores, lineage) to its table."""
    df.write.mode("append").parquet(path)


def start_usage_recording(runs: DataFrame, path: str, name: str, available_now=True):
    """Record the usage of a stream of runs (see ``catalog.usage_rows``): one
    committed batch per epoch, so an epoch that is run again counts once.
    ``name`` tells the streams that write to the same log apart."""
    def run(batch: DataFrame, epoch: int):
        commit_usage(usage_rows(batch), path, f"{name}/{epoch}")

    w = runs.writeStream.option("checkpointLocation", _ckpt(runs.sparkSession, f"usage_recording_{name}")).foreachBatch(run)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_log(spark: SparkSession, path: str, schema: str,
             max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def usage_product_counts(usage: DataFrame) -> DataFrame:
    """Running number of queries per product (streaming or batch)."""
    return usage.groupBy("product").agg(F.count(F.lit(1)).alias("queries"))


def usage_column_counts(usage: DataFrame) -> DataFrame:
    """Running number of uses per column (streaming or batch)."""
    return (usage.select(F.explode("columns_accessed").alias("column_name"))
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("uses")))


def start_usage_counts(spark: SparkSession, log_path: str, out_path: str,
                       max_files_per_trigger: int | None = None, available_now=True):
    """Keep ``out_path/products`` and ``out_path/columns`` equal to the
    counts over everything appended to the usage log so far."""
    stream = read_log(spark, log_path, USAGE_SCHEMA, max_files_per_trigger)

    def write_snapshot(kind):
        def run(batch: DataFrame, epoch: int):
            folder = posixpath.join(out_path, kind)
            batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
            _drop_old(spark, folder)
        return run

    queries = []
    for kind, agg in (("products", usage_product_counts), ("columns", usage_column_counts)):
        w = (agg(stream).writeStream.outputMode("complete")
             .option("checkpointLocation", _ckpt(spark, f"usage_{kind}"))
             .foreachBatch(write_snapshot(kind)))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
        queries.append(w.start())
    return queries


def start_alert_stream(spark: SparkSession, score_path: str, alert_path: str,
                       max_files_per_trigger: int | None = None, available_now=True):
    """Streaming quality-drop alerts (folders ``epoch=<n>`` in ``alert_path``).

    Scores of a product must arrive in time order across micro-batches (an
    append-only log); within a micro-batch any order will do.
    """
    stream = read_log(spark, score_path, SCORE_SCHEMA, max_files_per_trigger)
    place = _ckpt(spark, "quality_alerts")

    def run(batch: DataFrame, epoch: int):
        rows = batch.select("product", "assessed_at", "score")
        before = [n for n in _complete(spark, f"{place}-state") if n < epoch]
        if before:
            rows = spark.read.parquet(f"{place}-state/epoch={max(before)}").unionByName(rows)
        quality_drop_alerts(rows).write.mode("overwrite").parquet(f"{alert_path}/epoch={epoch}")
        last = rows.groupBy("product").agg(F.max(F.struct("assessed_at", "score")).alias("last"))
        last.select("product", "last.*").write.mode("overwrite").parquet(f"{place}-state/epoch={epoch}")
        _drop_old(spark, f"{place}-state")

    w = stream.writeStream.option("checkpointLocation", place).foreachBatch(run)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
