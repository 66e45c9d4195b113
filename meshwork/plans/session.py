"""Spark session set-up and lineage cutting.

The session settings aim at large inputs: adaptive execution re-plans joins
and coalesces shuffle partitions at run time, skew-join splitting is on, and
broadcast joins are only chosen by Spark when the measured size of a side is
below ``spark.sql.autoBroadcastJoinThreshold``.
"""
from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Jobs that one call submits at the same time.
JOBS_AT_ONCE = 8

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the status store keeps plan descriptions of past queries even with the
    # UI off; long-running sessions with large plans need small limits
    "spark.sql.ui.retainedExecutions": "20",
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "100",
    "spark.ui.retainedTasks": "5000",
}


def build_session(master: str | None = None, app_name: str = "meshwork",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    ``shuffle_partitions`` should be sized so one partition stays near the
    advisory size at the target scale; AQE coalesces small ones anyway.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package when the driver
    found it by ``sys.path`` only. A cluster has it installed or gets it with
    ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def together(*jobs):
    """The results of independent functions that run Spark jobs, submitted at
    the same time: small jobs don't wait for each other's stragglers."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    session = SparkSession.getActiveSession()
    with ThreadPoolExecutor(min(len(jobs), JOBS_AT_ONCE)) as pool:
        # threads take the session's job groups and properties with them
        running = [pool.submit(inheritable_thread_target(session)(job) if session else job) for job in jobs]
        return [f.result() for f in running]


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring the context with it.

    The cluster names the folder in ``spark.checkpoint.dir``; it is read from
    the session. Only a local-mode session (tests) without that setting gets
    a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        configured = tempfile.mkdtemp(prefix="meshwork-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    Used where one intermediate feeds many outputs: a lost executor then
    re-reads the checkpoint instead of recomputing the whole lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read
    back, so that Spark plans with its true size."""
    spark = df.sparkSession
    path = intermediate_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Application -> folders of intermediate tables written by it.
_written: dict[str, list[str]] = {}


def intermediate_path(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder for an intermediate table."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/meshwork-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has written;
    their number. For callers that have written out what they want: results
    are lazy and read these tables."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
