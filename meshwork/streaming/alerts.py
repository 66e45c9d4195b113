"""Quality-drop alerts as keyed state, for scores that come late (M5).

The state of a product is its last score and the scores that wait for their
turn. A score waits until the watermark, ``delay`` behind the newest score
seen, has passed it; then scores are taken in order of time, so a score that
is late by less than ``delay`` gives the alerts of the batch operator. A score
behind the watermark when it arrives is left out (Spark counts such rows in
the progress of the query). The state of a product without scores for
``ttl`` is dropped; its next score is then its first.

State and timers live in the checkpoint with the RocksDB store, one small
entry per waiting score, and survive restarts; each epoch's alerts are
written to a folder of their own, so an epoch that is run again overwrites
what it left. Scores of a product with the same time are taken from the
highest to the lowest.
"""
from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.catalog import QUALITY_DROP_POINTS
from ..plans.session import let_workers_import
from .logs import SCORE_SCHEMA, _ckpt, read_log

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DropProcessor(StatefulProcessor):
    """Emits (product, assessed_at, previous, score) for every drop."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        # times are microseconds, the order number keeps scores of one time apart
        self.last = handle.getValueState("last", "at long, score double")
        self.waiting = handle.getMapState("waiting", "at long, score double", "n long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for row in rows:
            at = int(row.micros)
            entry = (at, float(row.score))
            self.waiting.updateValue(entry, ((self.waiting.getValue(entry)[0] if self.waiting.containsKey(entry) else 0) + 1,))
            first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        pending = [(tuple(k), self.waiting.getValue(tuple(k))[0]) for k in list(self.waiting.keys())]
        due = sorted((p for p in pending if p[0][0] < mark), key=lambda p: (p[0][0], -p[0][1]))
        last = self.last.get()
        if not due:
            if self.ttl_ms and last is not None and not pending and last[0] + self.ttl_ms * 1000 < mark:
                self.last.clear()
            elif pending:
                self.handle.registerTimer(min(p[0][0] for p in pending) // 1000 + 1)
            return iter([])
        out, previous = [], None if last is None else (last[0], last[1])
        if previous is not None and self.ttl_ms and due[0][0][0] > previous[0] + self.ttl_ms * 1000:
            previous = None
        for (at, score), n in due:
            if previous is not None and self.ttl_ms and at > previous[0] + self.ttl_ms * 1000:
                previous = None
            for _ in range(n):
                if previous is not None and score < previous[1] - QUALITY_DROP_POINTS:
                    moment = datetime.datetime.fromtimestamp(at / 1e6, datetime.timezone.utc).replace(tzinfo=None)
                    out.append(Row(product=key[0], micros=at, previous=previous[1], score=score))
                previous = (at, score)
            self.waiting.removeKey((at, score))
        self.last.update(previous)
        later = [p[0][0] for p in pending if p[0][0] >= mark]
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        elif self.ttl_ms:
            self.handle.registerTimer(previous[0] // 1000 + self.ttl_ms + 1)
        return iter(out)

    def close(self) -> None:
        pass


def drops(scores: DataFrame, delay: str = "1 hour", ttl_ms: int | None = None) -> DataFrame:
    """The drops of a stream of ``(product, assessed_at, score)``."""
    let_workers_import(scores.sparkSession)
    rows = scores.where("product is not null and assessed_at is not null and score is not null").withWatermark(
        "assessed_at", delay).withColumn("micros", F.unix_micros("assessed_at"))
    found = rows.groupBy("product").transformWithState(
        DropProcessor(ttl_ms), "product string, micros long, previous double, score double", "Append", "eventTime")
    return found.select("product", F.timestamp_micros("micros").alias("assessed_at"), "previous", "score")


def alerts(drop_rows: DataFrame) -> DataFrame:
    """Drops as alerts, in the columns of ``catalog.quality_drop_alerts``."""
    number = lambda c: F.format_string("%.1f", F.round(c, 1))
    return drop_rows.select(
        F.lit("quality_drop").alias("alert_type"), F.lit("warning").alias("severity"), "product", "assessed_at",
        F.format_string("Quality dropped from %s to %s", number("previous"), number("score")).alias("message"))


def start_late_alert_stream(spark: SparkSession, score_path: str, alert_path: str, delay: str = "1 hour",
                            ttl_ms: int | None = None, max_files_per_trigger: int | None = None,
                            available_now: bool = True):
    """Alerts (folders ``epoch=<n>`` in ``alert_path``) over a log of scores
    that may be up to ``delay`` late."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = drops(read_log(spark, score_path, SCORE_SCHEMA, max_files_per_trigger), delay, ttl_ms)

    def write(batch: DataFrame, epoch: int):
        alerts(batch).write.mode("overwrite").parquet(f"{alert_path}/epoch={epoch}")

    w = stream.writeStream.outputMode("append").option("checkpointLocation", _ckpt(spark, "late_quality_alerts")).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
