"""Service levels of products: availability and query time (C9, SLA part).

``runs(product, started_at, duration_ms, ok)`` is the run log, one row per
request. Its hourly summary is small and mergeable: counts and a KLL sketch of
the durations per product and hour. ``SlaLog`` keeps such summaries per batch
(see ``sources.commit_log``), so that a window of any length is read from
summaries alone. The sketch bounds a quantile; the exact one is found by
looking at the rows inside the bounds only (``grouped_quantile``).

A quantile is the value of nearest rank: the least value that at least the
share ``q`` of the values don't exceed. Runs without a duration (null or NaN)
count for availability, not for query time; ``ok`` null counts as failed. A
product without runs has null results, and its checks are null: unknown.
"""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import stored
from ..sources.commit_log import CommitLog

#: Sketch size: an hour's sketch of k values is off by about 1.3 / k of the
#: rows either way (one in a thousand here); the brackets allow four times that.
SKETCH_K = 4096
_MARGIN = 6 / SKETCH_K
GRID = 512
HOUR_SCHEMA = ("product string, hour timestamp, requests long, succeeded long, timed long, "
               "total_ms double, max_ms double, sketch binary")


def _duration(column="duration_ms"):
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def hourly(runs: DataFrame) -> DataFrame:
    """Summary per product and hour: one shuffle of partial summaries."""
    rows = runs.select("product", F.date_trunc("hour", "started_at").alias("hour"),
                       F.coalesce("ok", F.lit(False)).alias("ok"), _duration().alias("ms"))
    return rows.groupBy("product", "hour").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("succeeded"), F.count("ms").alias("timed"),
        F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"),
        F.kll_sketch_agg_double("ms", SKETCH_K).alias("sketch"))


def merge_hours(hours: DataFrame, *keys: str) -> DataFrame:
    """Summaries merged per ``keys`` (product and hour, or product alone)."""
    return hours.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("succeeded").alias("succeeded"), F.sum("timed").alias("timed"),
        F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double(F.when(F.col("timed") > 0, F.col("sketch")), SKETCH_K).alias("sketch"))


class SlaLog:
    """Hourly summaries of a run log, appended batch by batch; a batch that
    is written again counts once."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = CommitLog(spark, path, HOUR_SCHEMA)

    def commit(self, batch_id: str, runs: DataFrame) -> bool:
        return self.log.commit(batch_id, hourly(runs))

    def hours(self, since=None, until=None) -> DataFrame:
        """Summaries per product and hour, ``since`` <= hour < ``until``."""
        rows = self.log.read()
        if since is not None:
            rows = rows.where(F.col("hour") >= F.lit(since).cast("timestamp"))
        if until is not None:
            rows = rows.where(F.col("hour") < F.lit(until).cast("timestamp"))
        return merge_hours(rows, "product", "hour")

    def window(self, since=None, until=None) -> DataFrame:
        return merge_hours(self.hours(since, until), "product")

    def compact(self) -> bool:
        """Merge the batches' summaries of the same product and hour."""
        return self.log.compact(lambda rows: merge_hours(rows, "product", "hour"))


def estimates(summary: DataFrame, q: float = 0.95) -> DataFrame:
    """``summary`` with the availability in percent and a lower and an upper
    bound of the duration's quantile, from the sketch."""
    at = lambda r: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(r)))
    return summary.withColumns({
        "availability_percent": F.col("succeeded") / F.col("requests") * 100,
        "quantile_low": at(max(q - _MARGIN, 0.0)), "quantile_high": at(min(q + _MARGIN, 1.0))}).drop("sketch")


def grouped_quantile(rows: DataFrame, keys: list[str], value: str, q: float, sketches: DataFrame | None = None,
                     small: int = 1_000_000) -> DataFrame:
    """(keys, n, quantile): the exact value of nearest rank per group.

    The wanted rank lies in an open band of values that shrinks: a sketch of
    the band gives two values around the rank, and exact counts say whether
    the rank falls on one of them (solved, however many rows share it) or
    between, below or above them. Only bands of at most ``small`` rows are
    counted by value and ranked. ``sketches`` (keys, sketch), if given, save
    the first sketch. No group is gathered whole; a group with a third of all
    rows costs a partial count per task. Rows that are null or NaN don't
    count; groups of such rows alone have n = 0 and a null quantile.
    """
    data = rows.select(*keys, _duration(value).alias("v"))
    rank = F.greatest(F.ceil(F.lit(Decimal(str(q))) * F.col("n")), F.lit(1)).cast("long")
    none = F.lit(None).cast("double")
    state = stored(data.groupBy(*keys).agg(F.count("v").alias("n")).select(
        *keys, "n", rank.alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"),
        F.col("n").alias("inside"), none.alias("quantile")))
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    todo = (F.col("inside") > small) & F.col("quantile").isNull()
    joined = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]

    def band(of):
        """Rows of the groups of ``of`` inside their band; null keys are keys."""
        return data.where("v is not null").alias("a").join(of.alias("b"), joined).select(
            "a.v", *(F.col(f"b.{c}") for c in of.columns)).where(inside)

    # a sketch gives values at fixed ranks only
    ranks = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    while not state.where(todo).isEmpty():
        open_ = state.where(todo)
        if sketches is None:
            found = band(open_).groupBy(*keys).agg(F.kll_sketch_agg_double("v", SKETCH_K).alias("sketch"))
        else:
            found, sketches = sketches.select(*keys, "sketch"), None
        within = (F.col("rank") - F.col("below")) / F.col("inside")
        at = lambda step: F.get("grid", F.least(F.greatest(step, F.lit(0)), F.lit(GRID)).cast("int"))
        ends = open_.alias("a").join(found.alias("b"), joined).select(
            *(F.col(f"a.{c}") for c in open_.columns), F.kll_sketch_get_quantile_double("sketch", ranks).alias("grid"))
        ends = ends.select(*open_.columns, at(F.floor((within - _MARGIN) * GRID)).alias("x"),
                           at(F.ceil((within + _MARGIN) * GRID)).alias("y"))
        ends = stored(ends)
        counts = band(ends).groupBy(*keys).agg(
            *(F.count_if(c).alias(n) for n, c in (("lt_x", F.col("v") < F.col("x")), ("le_x", F.col("v") <= F.col("x")),
                                                  ("lt_y", F.col("v") < F.col("y")), ("le_y", F.col("v") <= F.col("y")))))
        want = F.col("rank") - F.col("below")
        below_x, on_x, between, on_y = (want <= F.col(c) for c in ("lt_x", "le_x", "lt_y", "le_y"))

        def choose(a, b, c, d, e):
            """By where the rank is: below x, on x, between, on y, above y."""
            return F.when(below_x, a).when(on_x, b).when(between, c).when(on_y, d).otherwise(e)

        low, high, x, y, below = (F.col(c) for c in ("low", "high", "x", "y", "below"))
        next_ = ends.alias("a").join(counts.alias("b"), joined).select(
            *(F.col(f"a.{c}") for c in ends.columns), "lt_x", "le_x", "lt_y", "le_y").select(
            *keys, "n", "rank", choose(low, low, x, x, y).alias("low"), choose(x, high, y, high, high).alias("high"),
            choose(below, below, below + F.col("le_x"), below + F.col("le_x"), below + F.col("le_y")).alias("below"),
            choose(F.col("lt_x"), F.col("inside"), F.col("lt_y") - F.col("le_x"), F.col("inside"),
                   F.col("inside") - F.col("le_y")).alias("inside"),
            choose(none, x, none, y, none).alias("quantile"))
        state = stored(state.where(~todo).unionByName(next_))
    rest = band(state.where(F.col("quantile").isNull() & (F.col("n") > 0)))
    from pyspark.sql import Window
    upto = F.sum("count").over(Window.partitionBy(*keys).orderBy("v"))
    ranked = rest.groupBy(*keys, "rank", "below", "v").count().withColumn("upto", F.col("below") + upto)
    last = ranked.where("upto >= rank").groupBy(*keys).agg(F.min("v").alias("v"))
    return state.alias("a").join(last.alias("b"), joined, "left").select(
        *(F.col(f"a.{k}") for k in keys), "a.n", F.coalesce("a.quantile", "b.v").alias("quantile"))


def service_levels(runs: DataFrame, keys: tuple[str, ...] = ("product",), q: float = 0.95) -> DataFrame:
    """(keys, requests, availability_percent, query_time_ms): share of
    requests that succeeded and exact quantile of the durations."""
    rows = runs.select(*keys, F.coalesce("ok", F.lit(False)).alias("ok"), "duration_ms")
    shares = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"),
                                     (F.count_if("ok") / F.count(F.lit(1)) * 100).alias("availability_percent"))
    times = grouped_quantile(rows, list(keys), "duration_ms", q)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return shares.alias("a").join(times.alias("b"), same, "left").select(
        "a.*", F.col("b.quantile").alias("query_time_ms"))


def check_sla(contracts: DataFrame, levels: DataFrame) -> DataFrame:
    """The contract's availability and query time against the levels of
    its product, in the columns of ``contract.check_expectations``."""
    def arm(name, threshold, actual, passed):
        return F.struct(F.lit(name).alias("expectation"), F.col(threshold).cast("double").alias("threshold"),
                        F.col(actual).cast("double").alias("actual"), passed.alias("passed"))
    arms = F.array(
        arm("availability_percent", "c.availability_percent", "l.availability_percent",
            F.col("l.availability_percent") >= F.col("c.availability_percent")),
        arm("max_query_time_ms", "c.max_query_time_ms", "l.query_time_ms",
            F.col("l.query_time_ms") <= F.col("c.max_query_time_ms")))
    return contracts.alias("c").join(levels.alias("l"), F.col("c.product") == F.col("l.product"), "left").select(
        F.col("c.product").alias("product"), F.inline(arms))
