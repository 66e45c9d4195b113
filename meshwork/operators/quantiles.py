"""Exact quantiles with linear interpolation, without unbounded groups.

``percentile`` over a whole column merges every distinct value into one
aggregation buffer, which does not scale. Here each wanted rank of a column
keeps an open value band known to contain it and the exact number of values
up to the band:

1. Start with the whole column as the band.
2. While a band holds more than ``small`` values, narrow it. One wide
   aggregate over the original columns sketches the band with
   ``percentile_approx`` (memory bounded by the accuracy) at the rank plus
   and minus a margin; a second counts exactly the values below and equal to
   both ends. A rank that falls on an end is solved, however many rows share
   that value; otherwise the band between the ends, without them, is the
   next one. A sketch that missed the rank is repeated with four times the
   accuracy. Each round shrinks a band about ``accuracy / 16`` times.
3. Rows inside the final bands (at most ``small`` each) are the only ones
   that are exploded; they are counted by value and ranked in a window.

The bookkeeping between rounds and the results are a handful of numbers per
column and are read on the driver; the data itself never leaves the executors.

Interpolation: ``h = (n - 1) * p``, value ``lo + (hi - lo) * (h - floor(h))``,
the definition of pandas ('linear'), Spark ``percentile`` and DuckDB
``quantile_cont``.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SMALL = 1_000_000
DEFAULT_ACCURACY = 10_000
#: Aggregates that one job computes.
PER_JOB = 120


@dataclass
class _Target:
    """A wanted rank of a column and the open band that holds it."""
    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    accuracy: int = DEFAULT_ACCURACY
    value: float | None = None

    def number(self):
        x = F.col(f"`{self.column}`").cast("double")
        return F.when(~F.isnan(x), x)

    def band(self):
        """The value where it lies in the band, else null."""
        x = self.number()
        inside = x.isNotNull()
        if self.low is not None:
            inside = inside & (x > F.lit(self.low))
        if self.high is not None:
            inside = inside & (x < F.lit(self.high))
        return F.when(inside, x)

    def ends(self):
        """Shares of the band's values around the rank."""
        at, margin = (self.rank - self.below) / self.inside, 8.0 / self.accuracy
        return [max(at - margin, 0.0), min(at + 1 / self.inside + margin, 1.0)]

    def narrow(self, low, high, counts):
        """Take the ends of a sketch and the numbers of values below and up
        to each of them."""
        lt_low, le_low, lt_high, le_high = counts
        if lt_low <= self.rank < le_low:
            self.value = low
        elif lt_high <= self.rank < le_high:
            self.value = high
        elif le_low <= self.rank < lt_high:
            self.low, self.high, self.below, self.inside = low, high, le_low, lt_high - le_low
        else:
            self.accuracy *= 4


def _wide(df: DataFrame, aggregates: list) -> list:
    """One row of many aggregates, computed in jobs of bounded width."""
    out = []
    for i in range(0, len(aggregates), PER_JOB):
        part = [a.alias(f"a{j}") for j, a in enumerate(aggregates[i:i + PER_JOB])]
        out += list(df.agg(*part).first())
    return out


def exact_quantiles(df: DataFrame, columns, probs, small: int = DEFAULT_SMALL,
                    accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Return ``(column_name, p, value)`` for every column and probability.

    Columns without values give no row.
    """
    spark = df.sparkSession
    columns, probs = list(columns), [float(p) for p in probs]
    schema = "column_name string, p double, value double"
    if not columns or not probs:
        return spark.createDataFrame([], schema)
    counts = dict(zip(columns, _wide(df, [F.count(_Target(c, 0, 0).number()) for c in columns])))
    wanted, targets = [], {}
    for c in columns:
        for p in probs if counts[c] else []:
            h = (counts[c] - 1) * p
            ranks = (math.floor(h), min(math.floor(h) + 1, counts[c] - 1))
            wanted.append((c, p, *ranks, h - math.floor(h)))
            for r in ranks:
                targets.setdefault((c, r), _Target(c, r, counts[c], accuracy=accuracy))
    while wide := [t for t in targets.values() if t.value is None and t.inside > small]:
        # ranks of the same band share its sketch, and their ends are counted once
        sketches = {}
        for t in wide:
            sketches.setdefault((t.column, t.low, t.high, t.accuracy), []).append(t)
        found = _wide(df, [F.percentile_approx(own[0].band(), [e for t in own for e in t.ends()], own[0].accuracy)
                           for own in sketches.values()])
        pairs = [(t, *at[2 * i:2 * i + 2]) for own, at in zip(sketches.values(), found) for i, t in enumerate(own)]
        points = {(t.column, end): t.number() for t, low, high in pairs for end in (low, high)}
        got = _wide(df, [test for (_, end), x in points.items()
                         for test in (F.count_if(x < F.lit(end)), F.count_if(x <= F.lit(end)))])
        counts_at = {point: got[2 * i:2 * i + 2] for i, point in enumerate(points)}
        for t, low, high in pairs:
            t.narrow(low, high, counts_at[t.column, low] + counts_at[t.column, high])
    found = {(t.column, t.rank): t.value for t in targets.values() if t.value is not None}
    open_ = [t for t in targets.values() if t.value is None]
    if open_:
        # ranks of the same band share its rows
        bands = {}
        for t in open_:
            bands.setdefault((t.column, t.low, t.high, t.below), []).append(t)
        arms = F.array(*[F.struct(F.lit(i).alias("band"), own[0].band().alias("v"))
                         for i, own in enumerate(bands.values())])
        some = reduce(or_, (own[0].band().isNotNull() for own in bands.values()))
        band = (df.where(some).select(F.inline(arms)).where(F.col("v").isNotNull())
                .groupBy("band", "v").agg(F.count(F.lit(1)).alias("n")))
        upto = Window.partitionBy("band").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last, first = F.col("end"), F.col("end") - F.col("n")
        hits = F.lit(False)
        for i, own in enumerate(bands.values()):
            for t in own:
                hits = hits | ((F.col("band") == i) & (last > t.rank - t.below) & (first <= t.rank - t.below))
        # at most one row per wanted rank
        ranked = band.withColumn("end", F.sum("n").over(upto)).where(hits).select("band", "v", first, last).collect()
        for i, own in enumerate(bands.values()):
            for t in own:
                found.update({(t.column, t.rank): v for b, v, lo, hi in ranked if b == i and lo <= t.rank - t.below < hi})
    rows = []
    for c, p, lo, hi, frac in wanted:
        low, high = found[c, lo], found[c, hi]
        rows.append((c, p, low if frac == 0 else low + (high - low) * frac))
    return spark.createDataFrame(rows, schema)


def quantile_wide(df: DataFrame, columns, probs, **kw) -> DataFrame:
    """Same as :func:`exact_quantiles` pivoted to one column per probability
    (``q_<index>``)."""
    rows: dict[str, dict] = {}
    for c, p, value in exact_quantiles(df, columns, probs, **kw).collect():
        rows.setdefault(c, {})[p] = value
    names = ", ".join(f"q_{i} double" for i in range(len(probs)))
    return df.sparkSession.createDataFrame(
        [(c, *(of[float(p)] for p in probs)) for c, of in rows.items()], f"column_name string, {names}")
