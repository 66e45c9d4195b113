"""Data quality: five weighted dimensions, column scores, report, grade
(survey ops D1-D12).

Outputs are tables:

* ``dimensions``  (product, dimension, score, weight, issues array<string>)
* ``columns``     (product, column_name, completeness, uniqueness, validity,
  issues)
* ``report``      (product, composite_score, grade, total_issues,
  critical_issues)

Every product is assessed by one plan that reuses two intermediates (the
wide column statistics and the value-count table); Spark reuses their
shuffles where several branches need them. Duplicate rows are found by a
128-bit hash of values and nulls (see :func:`duplicate_rows`), so the
shuffle carries 16 bytes per row instead of whole rows.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import looks_numeric
from ..plans.session import together
from . import contract as C
from . import profile as P
from .quantiles import quantile_wide

# Dimension weights, thresholds and penalties of the reference.
WEIGHTS = (("completeness", 0.30), ("uniqueness", 0.15), ("validity", 0.25),
           ("consistency", 0.20), ("timeliness", 0.10))
NULL_CRITICAL_PCT, NULL_WARNING_PCT = 20, 5
DUP_CRITICAL_PCT, DUP_WARNING_PCT = 5, 1
UNIQUE_KEY_PENALTY = 10
MISSING_COLUMN_PENALTY = 5
INVALID_PENALTY_CAP = 10
INVALID_EXAMPLES = 5
MIXED_TYPE_SHARE, MIXED_TYPE_PENALTY = 0.9, 3
IQR_FACTOR, OUTLIER_PCT, OUTLIER_PENALTY = 3, 5, 5
RARE_SHARE, RARE_MIN_COUNT, RARE_MIN_DISTINCT, RARE_PENALTY = 0.001, 2, 5, 2
AGE_CRITICAL_H, AGE_WARNING_H, AGE_OK_H = 168, 48, 24
UNKNOWN_TIMELINESS = 80.0
COLUMN_VALIDITY_MIN = 95
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))

DIM_SCHEMA = ("product string, dimension string, score double, weight double, "
              "issues array<string>")


def _weight(name):
    return dict(WEIGHTS)[name]


def _ordered_issues(rows: DataFrame, order: str, issue: str = "issue") -> Column:
    """Collect the non-null issues of a (bounded) group in ``order``."""
    return F.transform(
        F.array_sort(F.collect_list(F.when(F.col(issue).isNotNull(),
                                           F.struct(F.col(order).alias("o"),
                                                    F.col(issue).alias("i"))))),
        lambda s: s["i"])


def _fmt(pattern, *cols):
    return F.format_string(pattern, *cols)


def _r(x, n):
    return F.round(x, n)


def _dimension(product: str, name: str, score: Column, issues: Column):
    return [F.lit(product).alias("product"), F.lit(name).alias("dimension"),
            score.cast("double").alias("score"),
            F.lit(_weight(name)).alias("weight"), issues.alias("issues")]


# -- completeness (D1, D2) ----------------------------------------------------

def column_completeness(product: str, df: DataFrame,
                        facts: DataFrame | None = None) -> DataFrame:
    """Per column 100 - null %, and an issue above 5 % / 20 % nulls."""
    stats = P.column_facts(df) if facts is None else facts
    pct = F.try_divide(F.col("null_count"), F.col("row_count")) * 100
    issue = (F.when(pct > NULL_CRITICAL_PCT,
                    _fmt("CRITICAL: Column '%s' has %s%% nulls", "column_name",
                         _fmt("%.1f", _r(pct, 1))))
             .when(pct > NULL_WARNING_PCT,
                   _fmt("Warning: Column '%s' has %s%% nulls", "column_name",
                        _fmt("%.1f", _r(pct, 1)))))
    return stats.select(F.lit(product).alias("product"), "column_name", "ordinal",
                        "row_count", "null_count",
                        _r(100 - pct, 2).alias("completeness"),
                        issue.alias("issue"))


def completeness_dimension(product: str, df: DataFrame,
                           facts: DataFrame | None = None) -> DataFrame:
    """(cells - null cells) / cells x 100 to 2 decimals; 0 without cells."""
    cols = column_completeness(product, df, facts)
    n_cols = len(df.columns)
    g = cols.groupBy("product").agg(
        F.max("row_count").alias("rows"), F.sum("null_count").alias("nulls"),
        _ordered_issues(cols, "ordinal").alias("issues"))
    cells = F.col("rows") * n_cols
    score = F.when(cells > 0, _r((cells - F.col("nulls")) / cells * 100, 2)) \
        .otherwise(F.lit(0.0))
    return g.select(*_dimension(product, "completeness", score, F.col("issues")))


# -- uniqueness (D3, D4) -------------------------------------------------------

def _hash_ready(df: DataFrame):
    """Columns as hashable expressions: NaN is missing (as in pandas) and
    -0.0 equals 0.0; maps become sorted entry arrays."""
    out = []
    for f in df.schema.fields:
        c = P.q(f.name)
        t = f.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(None).cast(t)) \
                .when(c == 0, F.lit(0.0).cast(t)).otherwise(c)
        elif isinstance(t, T.MapType):
            c = F.array_sort(F.map_entries(c))
        elif hasattr(T, "VariantType") and isinstance(t, T.VariantType):
            c = F.to_json(c)
        out.append(c)
    return out


def row_key(df: DataFrame) -> list[Column]:
    """A 128-bit content key per row plus a null mask.

    Two xxhash64 values with different leading seeds; nulls are skipped by
    Spark's hashes, so the mask keeps ``(a, null)`` apart from ``(null, a)``.
    Two distinct rows share a key with probability about ``2**-128``; over
    ``n`` rows the chance of any false duplicate is below ``n**2 / 2**129``
    (1e-15 for a trillion rows).
    """
    cols = _hash_ready(df)
    mask = F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in cols]) \
        if cols else F.lit("")
    return [F.xxhash64(F.lit(1), *cols).alias("_h1"),
            F.xxhash64(F.lit(2), *cols).alias("_h2"), mask.alias("_nm")]


def row_hashes(df: DataFrame) -> list[Column]:
    """The key of :func:`row_key` as 16 bytes: the null mask is hashed too."""
    cols = _hash_ready(df)
    nulls = [c.isNull() for c in cols]
    return [F.xxhash64(F.lit(seed), *cols, *nulls).alias(name) for seed, name in ((1, "_h1"), (2, "_h2"))]


def duplicate_rows(product: str, df: DataFrame, exact: bool = False) -> DataFrame:
    """D3: rows after the first of each group of identical rows.

    ``exact=True`` groups by the full rows instead of the row key.
    """
    if exact:
        keys = [c.alias(f"_c{i}") for i, c in enumerate(_hash_ready(df))]
        groups = df.select(*keys).groupBy(*[f"_c{i}" for i in range(len(keys))]).agg(
            F.count(F.lit(1)).alias("n"))
    else:
        groups = df.select(*row_hashes(df)).groupBy("_h1", "_h2").agg(
            F.count(F.lit(1)).alias("n"))
    return duplicates_of_groups(product, groups)


def duplicates_of_groups(product: str, groups: DataFrame) -> DataFrame:
    """D3 from the sizes ``n`` of the groups of identical rows."""
    g = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                   F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    pct = F.when(F.col("row_count") > 0,
                 F.col("duplicate_rows") / F.col("row_count") * 100) \
        .otherwise(F.lit(0.0))
    issue = (F.when(pct > DUP_CRITICAL_PCT,
                    _fmt("CRITICAL: %s%% duplicate rows (%d/%d)",
                         _fmt("%.1f", _r(pct, 1)), "duplicate_rows", "row_count"))
             .when(pct > DUP_WARNING_PCT,
                   _fmt("Warning: %s%% duplicate rows", _fmt("%.1f", _r(pct, 1)))))
    return g.select(F.lit(product).alias("product"),
                    F.col("row_count").cast("bigint").alias("row_count"),
                    F.col("duplicate_rows").cast("bigint").alias("duplicate_rows"),
                    _r(pct, 2).alias("duplicate_pct"), pct.alias("_pct"),
                    issue.alias("issue"))


def unique_key_violations(product: str, df: DataFrame,
                          contract_columns: DataFrame,
                          vc: DataFrame | None = None,
                          prof: DataFrame | None = None) -> DataFrame:
    """Contract columns marked unique that hold repeated values (a null
    counts as a value, as in pandas ``duplicated``)."""
    prof = P.column_profile(df, vc) if prof is None else prof
    uniq = (contract_columns.where((F.col("product") == product) & F.col("unique"))
            .select("column_name"))
    dups = (prof.join(F.broadcast(uniq), "column_name", "left_semi")
            .withColumn("duplicates", F.col("row_count") - F.col("groups"))
            .where(F.col("duplicates") > 0))
    return dups.select(
        F.lit(product).alias("product"), "column_name",
        F.col("duplicates").cast("bigint").alias("duplicates"),
        _fmt("Column '%s' should be unique but has %d duplicates",
             "column_name", "duplicates").alias("issue"))


def uniqueness_dimension(product: str, dup: DataFrame,
                         keys: DataFrame | None) -> DataFrame:
    """D3 + D4: 100 - duplicate %, minus 10 per unique column with repeats,
    floored at 0."""
    if keys is None:
        keys = dup.sparkSession.createDataFrame(
            [], "product string, column_name string, duplicates bigint, issue string")
    k = keys.groupBy().agg(
        F.count(F.lit(1)).alias("k"),
        F.transform(F.array_sort(F.collect_list(F.struct("column_name", "issue"))),
                    lambda s: s["issue"]).alias("key_issues"))
    row = dup.crossJoin(k)
    score = F.greatest(F.lit(0.0),
                       _r(100 - F.col("_pct") - UNIQUE_KEY_PENALTY * F.col("k"), 2))
    issues = F.concat(F.when(F.col("issue").isNull(), F.array().cast("array<string>"))
                      .otherwise(F.array("issue")), F.col("key_issues"))
    return row.select(*_dimension(product, "uniqueness", score, issues))


# -- validity (D5, D6) ------------------------------------------------------------

def allowed_lists(product: str, contract_columns: DataFrame | None):
    if contract_columns is None:
        return None
    return (contract_columns.where(F.col("product") == product)
            .select("column_name", "allowed_values"))


def validity_dimension(product: str, df: DataFrame,
                       contract_columns: DataFrame | None = None,
                       vc: DataFrame | None = None,
                       prof: DataFrame | None = None) -> DataFrame:
    """D5 with a contract (-5 per missing column, -min(invalid distinct /
    distinct x 100, 10) per column with unexpected values), D6 without."""
    spark = df.sparkSession
    if contract_columns is None:
        return mixed_type_dimension(product, df)
    if prof is None:
        prof = P.column_profile(df, vc, allowed_lists(product, contract_columns))
    cc = contract_columns.where(F.col("product") == product)
    present = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    missing = (cc.join(F.broadcast(present), "column_name", "left_anti")
               .select("column_name",
                       F.lit(MISSING_COLUMN_PENALTY * 1.0).alias("penalty"),
                       F.concat(F.lit("Missing expected column: "), "column_name")
                       .alias("issue")))
    inv = prof.where(F.col("has_allowed") & (F.col("invalid_count") > 0))
    pct = F.col("invalid_count") / F.greatest(F.col("distinct_count"), F.lit(1)) * 100
    bad = inv.select("column_name",
                     F.least(pct, F.lit(INVALID_PENALTY_CAP * 1.0)).alias("penalty"),
                     _fmt("Column '%s': %d unexpected values", "column_name",
                          "invalid_count").alias("issue"))
    pen = missing.unionByName(bad).coalesce(1)
    g = pen.groupBy().agg(F.coalesce(F.sum("penalty"), F.lit(0.0)).alias("pen"),
                          _ordered_issues(pen, "column_name").alias("issues"))
    score = F.greatest(F.lit(0.0), _r(100 - F.col("pen"), 2))
    return g.select(*_dimension(product, "validity", score, F.col("issues")))


def invalid_examples(product: str, df: DataFrame, contract_columns: DataFrame,
                     vc: DataFrame | None = None) -> DataFrame:
    """D5 detail: columns with unexpected values, their number and five
    examples (most frequent first, ties by value)."""
    rows = C.invalid_values(product, df, contract_columns, vc)
    examples = P.top_values(rows, INVALID_EXAMPLES).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("examples"))
    return (rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("invalid_count")).join(examples, "column_name")
            .select(F.lit(product).alias("product"), "column_name", "invalid_count", "examples"))


def mixed_type_columns(product: str, df: DataFrame) -> DataFrame:
    """D6 detail: text columns where some but under 90 % of the non-null
    values look numeric."""
    texts = P.text_columns(df)
    spark = df.sparkSession
    if not texts:
        return spark.createDataFrame(
            [], "product string, column_name string, numeric_count bigint, "
                "non_null bigint, numeric_pct double, issue string")
    aggs = []
    for i, c in enumerate(texts):
        aggs += [F.count_if(looks_numeric(P.q(c))).alias(f"k{i}"),
                 F.count(P.q(c)).alias(f"t{i}")]
    wide = df.agg(*aggs)
    arms = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"),
                     F.col(f"k{i}").alias("numeric_count"),
                     F.col(f"t{i}").alias("non_null")) for i, c in enumerate(texts)]
    long = wide.select(F.inline(F.array(*arms)))
    pct = F.try_divide(F.col("numeric_count"), F.col("non_null")) * 100
    flagged = (F.col("numeric_count") > 0) & \
        (F.col("numeric_count") < F.col("non_null") * MIXED_TYPE_SHARE)
    return long.select(
        F.lit(product).alias("product"), "column_name", "ordinal", "numeric_count",
        "non_null", pct.alias("numeric_pct"),
        F.when(flagged, _fmt("Column '%s': mixed types (%s%% look numeric)",
                             "column_name", _fmt("%.0f", _r(pct, 0)))).alias("issue"))


def mixed_type_dimension(product: str, df: DataFrame) -> DataFrame:
    cols = mixed_type_columns(product, df)
    g = cols.groupBy().agg(F.count("issue").alias("k"),
                           _ordered_issues(cols, "ordinal").alias("issues"))
    score = F.greatest(F.lit(0.0), _r(100 - MIXED_TYPE_PENALTY * F.col("k"), 2))
    return g.select(*_dimension(product, "validity", score, F.col("issues")))


# -- consistency (D7, D8) -------------------------------------------------------

def outlier_columns(product: str, df: DataFrame, **quantile_kw) -> DataFrame:
    """Numeric columns with IQR > 0: values beyond Q1 - 3 IQR or
    Q3 + 3 IQR, as a share of all rows (nulls included)."""
    nums = P.numeric_columns(df)
    spark = df.sparkSession
    schema = ("product string, column_name string, q1 double, q3 double, "
              "outliers bigint, outlier_pct double, issue string")
    if not nums:
        return spark.createDataFrame([], schema)
    # two numbers per column; as literals they need no join in the counting pass
    fences = quantile_wide(df, nums, [0.25, 0.75], **quantile_kw).collect()
    if not fences:
        return spark.createDataFrame([], schema)
    counts = [F.count(F.lit(1)).alias("__rows")]
    arms = []
    for i, (c, q1, q3) in enumerate(fences):
        x, iqr = P.q(c).cast("double"), q3 - q1
        out = (x < q1 - IQR_FACTOR * iqr) | (x > q3 + IQR_FACTOR * iqr)
        counts.append((F.count_if(out) if iqr > 0 else F.lit(0).cast("long")).alias(f"o{i}"))
        arms.append(F.struct(F.lit(c).alias("column_name"), F.lit(q1).cast("double").alias("q1"),
                             F.lit(q3).cast("double").alias("q3"), F.col(f"o{i}").alias("outliers")))
    long = df.agg(*counts).select("__rows", F.inline(F.array(*arms)))
    pct = F.try_divide(F.col("outliers"), F.col("__rows")) * 100
    return long.select(
        F.lit(product).alias("product"), "column_name", "q1", "q3",
        F.col("outliers").cast("bigint").alias("outliers"),
        _r(pct, 2).alias("outlier_pct"),
        F.when((F.col("q3") - F.col("q1") > 0) & (pct > OUTLIER_PCT),
               _fmt("Column '%s': %s%% extreme outliers", "column_name",
                    _fmt("%.1f", _r(pct, 1)))).alias("issue"))


def rare_value_columns(product: str, df: DataFrame,
                       vc: DataFrame | None = None) -> DataFrame:
    """Text columns with more than five distinct values: values seen
    fewer than max(2, 0.1 % of non-null) times; five examples (most frequent
    first, ties by value)."""
    texts = P.text_columns(df)
    vc = P.value_counts(df, texts) if vc is None else vc
    nn = vc.where(F.col("value").isNotNull() & F.col("column_name").isin(texts))
    per = nn.groupBy("column_name").agg(F.sum("n").alias("total"),
                                        F.count(F.lit(1)).alias("distinct_count"))
    limit = F.greatest(F.lit(float(RARE_MIN_COUNT)), F.col("total") * RARE_SHARE)
    # one row per column: the values stay where they are
    rare = nn.join(F.broadcast(per), "column_name").where(F.col("n") < limit)
    examples = P.top_values(rare.select("column_name", "value", "n"), 5) \
        .groupBy("column_name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                        lambda s: s["value"]).alias("examples"))
    counts = rare.groupBy("column_name").agg(F.count(F.lit(1)).alias("rare_count"))
    out = (per.join(counts, "column_name", "left").join(examples, "column_name", "left")
           .select("column_name", "distinct_count",
                   F.coalesce("rare_count", F.lit(0)).cast("bigint").alias("rare_count"),
                   "examples"))
    flagged = (F.col("rare_count") > 0) & (F.col("distinct_count") > RARE_MIN_DISTINCT)
    return out.select(
        F.lit(product).alias("product"), "column_name", "distinct_count",
        "rare_count", F.when(flagged, F.col("examples")).alias("examples"),
        F.when(flagged, _fmt("Column '%s': %d very rare values (possible typos)",
                             "column_name", "rare_count")).alias("issue"))


def rare_issues_from_profile(product: str, df: DataFrame, prof: DataFrame) -> DataFrame:
    """D8 counts and issues from the column profile (no examples)."""
    texts = P.text_columns(df)
    flagged = (F.col("rare_count") > 0) & (F.col("distinct_count") > RARE_MIN_DISTINCT)
    return prof.where(F.col("column_name").isin(texts)).select(
        F.lit(product).alias("product"), "column_name", "distinct_count", "rare_count",
        F.when(flagged, _fmt("Column '%s': %d very rare values (possible typos)",
                             "column_name", "rare_count")).alias("issue"))


def consistency_dimension(product: str, outliers: DataFrame,
                          rare: DataFrame) -> DataFrame:
    o = outliers.select(F.lit(0).alias("kind"), "column_name", "issue")
    r = rare.select(F.lit(1).alias("kind"), "column_name", "issue")
    both = o.unionByName(r).coalesce(1).withColumn("order", F.struct("kind", "column_name"))
    g = both.groupBy().agg(
        F.count_if((F.col("kind") == 0) & F.col("issue").isNotNull()).alias("a"),
        F.count_if((F.col("kind") == 1) & F.col("issue").isNotNull()).alias("b"),
        _ordered_issues(both, "order").alias("issues"))
    score = F.greatest(F.lit(0.0), _r(100 - OUTLIER_PENALTY * F.col("a")
                                      - RARE_PENALTY * F.col("b"), 2))
    return g.select(*_dimension(product, "consistency", score, F.col("issues")))


# -- timeliness (D9) ---------------------------------------------------------------

def age_hours(last_modified: Column, as_of: Column) -> Column:
    """Exact age in hours (microsecond precision)."""
    return F.timestamp_diff("MICROSECOND", last_modified, as_of) / 3.6e9


def timeliness_score(age: Column):
    score = (F.when(age.isNull(), F.lit(UNKNOWN_TIMELINESS))
             .when(age > AGE_CRITICAL_H, F.lit(30.0))
             .when(age > AGE_WARNING_H, F.lit(60.0))
             .when(age > AGE_OK_H, F.lit(80.0)).otherwise(F.lit(100.0)))
    issue = (F.when(age.isNull(),
                    F.lit("Data freshness unknown — no timestamp available"))
             .when(age > AGE_CRITICAL_H,
                   _fmt("CRITICAL: Data is %s hours old (>1 week)",
                        _fmt("%.0f", _r(age, 0))))
             .when(age > AGE_WARNING_H,
                   _fmt("Warning: Data is %s hours old", _fmt("%.0f", _r(age, 0)))))
    return score, issue


def timeliness_dimension(product: str, spark, last_modified=None,
                         as_of=None) -> DataFrame:
    """> 168 h -> 30, > 48 h -> 60, > 24 h -> 80, else 100; unknown age
    -> 80 with an issue. ``last_modified`` may be a one-row DataFrame with a
    ``last_modified`` column (e.g. ``max`` of a timestamp column)."""
    if last_modified is None:
        base = spark.range(1, numPartitions=1).select(F.lit(None).cast("timestamp").alias("last_modified"))
    else:
        base = last_modified
    as_of_col = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    age = age_hours(F.col("last_modified").cast("timestamp"), as_of_col)
    score, issue = timeliness_score(age)
    issues = F.when(issue.isNull(), F.array().cast("array<string>")).otherwise(F.array(issue))
    return base.select(*_dimension(product, "timeliness", score, issues))


# -- column-level quality (D10) --------------------------------------------------

def column_quality(product: str, df: DataFrame,
                   contract_columns: DataFrame | None = None,
                   vc: DataFrame | None = None,
                   facts: DataFrame | None = None) -> DataFrame:
    """Per column completeness %, distinct / rows %, and the share of
    values in the allowed list (nulls count as valid), all to 2 decimals.
    ``facts`` is the column profile built with this contract's lists."""
    if facts is None:
        facts = P.column_profile(df, vc, allowed_lists(product, contract_columns))
    rows = F.col("row_count")
    validity = F.when(~F.col("has_allowed"), F.lit(100.0)).otherwise(
        _r(F.try_divide(F.col("in_list") + F.col("null_count"), rows) * 100, 2))
    completeness = _r((1 - F.try_divide(F.col("null_count"), rows)) * 100, 2)
    uniqueness = _r(F.col("distinct_count") / F.greatest(rows, F.lit(1)) * 100, 2)
    out = facts.select(
        F.lit(product).alias("product"), "column_name", "ordinal",
        completeness.alias("completeness"), uniqueness.alias("uniqueness"),
        validity.alias("validity"))
    return out.withColumn(
        "issue", F.when(F.col("validity") < COLUMN_VALIDITY_MIN,
                        F.concat(F.lit("Only "), F.col("validity").cast("string"),
                                 F.lit("% of values are in allowed list"))))


# -- report (D11, D12) -------------------------------------------------------------

def grade(score: Column) -> Column:
    out = F.lit("F")
    for bound, letter in reversed(GRADES):
        out = F.when(score >= bound, F.lit(letter)).otherwise(out)
    return out


def report_from_dimensions(dims: DataFrame) -> DataFrame:
    """Weighted sum, grade of the unrounded sum, rounded score, issue
    counts; critical issues are those containing 'CRITICAL'."""
    w = dict(WEIGHTS)
    s = {d: F.max(F.when(F.col("dimension") == d, F.col("score"))) for d, _ in WEIGHTS}
    composite = None
    for d, _ in WEIGHTS:
        term = s[d] * w[d]
        composite = term if composite is None else composite + term
    order = F.create_map(*[x for i, (d, _) in enumerate(WEIGHTS)
                           for x in (F.lit(d), F.lit(i))])
    g = dims.groupBy("product").agg(
        composite.alias("_composite"),
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct(order[F.col("dimension")].alias("o"),
                                                 F.col("issues").alias("i")))),
            lambda x: x["i"])).alias("_issues"))
    return g.select(
        "product", _r("_composite", 1).alias("composite_score"),
        grade(F.col("_composite")).alias("grade"),
        F.size("_issues").cast("bigint").alias("total_issues"),
        F.filter("_issues", lambda i: F.upper(i).contains("CRITICAL"))
        .alias("critical_issues"))


@dataclass
class Assessment:
    dimensions: DataFrame
    columns: DataFrame
    report: DataFrame
    duplicates: DataFrame
    outliers: DataFrame
    rare_values: DataFrame
    profile: DataFrame | None = None


@dataclass
class Facts:
    """What an assessment needs of the data: small tables of one product."""
    profile: DataFrame
    duplicates: DataFrame
    outliers: DataFrame
    rare_values: DataFrame


def facts_of(product: str, df: DataFrame, contract_columns: DataFrame | None = None,
             exact_duplicates: bool = False, **quantile_kw) -> Facts:
    """The data passes of an assessment, as jobs submitted together: the
    shuffle of hashed values (one small column profile), the row-key shuffle
    for duplicates, and the quantile passes for outliers."""
    prof, dup, outl = together(
        lambda: P.small_cached(P.column_profile(df, allowed=allowed_lists(product, contract_columns))),
        lambda: P.small_cached(duplicate_rows(product, df, exact=exact_duplicates)),
        lambda: P.small_cached(outlier_columns(product, df, **quantile_kw)))
    return Facts(prof, dup, outl, rare_value_columns(product, df))


def assess(product: str, df: DataFrame, contract_columns: DataFrame | None = None,
           last_modified: DataFrame | None = None, as_of=None,
           exact_duplicates: bool = False, facts: Facts | None = None, **quantile_kw) -> Assessment:
    """All dimensions, column scores and the report for one product.

    Only ``facts`` (made by ``facts_of`` if not given, or kept in an
    ``AssessmentStore``) read the data. Every other step reads these small
    tables, of one partition, without an exchange.
    """
    if facts is None:
        facts = facts_of(product, df, contract_columns, exact_duplicates, **quantile_kw)
    spark, prof, dup, outl = df.sparkSession, facts.profile, facts.duplicates, facts.outliers
    comp = completeness_dimension(product, df, prof)
    keys = (unique_key_violations(product, df, contract_columns, prof=prof)
            if contract_columns is not None else None)
    uniq = uniqueness_dimension(product, dup, keys)
    valid = validity_dimension(product, df, contract_columns, prof=prof)
    rare = rare_issues_from_profile(product, df, prof)
    cons = consistency_dimension(product, outl, rare)
    time = timeliness_dimension(product, spark, last_modified, as_of)
    dims = comp.unionByName(uniq).unionByName(valid).unionByName(cons).unionByName(time).coalesce(1)
    cols = column_quality(product, df, contract_columns, facts=prof)
    return Assessment(dims, cols, report_from_dimensions(dims), dup, outl, facts.rare_values, prof)


def assess_many(products: dict, contract_columns: DataFrame | None = None,
                last_modified: dict | None = None, as_of=None) -> Assessment:
    """Assess several products in one plan (union of per-product plans)."""
    parts = together(*(partial(assess, name, df, contract_columns, (last_modified or {}).get(name), as_of)
                       for name, df in products.items()))

    def u(attr):
        out = getattr(parts[0], attr)
        for p in parts[1:]:
            out = out.unionByName(getattr(p, attr))
        return out
    return Assessment(u("dimensions"), u("columns"), u("report"), u("duplicates"),
                      u("outliers"), u("rare_values"))


def quality_summary(report: DataFrame) -> DataFrame:
    """Number of products, mean score (1 decimal), total issues, and
    each product's grade and score (sorted by product)."""
    return report.agg(F.count(F.lit(1)).alias("total_assessed"),
                      _r(F.avg("composite_score"), 1).alias("average_score"),
                      F.sum("total_issues").cast("bigint").alias("total_issues"),
                      F.array_sort(F.collect_list(F.struct("product", "grade", "composite_score"))).alias("products"))
