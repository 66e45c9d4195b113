"""Quality keys (D1-D12, C9) on the messy views.

The contract used for the orders views is the one inferred on clean
``orders`` (allowed status F/O/P, five priorities, unique order key).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import profile as P
from ..operators import quality as D
from ..operators.assessment_store import AssessmentStore
from .registry import register
from .session import checkpoint_dir, together
from .tables import table
from .views import VIEWS, with_views

ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDERS_TEXT = ["o_orderstatus", "o_orderpriority"]
ORDERS_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
              "o_orderdate", "o_orderpriority"]
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def clean_contract(spark, sf):
    """The contract inferred on clean ``orders``, as a small table that the
    branches of a key read."""
    return P.small_cached(C.infer_contract("orders", table(spark, sf, "orders")))


def orders_contract(spark, sf, product, contract=None):
    """That contract (``contract`` if made before) for ``product``."""
    contract = clean_contract(spark, sf) if contract is None else contract
    return contract.withColumn("product", F.lit(product))


# -- SQL builders (DuckDB) ---------------------------------------------------------

def sql_null_pct(view, cols):
    return "\nunion all ".join(
        f"select {i} as ordinal, '{c}' as column_name, count(*) as row_count, "
        f"count(*) filter (where {c} is null) as null_count from {view}"
        for i, c in enumerate(cols))


def sql_completeness(view, cols):
    """(score, issues list) of the completeness dimension."""
    return f"""
    (select case when sum(row_count) > 0 then
              round((max(row_count) * {len(cols)} - sum(null_count)) / (max(row_count) * {len(cols)}) * 100, 2)
            else 0 end as score,
            coalesce(list(case when null_count / row_count * 100 > 20
                      then 'CRITICAL: Column ''' || column_name || ''' has ' || printf('%.1f', round(null_count / row_count * 100, 1)) || '% nulls'
                      when null_count / row_count * 100 > 5
                      then 'Warning: Column ''' || column_name || ''' has ' || printf('%.1f', round(null_count / row_count * 100, 1)) || '% nulls'
                 end order by ordinal) filter (where null_count / row_count * 100 > 5), []) as issues
     from ({sql_null_pct(view, cols)}))"""


def sql_dups(view, cols=None):
    cols = ", ".join(cols or ORDERS_ALL)
    return f"""
    (select sum(n) as row_count, sum(n - 1) as duplicate_rows,
            case when sum(n) > 0 then sum(n - 1) / sum(n) * 100 else 0 end as pct
     from (select count(*) as n from {view} group by {cols}))"""


def sql_unique_keys(view):
    """Columns unique in clean orders that repeat in ``view``."""
    arms = []
    for c in ORDERS_ALL:
        arms.append(
            f"select '{c}' as column_name, (select count(*) - count(distinct {c}) "
            f"- case when count(*) filter (where {c} is null) > 0 then 1 else 0 end from {view}) as duplicates "
            f"where (select count(distinct {c}) = count(*) from orders)")
    return "(" + "\nunion all ".join(arms) + ")"


def sql_uniqueness(view):
    return f"""
    (select greatest(0, round(100 - d.pct - 10 * (select count(*) from {sql_unique_keys(view)} k where k.duplicates > 0), 2)) as score,
            (case when d.pct > 5 then ['CRITICAL: ' || printf('%.1f', round(d.pct, 1)) || '% duplicate rows (' || d.duplicate_rows || '/' || d.row_count || ')']
                  when d.pct > 1 then ['Warning: ' || printf('%.1f', round(d.pct, 1)) || '% duplicate rows']
                  else [] end)
            || coalesce((select list('Column ''' || column_name || ''' should be unique but has ' || duplicates || ' duplicates' order by column_name)
                         from {sql_unique_keys(view)} k where k.duplicates > 0), []) as issues
     from {sql_dups(view)} d)"""


def sql_allowed():
    return """
    (select 'o_orderstatus' as column_name, list(distinct o_orderstatus) as allowed from orders
     union all select 'o_orderpriority', list(distinct o_orderpriority) from orders)"""


def sql_invalid(view):
    arms = [f"select '{c}' as column_name, count(distinct {c}) as distinct_count, "
            f"count(distinct {c}) filter (where not list_contains((select allowed from {sql_allowed()} a where a.column_name = '{c}'), {c})) as invalid_count "
            f"from {view}" for c in ORDERS_TEXT]
    return "(" + "\nunion all ".join(arms) + ")"


def sql_validity(view):
    return f"""
    (select greatest(0, round(100 - coalesce(sum(least(invalid_count / greatest(distinct_count, 1) * 100, 10)), 0), 2)) as score,
            coalesce(list('Column ''' || column_name || ''': ' || invalid_count || ' unexpected values' order by column_name), []) as issues
     from {sql_invalid(view)} where invalid_count > 0)"""


def sql_outliers(view, cols):
    arms = []
    for c in cols:
        arms.append(f"""
        select '{c}' as column_name, q.q1, q.q3,
               (select count(*) from {view} where q.q3 - q.q1 > 0 and
                 ({c} < q.q1 - 3 * (q.q3 - q.q1) or {c} > q.q3 + 3 * (q.q3 - q.q1))) as outliers,
               (select count(*) from {view}) as row_count
        from (select quantile_cont(cast({c} as double), 0.25) as q1,
                     quantile_cont(cast({c} as double), 0.75) as q3 from {view}) q""")
    return "(" + "\nunion all ".join(arms) + ")"


def sql_rare(view, cols):
    arms = []
    for c in cols:
        arms.append(f"""
        select '{c}' as column_name, count(*) as distinct_count,
               count(*) filter (where n < greatest(2, total * 0.001)) as rare_count
        from (select {c} as value, count(*) as n, sum(count(*)) over () as total
              from {view} where {c} is not null group by 1)""")
    return "(" + "\nunion all ".join(arms) + ")"


def sql_consistency(view, num_cols, text_cols):
    return f"""
    (select greatest(0, round(100 - 5 * (select count(*) from {sql_outliers(view, num_cols)} o
                                           where o.q3 - o.q1 > 0 and o.outliers / o.row_count * 100 > 5)
                              - 2 * (select count(*) from {sql_rare(view, text_cols)} r
                                     where r.rare_count > 0 and r.distinct_count > 5), 2)) as score)"""


def sql_report(view):
    return f"""
    select '{view}' as product, c.score * 0.3 + u.score * 0.15 + v.score * 0.25 + k.score * 0.2 + 80.0 * 0.1 as composite,
           len(c.issues) + len(u.issues) + len(v.issues) + 1
             + (select count(*) from {sql_outliers(view, ORDERS_NUM)} o where o.q3 - o.q1 > 0 and o.outliers / o.row_count * 100 > 5)
             + (select count(*) from {sql_rare(view, ORDERS_TEXT)} r where r.rare_count > 0 and r.distinct_count > 5) as total_issues,
           len(list_filter(c.issues || u.issues || v.issues, lambda x: contains(upper(x), 'CRITICAL'))) as critical_count
    from {sql_completeness(view, ORDERS_ALL)} c, {sql_uniqueness(view)} u, {sql_validity(view)} v,
         {sql_consistency(view, ORDERS_NUM, ORDERS_TEXT)} k"""


def grade_sql(x):
    return (f"case when {x} >= 90 then 'A' when {x} >= 80 then 'B' when {x} >= 70 then 'C' "
            f"when {x} >= 60 then 'D' else 'F' end")


REPORT_VIEWS = ("orders_nulls", "orders_dups", "orders_badvals")


def assessments(spark, sf, names=REPORT_VIEWS, shared=True, contract=None):
    """Assessments of order views by the contract of clean orders (``contract``
    if made before); ``shared``: from the store that all keys of a checkpoint
    folder share."""
    contract = clean_contract(spark, sf) if contract is None else contract
    store = AssessmentStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/meshwork-assessments")
    one = store.assess if shared else D.assess
    return dict(zip(names, together(*(lambda name=name: one(
        name, VIEWS[name](spark, sf), orders_contract(spark, sf, name, contract)) for name in names))))


def reports(spark, sf, names=REPORT_VIEWS, shared=True, found=None):
    """Their reports, of the assessments ``found`` if made before."""
    out, found = None, assessments(spark, sf, names, shared) if found is None else found
    for one in found.values():
        out = one.report if out is None else out.unionByName(one.report)
    return out


# -- keys ------------------------------------------------------------------------------

@register("quality_completeness", with_views(f"""
select 'orders_nulls' as product, c.score, cast(len(c.issues) as bigint) as issue_count
from {sql_completeness('orders_nulls', ORDERS_ALL)} c""", "orders_nulls"))
def quality_completeness(spark, sf):
    dim = D.completeness_dimension("orders_nulls", VIEWS["orders_nulls"](spark, sf))
    return dim.select("product", "score",
                      F.size("issues").cast("bigint").alias("issue_count"))


@register("quality_column_completeness", with_views(f"""
select column_name, round(100 - null_count / row_count * 100, 2) as completeness,
       case when null_count / row_count * 100 > 20
            then 'CRITICAL: Column ''' || column_name || ''' has ' || printf('%.1f', round(null_count / row_count * 100, 1)) || '% nulls'
            when null_count / row_count * 100 > 5
            then 'Warning: Column ''' || column_name || ''' has ' || printf('%.1f', round(null_count / row_count * 100, 1)) || '% nulls'
       end as issue
from ({sql_null_pct('orders_nulls', ORDERS_ALL)})""", "orders_nulls"))
def quality_column_completeness(spark, sf):
    return D.column_completeness("orders_nulls", VIEWS["orders_nulls"](spark, sf)) \
        .select("column_name", "completeness", "issue")


@register("quality_duplicates", with_views(f"""
select 'orders_dups' as product, d.row_count::bigint as row_count,
       d.duplicate_rows::bigint as duplicate_rows, round(d.pct, 2) as duplicate_pct,
       case when d.pct > 5 then 'CRITICAL: ' || printf('%.1f', round(d.pct, 1)) || '% duplicate rows (' || d.duplicate_rows || '/' || d.row_count || ')'
            when d.pct > 1 then 'Warning: ' || printf('%.1f', round(d.pct, 1)) || '% duplicate rows' end as issue
from {sql_dups('orders_dups')} d""", "orders_dups"))
def quality_duplicates(spark, sf):
    return D.duplicate_rows("orders_dups", VIEWS["orders_dups"](spark, sf)).drop("_pct")


@register("quality_unique_keys", with_views(f"""
select 'orders_dups' as product, column_name, duplicates::bigint as duplicates,
       'Column ''' || column_name || ''' should be unique but has ' || duplicates || ' duplicates' as issue
from {sql_unique_keys('orders_dups')} where duplicates > 0""", "orders_dups"))
def quality_unique_keys(spark, sf):
    return D.unique_key_violations("orders_dups", VIEWS["orders_dups"](spark, sf),
                                   orders_contract(spark, sf, "orders_dups"))


@register("quality_uniqueness", with_views(f"""
select 'orders_dups' as product, cast(u.score as double) as score, cast(len(u.issues) as bigint) as issue_count
from {sql_uniqueness('orders_dups')} u""", "orders_dups"))
def quality_uniqueness(spark, sf):
    df = VIEWS["orders_dups"](spark, sf)
    cc = orders_contract(spark, sf, "orders_dups")
    dim = D.uniqueness_dimension("orders_dups", D.duplicate_rows("orders_dups", df),
                                 D.unique_key_violations("orders_dups", df, cc))
    return dim.select("product", "score",
                      F.size("issues").cast("bigint").alias("issue_count"))


@register("quality_validity", with_views(f"""
select 'orders_badvals' as product, cast(v.score as double) as score, unnest(v.issues) as issue
from {sql_validity('orders_badvals')} v""", "orders_badvals"))
def quality_validity(spark, sf):
    dim = D.validity_dimension("orders_badvals", VIEWS["orders_badvals"](spark, sf),
                               orders_contract(spark, sf, "orders_badvals"))
    return dim.select("product", "score", F.explode("issues").alias("issue"))


@register("quality_mixed_types", with_views("""
select column_name, numeric_count, non_null,
       case when numeric_count > 0 and numeric_count < non_null * 0.9
            then 'Column ''' || column_name || ''': mixed types (' || printf('%.0f', round(numeric_count / non_null * 100, 0)) || '% look numeric)'
       end as issue
from (select 'event_type' as column_name,
             count(*) filter (where try_cast(event_type as double) is not null and not isnan(try_cast(event_type as double))) as numeric_count,
             count(event_type) as non_null from events_mixed
      union all
      select 'props', count(*) filter (where try_cast(props as double) is not null and not isnan(try_cast(props as double))),
             count(props) from events_mixed)""", "events_mixed"))
def quality_mixed_types(spark, sf):
    return D.mixed_type_columns("events_mixed", VIEWS["events_mixed"](spark, sf)) \
        .select("column_name", "numeric_count", "non_null", "issue")


@register("quality_mixed_types_score", with_views("""
select 'events_mixed' as product, cast(greatest(0, round(100 - 3 * count(*), 2)) as double) as score
from (select count(*) filter (where try_cast(event_type as double) is not null and not isnan(try_cast(event_type as double))) as k,
             count(event_type) as t from events_mixed
      union all
      select count(*) filter (where try_cast(props as double) is not null and not isnan(try_cast(props as double))),
             count(props) from events_mixed)
where k > 0 and k < t * 0.9""", "events_mixed"))
def quality_mixed_types_score(spark, sf):
    dim = D.validity_dimension("events_mixed", VIEWS["events_mixed"](spark, sf), None)
    return dim.select("product", "score")


@register("quality_outliers", with_views(f"""
select column_name, q1, q3, outliers::bigint as outliers,
       round(outliers / row_count * 100, 2) as outlier_pct,
       case when q3 - q1 > 0 and outliers / row_count * 100 > 5
            then 'Column ''' || column_name || ''': ' || printf('%.1f', round(outliers / row_count * 100, 1)) || '% extreme outliers'
       end as issue
from {sql_outliers('lineitem_outliers', LINEITEM_NUM)}""", "lineitem_outliers"))
def quality_outliers(spark, sf):
    return D.outlier_columns("lineitem_outliers", VIEWS["lineitem_outliers"](spark, sf)) \
        .drop("product")


@register("quality_rare_values", with_views("""
with vc as (
  select 'p_name' as column_name, p_name as value, count(*) as n from part_rare group by 2
  union all select 'p_brand', p_brand, count(*) from part_rare group by 2
  union all select 'p_type', p_type, count(*) from part_rare group by 2),
t as (select column_name, sum(n) as total, count(*) as distinct_count from vc group by 1),
r as (select vc.*, row_number() over (partition by vc.column_name order by n desc, value) as rk
      from vc join t using (column_name) where n < greatest(2, total * 0.001)),
agg as (select column_name, count(*) as rare_count,
               string_agg(value, '|' order by rk) filter (where rk <= 5) as examples
        from r group by 1)
select t.column_name, t.distinct_count, coalesce(agg.rare_count, 0) as rare_count,
       case when agg.rare_count > 0 and t.distinct_count > 5 then agg.examples end as examples,
       case when agg.rare_count > 0 and t.distinct_count > 5
            then 'Column ''' || t.column_name || ''': ' || agg.rare_count || ' very rare values (possible typos)' end as issue
from t left join agg using (column_name)""", "part_rare"))
def quality_rare_values(spark, sf):
    out = D.rare_value_columns("part_rare", VIEWS["part_rare"](spark, sf))
    return out.select("column_name", "distinct_count", "rare_count",
                      F.array_join("examples", "|").alias("examples"), "issue")


AS_OF = ("2024-01-31 12:00:00", "2024-02-01 12:00:00", "2024-02-03 12:00:00",
         "2024-02-08 12:00:00")


@register("quality_timeliness", """
with m as (select max(ts) as last_modified from events),
a as (select cast(x as timestamp) as as_of from (values """ + ", ".join(f"('{a}')" for a in AS_OF) + """) t(x)),
g as (select a.as_of, (epoch_us(a.as_of) - epoch_us(m.last_modified)) / 3.6e9 as age from a, m)
select strftime(as_of, '%Y-%m-%d %H:%M:%S') as as_of, round(age, 1) as age_hours,
       cast(case when age > 168 then 30.0 when age > 48 then 60.0 when age > 24 then 80.0 else 100.0 end as double) as score,
       case when age > 168 then 'CRITICAL: Data is ' || printf('%.0f', round(age, 0)) || ' hours old (>1 week)'
            when age > 48 then 'Warning: Data is ' || printf('%.0f', round(age, 0)) || ' hours old' end as issue
from g
""")
def quality_timeliness(spark, sf):
    last = table(spark, sf, "events").agg(F.max("ts").alias("last_modified"))
    asof = spark.createDataFrame([(a,) for a in AS_OF], "as_of string")
    age = D.age_hours(F.col("last_modified").cast("timestamp"),
                      F.col("as_of").cast("timestamp"))
    score, issue = D.timeliness_score(age)
    return last.crossJoin(asof).select("as_of", F.round(age, 1).alias("age_hours"),
                                       score.alias("score"), issue.alias("issue"))


@register("quality_columns", with_views("""
with a as (select list(distinct o_orderstatus) as st, list(distinct o_orderpriority) as pr from orders),
b as (select * from orders_badvals)
select column_name, round((1 - null_count / row_count) * 100, 2) as completeness,
       round(distinct_count / greatest(row_count, 1) * 100, 2) as uniqueness,
       validity,
       case when validity < 95 then 'Only ' || cast(validity as varchar) || '% of values are in allowed list' end as issue
from (
  select 'o_orderkey' as column_name, count(*) as row_count, count(*) filter (where o_orderkey is null) as null_count,
         count(distinct o_orderkey) as distinct_count, 100.0::double as validity from b
  union all select 'o_custkey', count(*), count(*) filter (where o_custkey is null), count(distinct o_custkey), 100.0 from b
  union all select 'o_orderstatus', count(*), count(*) filter (where o_orderstatus is null), count(distinct o_orderstatus),
         round((count(*) filter (where list_contains((select st from a), o_orderstatus)) + count(*) filter (where o_orderstatus is null)) / count(*) * 100, 2) from b
  union all select 'o_totalprice', count(*), count(*) filter (where o_totalprice is null), count(distinct o_totalprice), 100.0 from b
  union all select 'o_orderdate', count(*), count(*) filter (where o_orderdate is null), count(distinct o_orderdate), 100.0 from b
  union all select 'o_orderpriority', count(*), count(*) filter (where o_orderpriority is null), count(distinct o_orderpriority),
         round((count(*) filter (where list_contains((select pr from a), o_orderpriority)) + count(*) filter (where o_orderpriority is null)) / count(*) * 100, 2) from b)
""", "orders_badvals"))
def quality_columns(spark, sf):
    return D.column_quality("orders_badvals", VIEWS["orders_badvals"](spark, sf),
                            orders_contract(spark, sf, "orders_badvals")) \
        .select("column_name", "completeness", "uniqueness", "validity", "issue")


_REPORT_SQL = "\nunion all ".join(sql_report(v) for v in REPORT_VIEWS)


@register("quality_report", with_views(f"""
select product, round(composite, 1) as composite_score, {grade_sql('composite')} as grade,
       total_issues::bigint as total_issues, critical_count::bigint as critical_count
from ({_REPORT_SQL})""", *REPORT_VIEWS))
def quality_report(spark, sf):
    """Made from the data; the keys that build on reports share stored ones."""
    out = reports(spark, sf, shared=False)
    return out.select("product", "composite_score", "grade", "total_issues",
                      F.size("critical_issues").cast("bigint").alias("critical_count"))


@register("quality_summary", with_views(f"""
select count(*) as total_assessed, round(avg(round(composite, 1)), 1) as average_score,
       sum(total_issues)::bigint as total_issues,
       string_agg(product || ' ' || {grade_sql('composite')} || ' ' || printf('%.1f', round(composite, 1)), ', ' order by product) as products
from ({_REPORT_SQL})""", *REPORT_VIEWS))
def quality_summary(spark, sf):
    out = reports(spark, sf)
    entry = lambda p: F.concat_ws(" ", p["product"], p["grade"],
                                  F.format_string("%.1f", p["composite_score"]))
    return D.quality_summary(out).withColumn("products", F.array_join(F.transform("products", entry), ", "))


def sql_unique_pct(view):
    return "(" + "\nunion all ".join(
        f"select round(count(distinct {c}) / greatest(count(*), 1) * 100, 2) as pct from {view}" for c in ORDERS_ALL) + ")"


def sql_valid_pct(view):
    return "(" + "\nunion all ".join(
        f"""select round((count(*) filter (where list_contains(
                (select allowed from {sql_allowed()} a where a.column_name = '{c}'), {c}))
              + count(*) filter (where {c} is null)) / count(*) * 100, 2) as pct from {view}""" for c in ORDERS_TEXT) + ")"


def sql_expectations(view):
    return f"""
    select '{view}' as product, 'min_completeness' as expectation, 0.95::double as threshold,
           c.score / 100 as actual, c.score / 100 >= 0.95 as passed from {sql_completeness(view, ORDERS_ALL)} c
    union all
    select '{view}', 'min_uniqueness', 0.0, max(pct) / 100, max(pct) / 100 >= 0.0 from {sql_unique_pct(view)}
    union all
    select '{view}', 'min_validity', 0.9, min(pct) / 100, min(pct) / 100 >= 0.9 from {sql_valid_pct(view)}
    union all
    select '{view}', 'max_duplicates_percent', 5.0, round(d.pct, 2), round(d.pct, 2) <= 5.0 from {sql_dups(view)} d"""


@register("check_expectations", with_views("\nunion all ".join(map(sql_expectations, REPORT_VIEWS)), *REPORT_VIEWS))
def check_expectations(spark, sf):
    out = None
    for name, found in assessments(spark, sf).items():
        complete = found.dimensions.where("dimension = 'completeness'")
        one = C.check_expectations(name, complete, found.duplicates, found.columns)
        out = one if out is None else out.unionByName(one)
    return out


@register("check_contract_terms", """
with m as (select max(ts) as last_modified from events),
a as (select cast(x as timestamp) as as_of from (values """ + ", ".join(f"('{a}')" for a in AS_OF) + """) t(x)),
g as (select strftime(a.as_of, '%Y-%m-%d %H:%M:%S') as as_of, (epoch_us(a.as_of) - epoch_us(m.last_modified)) / 3.6e9 as age from a, m)
select as_of, 'events' as product, 'max_age_hours' as expectation, 24.0::double as threshold, age as actual, age <= 24 as passed from g
union all select as_of, 'events', 'expected_type', 1.0, (count(*) - 1) / (count(*) + 1), false
from g, information_schema.columns where table_name = 'events' group by as_of
""")
def check_contract_terms(spark, sf):
    """Events by their contract, in which one column has another type and one
    is absent from the data."""
    df = table(spark, sf, "events")
    cc = P.small_cached(C.infer_contract("events", df))
    cc = cc.withColumn("expected_type", F.when(F.col("column_name") == "value", "int").otherwise(F.col("expected_type")))
    cc = cc.unionByName(spark.createDataFrame([("events", "absent", "string", True, False, None, "")], C.COLUMN_SCHEMA))
    contracts = C.default_contract(C.product_table(spark, ["events"]))
    last, out = df.agg(F.max("ts").alias("last_modified")), None
    for as_of in AS_OF:
        one = C.check_terms("events", df, cc, contracts, last, as_of).withColumn("as_of", F.lit(as_of))
        out = one if out is None else out.unionByName(one)
    return out


@register("quality_validity_examples", """
with v as (select p_type as value, count(*) as n from part where p_type <> 'none' group by 1)
select 'part' as product, 'p_type' as column_name, count(*) as invalid_count,
       (select string_agg(value, '|' order by n desc, value) from (select * from v order by n desc, value limit 5)) as examples
from v""")
def quality_validity_examples(spark, sf):
    """Examples of part types, none of which the contract allows."""
    cc = spark.createDataFrame([("part", "p_type", "string", True, False, ["none"], "")], C.COLUMN_SCHEMA)
    return D.invalid_examples("part", table(spark, sf, "part"), cc).withColumn("examples", F.array_join("examples", "|"))
