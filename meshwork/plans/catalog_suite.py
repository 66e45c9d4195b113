"""Catalog keys (M1-M9) on the test tables, the messy order views and the
events table used as usage log and score history."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as M
from ..operators import contract as C
from ..operators import profile as P
from ..operators import quality as D
from .quality_suite import assessments, clean_contract, reports, sql_report
from .profile_suite import _VIOL_SQL
from .registry import register
from .tables import TABLES, all_tables, table
from .views import VIEWS, with_views

VIEW3 = ("orders_nulls", "orders_dups", "orders_badvals")


@register("catalog_columns", """
with vc as (select 'p_type' as column_name, p_type as value, count(*) as n from part group by 2),
top as (select column_name, string_agg(value, '|' order by n desc, value) as sample_values
        from (select *, row_number() over (order by n desc, value) as rk from vc) where rk <= 5
        group by 1)
select 'part' as product, c.column_name, c.data_type, c.nunique, c.null_count,
       coalesce(top.sample_values, '') as sample_values
from (select 'p_partkey' as column_name, 'bigint' as data_type, count(distinct p_partkey) as nunique,
             count(*) filter (where p_partkey is null) as null_count from part
      union all select 'p_name', 'string', count(distinct p_name), count(*) filter (where p_name is null) from part
      union all select 'p_brand', 'string', count(distinct p_brand), count(*) filter (where p_brand is null) from part
      union all select 'p_type', 'string', count(distinct p_type), count(*) filter (where p_type is null) from part
      union all select 'p_size', 'int', count(distinct p_size), count(*) filter (where p_size is null) from part
      union all select 'p_retailprice', 'double', count(distinct p_retailprice),
                       count(*) filter (where p_retailprice is null) from part) c
left join top using (column_name)
""")
def catalog_columns(spark, sf):
    out = M.catalog_columns("part", table(spark, sf, "part"))
    return out.select("product", "column_name", "data_type", "nunique", "null_count",
                      F.array_join("sample_values", "|").alias("sample_values"))


def _entries(spark, sf):
    rows = None
    for name in VIEW3:
        df = VIEWS[name](spark, sf)
        e = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("product"), F.lit(f"views/{name}").alias("file_path"),
            "row_count", F.lit(len(df.columns)).alias("column_count"))
        rows = e if rows is None else rows.unionByName(e)
    return rows


def _status(spark, sf, **made):
    from .profile_suite import _violations
    contracts = C.default_contract(C.product_table(spark, VIEW3))
    return contracts, C.contract_status(contracts, _violations(spark, sf, **made))


_VIOL_CTE = _VIOL_SQL.strip()[5:].replace(
    "select product, column_name, \"check\", message from v where hit", "")


@register("catalog_products", with_views(f"""
with {_VIOL_CTE.rstrip().rstrip(',')},
p(product, n) as (select 'orders_nulls', count(*) from orders_nulls
                  union all select 'orders_dups', count(*) from orders_dups
                  union all select 'orders_badvals', count(*) from orders_badvals),
c as (select product, count(*) as k from v where hit group by 1)
select p.product, p.n as row_count, 6 as column_count, 'auto-detected' as owner, 'orders' as domain,
       coalesce(c.k, 0) = 0 as contract_compliant
from p left join c using (product)""", *VIEW3))
def catalog_products(spark, sf):
    contracts, status = _status(spark, sf)
    out = M.catalog_products(_entries(spark, sf), contracts, status)
    return out.select("product", "row_count", "column_count", "owner", "domain",
                      "contract_compliant")


_REPORT3 = "\nunion all ".join(sql_report(v) for v in VIEW3)
_GRADE = ("case when composite >= 90 then 'A' when composite >= 80 then 'B' "
          "when composite >= 70 then 'C' when composite >= 60 then 'D' else 'F' end")


def _report(spark, sf):
    return reports(spark, sf, VIEW3)


@register("quality_badge", with_views(f"""
select product, round(composite, 1) as quality_score, {_GRADE} as quality_grade from ({_REPORT3})""",
                                      *VIEW3))
def quality_badge(spark, sf):
    prods = C.product_table(spark, VIEW3)
    return M.quality_badge(prods, _report(spark, sf))


@register("change_log", "\nunion all ".join(
    f"select 'register' as action, '{t}' as product, count(*) as rows, "
    f"(select count(*) from information_schema.columns where table_name = '{t}') as columns from {t}"
    for t in TABLES))
def change_log(spark, sf):
    rows = None
    for name, df in all_tables(spark, sf).items():
        e = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("product"), "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("column_count"))
        rows = e if rows is None else rows.unionByName(e)
    return M.change_log(rows).drop("timestamp")


def score_history(spark, sf):
    """Events as a score history: mean value per event type and day."""
    e = table(spark, sf, "events")
    return (e.groupBy(F.col("event_type").alias("product"),
                      F.to_date("ts").alias("assessed_at"))
            .agg(F.avg("value").alias("score")))


@register("quality_drop_alerts", """
with h as (select event_type as product, cast(ts as date) as assessed_at, avg(value) as score
           from events group by 1, 2),
l as (select *, lag(score) over (partition by product order by assessed_at) as previous from h)
select 'quality_drop' as alert_type, 'warning' as severity, product,
       strftime(assessed_at, '%Y-%m-%d') as assessed_at,
       'Quality dropped from ' || printf('%.1f', round(previous, 1)) || ' to ' || printf('%.1f', round(score, 1)) as message
from l where previous is not null and score < previous - 10
""")
def quality_drop_alerts(spark, sf):
    out = M.quality_drop_alerts(score_history(spark, sf))
    return out.withColumn("assessed_at", F.date_format("assessed_at", "yyyy-MM-dd"))


def usage_log(spark, sf):
    """Events as a usage log: type = product, props = query text, role by
    the event's value."""
    e = table(spark, sf, "events")
    role = (F.when(F.col("value") < 10, "analyst").when(F.col("value") < 50, "manager")
            .otherwise("data_engineer"))
    return e.select(F.col("event_type").alias("product"), F.col("props").alias("query"),
                    F.array("event_type", F.lit("value")).alias("columns_accessed"),
                    role.alias("user_role"), F.col("ts").alias("timestamp"))


USAGE_SQL = """
u as (select event_type as product, props as query, [event_type, 'value'] as columns_accessed,
             case when value < 10 then 'analyst' when value < 50 then 'manager' else 'data_engineer' end as user_role
      from events)"""


@register("usage_stats_products", f"""
with {USAGE_SQL}
select product, count(*) as queries from u group by 1 order by queries desc, product limit 5""")
def usage_stats_products(spark, sf):
    return M.top_products(usage_log(spark, sf))


@register("usage_stats_columns", f"""
with {USAGE_SQL}
select column_name, count(*) as uses from (select unnest(columns_accessed) as column_name from u)
group by 1 order by uses desc, column_name limit 10""")
def usage_stats_columns(spark, sf):
    return M.top_columns(usage_log(spark, sf))


@register("usage_summary", f"""
with {USAGE_SQL}
select count(*) as total_queries, string_agg(distinct user_role, ',' order by user_role) as roles from u""")
def usage_summary(spark, sf):
    return M.usage_summary(usage_log(spark, sf)).withColumn("roles", F.array_join("roles", ","))


@register("recommendations", with_views(f"""
with {_VIOL_CTE.rstrip().rstrip(',')},
{USAGE_SQL},
pop as (select string_agg(column_name, ', ' order by uses desc, column_name) as popular
        from (select column_name, count(*) as uses from (select unnest(columns_accessed) as column_name from u)
              group by 1 order by uses desc, column_name limit 5)),
s as (select product, round(composite, 1) as score, {_GRADE} as grade from ({_REPORT3})),
c as (select product, count(*) as k from v where hit group by 1),
nc as (select 'orders_nulls' as product, 'o_orderstatus' as column_name,
              count(*) filter (where o_orderstatus is null) / count(*) * 100 as pct from orders_nulls
       union all select 'orders_nulls', 'o_totalprice',
              count(*) filter (where o_totalprice is null) / count(*) * 100 from orders_nulls)
select s.product, 'low_score' as rule, 'Quality score is ' || printf('%.1f', round(s.score, 1)) || '/100 — investigate data issues' as message
from s where s.score < 70
union all select product, 'low_grade', 'Quality grade is below acceptable threshold — data contract review needed'
from s where grade in ('D', 'F')
union all select product, 'contract', 'Data contract violations detected — review contract compliance'
from c where k > 0
union all select product, 'owner', 'No owner assigned — assign a domain owner for accountability' from s
union all select s.product, 'usage', 'Most queried columns: ' || pop.popular || ' — consider pre-aggregation'
from s, pop where (select count(*) from u) > 10
union all select product, 'nulls', 'Column ''' || column_name || ''' has ' || printf('%.0f', round(pct, 0)) || '% nulls — consider imputation'
from nc where pct > 20
""", *VIEW3))
def recommendations(spark, sf):
    # one contract and one stored profile a view serve all rules
    contract = clean_contract(spark, sf)
    found = assessments(spark, sf, VIEW3, contract=contract)
    contracts, status = _status(spark, sf, contract=contract, profiles={name: one.profile for name, one in found.items()})
    prods = M.quality_badge(M.catalog_products(_entries(spark, sf), contracts, status),
                            reports(spark, sf, VIEW3, found=found))
    cols = None
    for name in VIEW3:
        c = P.column_facts(VIEWS[name](spark, sf), prof=found[name].profile).select(
            F.lit(name).alias("product"), "column_name", "null_count")
        cols = c if cols is None else cols.unionByName(c)
    return M.recommendations(prods, cols, usage_log(spark, sf))


def _tables_and_columns(spark, sf):
    entries = cols = None
    for name, df in all_tables(spark, sf).items():
        e = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("product"), "row_count",
            F.lit(len(df.columns)).alias("column_count"))
        entries = e if entries is None else entries.unionByName(e)
        c = P.schema_table(df).select(F.lit(name).alias("product"), "column_name", "ordinal")
        cols = c if cols is None else cols.unionByName(c)
    return entries, cols


@register("catalog_entries", "\nunion all ".join(
    f"select '{t}' as product, count(*) as row_count, "
    f"(select count(*) from information_schema.columns where table_name = '{t}') as column_count, "
    f"(select string_agg(column_name, ',' order by ordinal_position) from information_schema.columns "
    f"where table_name = '{t}') as columns from {t}" for t in TABLES))
def catalog_entries(spark, sf):
    entries, cols = _tables_and_columns(spark, sf)
    return M.catalog_entries(entries, cols).withColumn("columns", F.array_join("columns", ","))


@register("catalog_summary", f"""
with h as (select event_type as product, cast(ts as date) as d, avg(value) as score from events group by 1, 2),
l as (select *, lag(score) over (partition by product order by d) as previous from h)
select {len(TABLES)}::bigint as total_products,
       ({" + ".join(f"(select count(*) from {t})" for t in TABLES)})::bigint as total_rows,
       (select count(*) from information_schema.columns where table_name in ({", ".join(f"'{t}'" for t in TABLES)})) as total_columns,
       (select count(*) from events) as total_queries,
       (select count(*) from l where previous is not null and score < previous - 10) as active_alerts,
       {len(TABLES)}::bigint as change_log_entries
""")
def catalog_summary(spark, sf):
    entries, cols = _tables_and_columns(spark, sf)
    alerts = M.quality_drop_alerts(score_history(spark, sf))
    return M.catalog_summary(entries, cols, usage_log(spark, sf), alerts, M.change_log(entries))


@register("usage_rows", """
with k as (select distinct user_id, event_type from events)
select k.event_type as product, 'user ' || k.user_id as query,
       (select string_agg(o.event_type || '_a,' || o.event_type || '_b', ',' order by o.event_type)
        from k o where o.user_id = k.user_id) as columns_accessed,
       case when k.user_id % 2 = 0 then 'manager' else 'analyst' end as user_role
from k""")
def usage_rows(spark, sf):
    """One usage row per user (a run) and event type (a product of two
    columns)."""
    columns = lambda p: F.struct(p.alias("key"), F.array(F.concat(p, F.lit("_a")), F.concat(p, F.lit("_b"))).alias("value"))
    used = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("products"))
    runs = used.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"), "products",
                       F.map_from_entries(F.transform("products", columns)).alias("relevant_columns"),
                       F.when(F.col("user_id") % 2 == 0, "manager").alias("user_role"),
                       F.lit(None).cast("timestamp").alias("timestamp"))
    return M.usage_rows(runs).drop("timestamp").withColumn("columns_accessed", F.array_join("columns_accessed", ","))
