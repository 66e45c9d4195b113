"""Keys of promises that are kept or broken: service levels (C9), the usage
log whose batches count once (M6), domain rules (E7) and governed reads (E3)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as M
from ..operators import contract as C
from ..operators import domain_rules as R
from ..operators import governance as E
from ..operators import governed as G
from ..operators import sla as A
from .catalog_suite import usage_log
from .registry import register
from .session import checkpoint_dir
from .tables import table
from .views import VIEWS, with_views


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/meshwork-{name}-{uuid.uuid4().hex}"


# -- usage log (M6) -----------------------------------------------------------------

#: The events in three batches, together all of them.
BATCHES = {"readers": "product in ('click', 'view')", "buyers": "product in ('signup', 'purchase')",
           "rest": "product not in ('click', 'view', 'signup', 'purchase') or product is null"}


@register("usage_committed", """
select event_type as product, case when value < 10 then 'analyst' when value < 50 then 'manager' else 'data_engineer' end as user_role,
       count(*) as queries, min(ts) as first_use, max(ts) as last_use
from events group by all""")
def usage_committed(spark, sf):
    """Usage per product and role from a log with a batch committed twice, an
    attempt that died before its marker and a compaction in between."""
    usage, path = usage_log(spark, sf), _folder(spark, "usage")
    log = M.committed_usage(spark, path)
    M.commit_usage(usage.where(BATCHES["readers"]), path, "readers")
    usage.where(BATCHES["buyers"]).write.parquet(f"{path}/data/buyers.dead")
    M.commit_usage(usage.where(BATCHES["buyers"]), path, "buyers")
    log.compact()
    for name, rows in BATCHES.items():
        M.commit_usage(usage.where(rows), path, name)
    return log.read().groupBy("product", "user_role").agg(
        F.count(F.lit(1)).alias("queries"), F.min("timestamp").alias("first_use"), F.max("timestamp").alias("last_use"))


# -- service levels (C9) --------------------------------------------------------------

def run_log(spark, sf):
    """Events as requests: type = product, 20 ms per unit of value; values of
    300 and more failed."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("product"), F.col("ts").alias("started_at"),
        (F.col("value") * 20).alias("duration_ms"), (F.col("value") < 300).alias("ok"))


RUN_SQL = """
runs as (select event_type as product, ts, value * 20 as ms, value < 300 as ok from events)"""
_P95 = "list_sort(list(ms))[greatest(ceil(0.95 * count(*)), 1)::bigint]"


@register("sla_checks", f"""
with {RUN_SQL},
c(product, availability, query_ms) as (values ('click', 99.0, 5000), ('view', 99.0, 5000), ('signup', 99.0, 5000),
  ('error', 99.99, 5000), ('purchase', 99.0, 1000), ('unused', 99.0, 5000)),
l as (select product, count(*) filter (where ok) / count(*) * 100 as availability, {_P95} as p95 from runs group by 1)
select c.product, 'availability_percent' as expectation, c.availability::double as threshold, l.availability as actual,
       l.availability >= c.availability as passed from c left join l using (product)
union all
select c.product, 'max_query_time_ms', c.query_ms, l.p95, l.p95 <= c.query_ms from c left join l using (product)
""")
def sla_checks(spark, sf):
    """Availability and 95th percentile of the query time of every product
    against its contract; two contracts are stricter, one product is unused."""
    products = C.product_table(spark, ["click", "view", "signup", "error", "purchase", "unused"])
    contracts = C.default_contract(products).withColumns({
        "availability_percent": F.when(F.col("product") == "error", 99.99).otherwise(F.col("availability_percent")),
        "max_query_time_ms": F.when(F.col("product") == "purchase", 1000).otherwise(F.col("max_query_time_ms"))})
    return A.check_sla(contracts, A.service_levels(run_log(spark, sf)))


@register("sla_days", f"""
with {RUN_SQL}
select product, date_trunc('day', ts)::timestamp as day, count(*) as requests,
       count(*) filter (where ok) / count(*) * 100 as availability_percent, {_P95} as query_time_ms
from runs group by 1, 2""")
def sla_days(spark, sf):
    """The same per product and day."""
    runs = run_log(spark, sf).withColumn("day", F.date_trunc("day", "started_at"))
    return A.service_levels(runs, ("product", "day"))


@register("sla_window", f"""
with {RUN_SQL},
w as (select * from runs where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25')
select product, count(*) as requests, count(*) filter (where ok) as succeeded, max(ms) as max_ms,
       round(sum(ms), 2) as total_ms, true as bounds_hold
from w group by 1""")
def sla_window(spark, sf):
    """Twenty days from stored hourly summaries, one batch committed twice;
    the sketch's bounds must hold the exact percentile of the rows."""
    runs, log = run_log(spark, sf), A.SlaLog(spark, _folder(spark, "sla"))
    for name in (*BATCHES, "buyers"):
        log.commit(name, runs.where(BATCHES[name]))
    since, until = "2024-01-05", "2024-01-25"
    bounds = A.estimates(log.window(since, until))
    rows = runs.where((F.col("started_at") >= since) & (F.col("started_at") < until))
    exact = A.grouped_quantile(rows, ["product"], "duration_ms", 0.95).select(F.col("product").alias("p"), "quantile")
    return bounds.join(exact, bounds["product"].eqNullSafe(exact["p"])).select(
        "product", "requests", "succeeded", "max_ms", F.round("total_ms", 2).alias("total_ms"),
        F.col("quantile").between(F.col("quantile_low"), F.col("quantile_high")).alias("bounds_hold"))


# -- domain rules (E7) ----------------------------------------------------------------

DOMAIN_RULES = [
    ("sales", "S01", "Prices positive", "error", "o_totalprice > 0"),
    ("sales", "S02", "Known status", "error", "o_orderstatus in ('F', 'O', 'P')"),
    ("sales", "S03", "Urgent orders settled", "warning",
     "o_orderdate >= date '1993-01-01' and not (o_orderpriority like '%URGENT' and o_orderstatus = 'P')"),
    ("sales", "S04", "Channel given", "error", "o_channel is not null"),
    ("sales", "S05", "Usual price", "info", "o_totalprice between 1000 and 400000.5 or o_orderstatus is null"),
    ("crm", "K01", "Names of one form", "error", "length(c_name) = 18 and upper(c_mktsegment) = c_mktsegment"),
    ("crm", "K02", "Balance above the limit", "warning", "c_acctbal >= -500.5"),
    ("crm", "K03", "Balance is text", "error", "c_acctbal = 'high'"),
    ("ops", "E01", "Events in range", "warning", "value < 300 and event_type is not null and year(ts) = 2024")]
RULE_DOMAINS = {"orders": "sales", "orders_nulls": "sales", "orders_badvals": "sales", "customer": "crm", "events": "ops",
                "nation": "geography"}


def _rule_products(spark, sf):
    return {name: VIEWS[name](spark, sf) if name in VIEWS else table(spark, sf, name) for name in RULE_DOMAINS}


def _rules(spark):
    return spark.createDataFrame(DOMAIN_RULES, "domain string, rule_id string, name string, severity string, condition string")


_SALES_TESTS = {
    "S01": "o_totalprice > 0", "S02": "o_orderstatus in ('F', 'O', 'P')",
    "S03": "o_orderdate >= date '1993-01-01' and not (o_orderpriority like '%URGENT' and o_orderstatus = 'P')",
    "S05": "(o_totalprice >= 1000 and o_totalprice <= 400000.5) or o_orderstatus is null"}
_TESTS = [(p, i, t) for p in ("orders", "orders_nulls", "orders_badvals") for i, t in _SALES_TESTS.items()] + [
    ("customer", "K01", "length(c_name) = 18 and upper(c_mktsegment) = c_mktsegment"),
    ("customer", "K02", "c_acctbal >= -500.5"),
    ("events", "E01", "value < 300 and event_type is not null and year(ts) = 2024")]
_WARNS = "('S03', 'S05', 'K02', 'E01')"


@register("domain_rule_checks", with_views("""
with t as (
""" + "\nunion all ".join(
    f"select '{p}' as product, '{i}' as rule_id, count(*) as n, count(*) filter (where not ({t})) as bad, "
    f"count(*) filter (where ({t}) is null) as unknown from {p}" for p, i, t in _TESTS) + f""")
select product, rule_id, case when bad = 0 then 'pass' when rule_id in {_WARNS} then 'warning' else 'fail' end as status,
       n as rows_checked, bad as offending_rows, unknown as unknown_rows,
       bad || ' of ' || n || ' rows break the rule' || case when unknown > 0 then ', ' || unknown || ' unknown' else '' end as message
from t
union all select p, 'S04', 'error', null, null, null, 'Rule cannot be evaluated: no column ''o_channel'''
from (values ('orders'), ('orders_nulls'), ('orders_badvals')) v(p)
union all select 'customer', 'K03', 'error', null, null, null, 'Rule cannot be evaluated: number and text cannot be compared'
""", "orders_nulls", "orders_badvals"))
def domain_rule_checks(spark, sf):
    """Rules of three domains on the data of their products."""
    return R.domain_checks(_rule_products(spark, sf), RULE_DOMAINS, _rules(spark)).drop("rule_name", "severity")


@register("domain_rule_offenders", with_views("""
with b as (
  select o_orderkey, o_totalprice,
         list_filter([case when not (o_totalprice > 0) then 'S01' end,
                      case when not (o_orderstatus in ('F', 'O', 'P')) then 'S02' end,
                      case when not (o_orderdate >= date '1993-01-01' and not (o_orderpriority like '%URGENT' and o_orderstatus = 'P')) then 'S03' end,
                      case when not ((o_totalprice >= 1000 and o_totalprice <= 400000.5) or o_orderstatus is null) then 'S05' end],
                     lambda x: x is not null) as broken
  from orders_badvals)
select o_orderkey, array_to_string(broken, ',') as broken_rules from b where len(broken) > 0
""", "orders_badvals"))
def domain_rule_offenders(spark, sf):
    """Orders that break a sales rule, with the rules they break."""
    rows = R.offending_rows(VIEWS["orders_badvals"](spark, sf), _rules(spark), "sales")
    return rows.select("o_orderkey", F.array_join("broken_rules", ",").alias("broken_rules"))


# -- governed reads (E3) ----------------------------------------------------------------

#: What becomes of restricted columns, per role; guests are refused anyway.
READERS = [("manager", "refuse"), ("data_engineer", "refuse"), ("analyst", "refuse"), ("analyst", "drop"),
           ("analyst", "null"), ("analyst", "hash"), ("analyst", "last4"), ("analyst", "initial"),
           ("analyst", "constant"), ("guest", "hash")]


@register("governed_customers", """
with r(role, way) as (values """ + ", ".join(f"('{r}', '{w}')" for r, w in READERS) + """),
v as (
  select role, way, c_mktsegment as segment, c_acctbal,
         case when role in ('manager', 'data_engineer') then c_name
              when way = 'hash' then sha256('pepper' || c_name) when way = 'last4' then '***' || right(c_name, 4)
              when way = 'initial' then left(c_name, 1) || '***' when way = 'constant' then '***' end as name
  from customer, r where role in ('manager', 'data_engineer') or (role = 'analyst' and way <> 'refuse'))
select role, way, segment, count(*) as customers, count(distinct name) as names, min(name) as first_name,
       round(sum(c_acctbal), 2) as balance
from v group by all""")
def governed_customers(spark, sf):
    """Customers per segment as each role may read them: the policy is that
    of the table's personal-data columns; refused reads have no rows."""
    customer = table(spark, sf, "customer")
    policies = E.access_policies(E.columns_table(spark, {"customer": customer}))
    out = None
    for role, way in READERS:
        seen = G.read_or_none(customer, "customer", role, policies, ["c_name", "c_mktsegment", "c_acctbal"],
                              restricted=way, salt="pepper")
        if seen is None:
            continue
        name = F.col("c_name") if "c_name" in seen.columns else F.lit(None).cast("string")
        one = seen.groupBy(F.col("c_mktsegment").alias("segment")).agg(
            F.count(F.lit(1)).alias("customers"), F.count_distinct(name).alias("names"), F.min(name).alias("first_name"),
            F.round(F.sum("c_acctbal"), 2).alias("balance")).select(
            F.lit(role).alias("role"), F.lit(way).alias("way"), "*")
        out = one if out is None else out.unionByName(one)
    return out
