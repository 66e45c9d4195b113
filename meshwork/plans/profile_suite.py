"""Profiling keys (B1-B10) and contract keys."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import graph as G
from ..operators import graph_queries as Q
from ..operators import profile as P
from .registry import register
from .session import together
from .tables import table
from .views import VIEWS, with_views

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("profile_columns", """
select column_name, ordinal, data_type, (select count(*) from orders) as row_count
from (values ('o_orderkey', 0, 'bigint'), ('o_custkey', 1, 'bigint'),
             ('o_orderstatus', 2, 'string'), ('o_totalprice', 3, 'double'),
             ('o_orderdate', 4, 'timestamp_ntz'), ('o_orderpriority', 5, 'string'))
     as t(column_name, ordinal, data_type)
""")
def profile_columns(spark, sf):
    return P.profile_columns(table(spark, sf, "orders"))


@register("profile_nulls", with_views("""
select 'o_orderkey' as column_name, count(*) filter (where o_orderkey is null) as null_count from orders_nulls
union all select 'o_custkey', count(*) filter (where o_custkey is null) from orders_nulls
union all select 'o_orderstatus', count(*) filter (where o_orderstatus is null) from orders_nulls
union all select 'o_totalprice', count(*) filter (where o_totalprice is null or isnan(o_totalprice)) from orders_nulls
union all select 'o_orderdate', count(*) filter (where o_orderdate is null) from orders_nulls
union all select 'o_orderpriority', count(*) filter (where o_orderpriority is null) from orders_nulls
""", "orders_nulls"))
def profile_nulls(spark, sf):
    return P.null_counts(VIEWS["orders_nulls"](spark, sf))


@register("profile_distinct", "\nunion all ".join(
    f"select '{c}' as column_name, count(distinct {c}) as distinct_count from lineitem"
    for c in LINEITEM_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"]))
def profile_distinct(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"))


@register("profile_top_values", """
with vc as (
  select 'p_name' as column_name, p_name as value, count(*) as n from part group by 2
  union all select 'p_brand', p_brand, count(*) from part group by 2
  union all select 'p_type', p_type, count(*) from part group by 2),
small as (select column_name from vc group by 1 having count(*) <= 20),
ranked as (
  select column_name, value, n,
         cast(row_number() over (partition by column_name order by n desc, value) as integer) as rank
  from vc where column_name in (select column_name from small))
select column_name, rank, value, n from ranked where rank <= 10
""")
def profile_top_values(spark, sf):
    return P.categorical_profile(table(spark, sf, "part"))


@register("profile_numeric", "\nunion all ".join(
    f"select '{c}' as column_name, cast(min({c}) as double) as min_value, "
    f"cast(max({c}) as double) as max_value, round(avg({c}), 6) as mean_value, "
    f"quantile_cont(cast({c} as double), 0.5) as median_value from lineitem"
    for c in LINEITEM_NUM))
def profile_numeric(spark, sf):
    return (P.numeric_profile(table(spark, sf, "lineitem"))
            .withColumn("mean_value", F.round("mean_value", 6)))


@register("result_numeric_summary", """
with r as (
  select o_orderpriority as dimension, count(*) as total,
         count(*) filter (where o_orderstatus = 'F') as positives,
         round(count(*) filter (where o_orderstatus = 'F') / count(*) * 100, 2) as rate_pct
  from orders group by 1)
select 'total' as column_name, round(cast(min(total) as double), 2) as min_value,
       round(cast(max(total) as double), 2) as max_value, round(avg(total), 2) as mean_value from r
union all
select 'positives', round(cast(min(positives) as double), 2), round(cast(max(positives) as double), 2),
       round(avg(positives), 2) from r
union all
select 'rate_pct', round(min(rate_pct), 2), round(max(rate_pct), 2), round(avg(rate_pct), 2) from r
""")
def result_numeric_summary(spark, sf):
    g = G.build_graph(table(spark, sf, "orders"), G.ORDERS_GRAPH)
    result = Q.rate_by_dimension(g, "HAS_PRIORITY", "HAS_STATUS", "F")
    return P.result_numeric_summary(result)


@register("column_value_counts", """
select cast(o_custkey as varchar) as value, count(*) as n from orders
where o_custkey is not null
group by 1 order by n desc, value limit 20
""")
def column_value_counts(spark, sf):
    return P.column_value_counts(table(spark, sf, "orders"), "o_custkey", 20)


@register("cross_counts", """
select o_orderpriority, o_orderstatus, count(*) as n from orders
where o_orderpriority is not null and o_orderstatus is not null
group by 1, 2 order by 1, 2
""")
def cross_counts(spark, sf):
    return P.cross_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@register("column_listing", """
select 'p_partkey' as column_name, 'bigint' as data_type, count(distinct p_partkey) as distinct_count from part
union all select 'p_name', 'string', count(distinct p_name) from part
union all select 'p_brand', 'string', count(distinct p_brand) from part
union all select 'p_type', 'string', count(distinct p_type) from part
union all select 'p_size', 'int', count(distinct p_size) from part
union all select 'p_retailprice', 'double', count(distinct p_retailprice) from part
""")
def column_listing(spark, sf):
    return P.column_listing(table(spark, sf, "part"))


# -- contracts -----------------------------------------------------------------

PRODUCT_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations", "orders_nulls",
                 "orders_dups", "orders_badvals")


@register("default_contract", """
with n as (""" + "\nunion all ".join(
    f"select '{t}' as product, count(*) as row_count from {t}" for t in PRODUCT_NAMES[:14]) + """
  union all select 'orders_nulls', count(*) from orders
  union all select 'orders_dups', (select count(*) from orders)
       + (select count(*) from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')
  union all select 'orders_badvals', count(*) from orders)
select product, n.row_count, '1.0.0' as version, 'auto-detected' as owner, 'data-platform' as team,
       case when contains(product, '_') then split_part(product, '_', 1) else 'general' end as domain,
       'Auto-generated contract for ' || product as description,
       product as tags, 'csv,graph,dataframe' as output_ports,
       24 as freshness_hours, cast(99.0 as double) as availability_percent, 5000 as max_query_time_ms
from n
""")
def default_contract(spark, sf):
    """C1 for every test table and messy view, with each product's row
    count (the registry entry the contract belongs to)."""
    frames = {t: table(spark, sf, t) for t in PRODUCT_NAMES[:14]}
    frames.update({v: VIEWS[v](spark, sf) for v in PRODUCT_NAMES[14:]})
    counts = None
    for name, df in frames.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("product"), "row_count")
        counts = c if counts is None else counts.unionByName(c)
    out = C.default_contract(counts).join(counts, "product")
    return (out.withColumn("tags", F.array_join("tags", ","))
            .withColumn("output_ports", F.array_join("output_ports", ",")))


def _contract_sql(view: str, cols: list[tuple[str, str, bool]]) -> str:
    """SQL for the inferred contract of one table: (name, type, is_text)."""
    parts = []
    for i, (c, t, is_text) in enumerate(cols):
        allowed = (f"case when count(distinct {c}) <= 20 then "
                   f"array_to_string(list_sort(list(distinct {c}) filter (where {c} is not null)), ',') end"
                   if is_text else "cast(null as varchar)")
        parts.append(
            f"select {i} as ordinal, '{c}' as column_name, '{t}' as expected_type, "
            f"count(*) filter (where {c} is null) > 0 as nullable, "
            f"count(distinct {c}) = count(*) as \"unique\", {allowed} as allowed_values, "
            f"'Auto-detected: {t}, ' || count(distinct {c}) || ' unique values' as description "
            f"from {view}")
    return ("select '" + view + "' as product, column_name, expected_type, nullable, \"unique\", "
            "allowed_values, description from (" + "\nunion all ".join(parts) + ")")


ORDERS_COLS = [("o_orderkey", "bigint", False), ("o_custkey", "bigint", False),
               ("o_orderstatus", "string", True), ("o_totalprice", "double", False),
               ("o_orderdate", "timestamp_ntz", False),
               ("o_orderpriority", "string", True)]


def _flat_contract(df):
    return df.withColumn("allowed_values", F.array_join("allowed_values", ","))


@register("infer_contract", with_views(_contract_sql("orders_nulls", ORDERS_COLS),
                                       "orders_nulls"))
def infer_contract(spark, sf):
    return _flat_contract(C.infer_contract("orders_nulls", VIEWS["orders_nulls"](spark, sf)))


def orders_contract(spark, sf, contract=None):
    """The contract inferred on clean ``orders`` (``contract`` if made
    before), with one column more than the data has."""
    from .quality_suite import clean_contract
    absent = spark.createDataFrame([("orders", "o_comment", "string", True, False, None, "")], C.COLUMN_SCHEMA)
    return (clean_contract(spark, sf) if contract is None else contract).unionByName(absent)


def _viol_arms(view):
    """SQL arms of the contract checks of ``view`` against the contract
    inferred (in SQL) on clean orders."""
    arms = [f"select '{view}' as product, 'o_comment' as column_name, 'missing' as \"check\", "
            f"'Missing column: o_comment' as message, true as hit"]
    for c, _t, is_text in ORDERS_COLS:
        nulls = f"count(*) filter (where {c} is null)"
        arms.append(
            f"select '{view}' as product, '{c}' as column_name, 'nullable' as \"check\", "
            f"'{c}: has ' || printf('%.1f', round({nulls} / count(*) * 100, 1)) || '% nulls but nullable=False' as message, "
            f"{nulls} > 0 and (select count(*) filter (where {c} is null) = 0 from orders) as hit from {view}")
        groups = f"(count(distinct {c}) + case when {nulls} > 0 then 1 else 0 end)"
        arms.append(
            f"select '{view}', '{c}', 'unique', "
            f"'{c}: has ' || printf('%.1f', round((count(*) - {groups}) / count(*) * 100, 1)) || '% duplicates but unique=True', "
            f"{groups} < count(*) and (select count(distinct {c}) = count(*) from orders) from {view}")
        if is_text:
            allowed = f"(select list(distinct {c}) from orders)"
            arms.append(
                f"select '{view}', '{c}', 'allowed', "
                f"'{c}: invalid values [' || string_agg(distinct {c}, ', ' order by {c}) || '] (allowed: [' || "
                f"(select string_agg(distinct {c}, ', ' order by {c}) from orders) || '])', "
                f"count(*) > 0 and (select count(distinct {c}) <= 20 from orders) "
                f"from {view} where {c} is not null and not list_contains({allowed}, {c})")
    return arms


_VIOL_SQL = ("with v as (\n" + "\nunion all ".join(
    a for view in ("orders_nulls", "orders_dups", "orders_badvals") for a in _viol_arms(view))
    + "\n)\nselect product, column_name, \"check\", message from v where hit\n")


def _violations(spark, sf, clean=False, contract=None, profiles=None):
    """``profiles``: stored column profiles of the views, made with the lists of ``contract``."""
    contract = orders_contract(spark, sf, contract)
    frames = {name: VIEWS[name](spark, sf) for name in ("orders_nulls", "orders_dups", "orders_badvals")}
    jobs = [lambda name=name, df=df: C.contract_violations(
        name, df, contract.withColumn("product", F.lit(name)), prof=(profiles or {}).get(name))
            for name, df in frames.items()]
    if clean:
        # the clean table against its own contract: no violation
        jobs.append(lambda: C.contract_violations("orders", table(spark, sf, "orders"), contract.where("column_name <> 'o_comment'")))
    parts = together(*jobs)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register("contract_violations", with_views(_VIOL_SQL, "orders_nulls", "orders_dups",
                                            "orders_badvals"))
def contract_violations(spark, sf):
    return _violations(spark, sf)


#: A list that allows one customer name: all other names are invalid.
ONE_CUSTOMER = "Customer#000000001"


@register("contract_invalid_values", with_views("\nunion all ".join([
    f"select '{view}' as product, '{c}' as column_name, 'allowed' as \"check\", {c} as value, count(*) as n from {view} "
    f"where {c} is not null and {c} not in (select {c} from orders) and (select count(distinct {c}) <= 20 from orders) group by {c}"
    for view in ("orders_nulls", "orders_dups", "orders_badvals") for c, _t, is_text in ORDERS_COLS if is_text]
    + [f"select 'customer', 'c_name', 'allowed', c_name, count(*) from customer where c_name <> '{ONE_CUSTOMER}' group by c_name"]),
    "orders_nulls", "orders_dups", "orders_badvals"))
def contract_invalid_values(spark, sf):
    """Every invalid value as a row, also of an id-like column."""
    contract = orders_contract(spark, sf)
    one = spark.createDataFrame([("customer", "c_name", "string", True, False, [ONE_CUSTOMER], "")], C.COLUMN_SCHEMA)
    out = C.invalid_values("customer", table(spark, sf, "customer"), one)
    for name in ("orders_nulls", "orders_dups", "orders_badvals"):
        out = out.unionByName(C.invalid_values(name, VIEWS[name](spark, sf), contract.withColumn("product", F.lit(name))))
    return out


@register("contract_status", with_views(
    "with " + _VIOL_SQL.strip()[5:].replace(
        "select product, column_name, \"check\", message from v where hit",
        """, p(product) as (values ('orders'), ('orders_nulls'), ('orders_dups'), ('orders_badvals')),
c as (select product, count(*) as n, string_agg(message, '; ' order by message) as violations
      from v where hit group by 1)
select p.product, '1.0.0' as contract_version, coalesce(c.n, 0) as violation_count,
       coalesce(c.violations, '') as violations, coalesce(c.n, 0) = 0 as is_compliant
from p left join c using (product)"""),
    "orders_nulls", "orders_dups", "orders_badvals"))
def contract_status(spark, sf):
    names = ["orders", "orders_nulls", "orders_dups", "orders_badvals"]
    contracts = C.default_contract(C.product_table(spark, names))
    status = C.contract_status(contracts, _violations(spark, sf, clean=True))
    return status.withColumn("violations", F.array_join("violations", "; "))


@register("compliance_report", with_views(
    "with " + _VIOL_SQL.strip()[5:].replace(
        "select product, column_name, \"check\", message from v where hit",
        """, p(product) as (values ('orders'), ('orders_nulls'), ('orders_dups'), ('orders_badvals')),
c as (select product, count(*) as n from v where hit group by 1),
s as (select p.product, coalesce(c.n, 0) as n, coalesce(c.n, 0) = 0 as ok from p left join c using (product))
select count(*) as total_products, count(*) filter (where ok) as compliant,
       count(*) filter (where not ok) as non_compliant,
       string_agg(product || ' ' || ok || ' ' || n, ', ' order by product) as details from s"""),
    "orders_nulls", "orders_dups", "orders_badvals"))
def compliance_report(spark, sf):
    entry = lambda d: F.concat_ws(" ", d["product"], d["is_compliant"].cast("string"),
                                  d["violation_count"].cast("string"))
    report = C.compliance_report(contract_status(spark, sf))
    return report.withColumn("details", F.array_join(F.transform("details", entry), ", "))


@register("profile_nested", """
select 'embeddings' as product, 'embedding' as column_name, count(distinct embedding) as distinct_count from embeddings
union all select 'embeddings', 'label', count(distinct label) from embeddings
union all select 'embeddings', 'vec_id', count(distinct vec_id) from embeddings
union all select 'signed zeros', 'x', count(distinct case when o_orderstatus = 'F' then 1.5 else 0 end) from orders
union all select 'signed zeros', 'pair', count(distinct [o_orderstatus, o_orderpriority]) from orders
union all select 'signed zeros', 'record', count(distinct {'a': o_orderstatus, 'b': o_orderpriority}) from orders
union all select 'signed zeros', 'entries', count(distinct [o_orderpriority, o_orderstatus]) from orders
""")
def profile_nested(spark, sf):
    """Distinct values of array, struct and map columns and of a number that
    is 0.0, -0.0 or 1.5."""
    zero = (F.when(F.col("o_orderstatus") == "P", F.lit(-0.0)).when(F.col("o_orderstatus") == "O", F.lit(0.0))
            .otherwise(1.5))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    zeros = table(spark, sf, "orders").select(
        zero.alias("x"), F.array(status, priority).alias("pair"),
        F.struct(status.alias("a"), priority.alias("b")).alias("record"),
        F.create_map(priority, status).alias("entries"))
    out = None
    for name, df in (("embeddings", table(spark, sf, "embeddings")), ("signed zeros", zeros)):
        one = P.distinct_counts(df).select(F.lit(name).alias("product"), "column_name", "distinct_count")
        out = one if out is None else out.unionByName(one)
    return out
