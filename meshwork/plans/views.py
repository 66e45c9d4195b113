"""Derived 'messy' views of the test tables.

The raw tables have no nulls and no duplicates, so quality rules need views
with faults put in by plain expressions. Each view is defined twice, once
with DataFrame functions and once as SQL text for the DuckDB oracle; the two
are written independently. All views read the whole table.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .tables import table

VIEW_SQL = {
    # status 'P' -> null (about a third: CRITICAL); price null for 5-LOW
    # (about 20 %: Warning)
    "orders_nulls": """
        select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus,
               case when o_orderpriority = '5-LOW' then null else o_totalprice end
                   as o_totalprice,
               o_orderdate, o_orderpriority
        from orders""",
    # urgent orders with status P appear twice
    "orders_dups": """
        select * from orders
        union all
        select * from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'""",
    # status X on urgent P orders; the contract allows F, O, P
    "orders_badvals": """
        select o_orderkey, o_custkey,
               case when o_orderpriority = '1-URGENT' and o_orderstatus = 'P'
                    then 'X' else o_orderstatus end as o_orderstatus,
               o_totalprice, o_orderdate, o_orderpriority
        from orders""",
    # the seventh line of every order is priced a hundred times too high
    "lineitem_outliers": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
               case when l_linenumber = 7 then l_extendedprice * 100
                    else l_extendedprice end as l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
        from lineitem""",
    # brands of size-50 parts get a stray '?': rare values
    "part_rare": """
        select p_partkey, p_name,
               case when p_size = 50 then p_brand || '?' else p_brand end as p_brand,
               p_type, p_size, p_retailprice
        from part""",
    # error events carry their value as the event type: mixed types
    "events_mixed": """
        select event_id, ts, user_id,
               case when event_type = 'error' then cast(value as varchar)
                    else event_type end as event_type,
               value, props
        from events""",
}


def orders_nulls(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
        .alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
        .alias("o_totalprice"),
        "o_orderdate", "o_orderpriority")


def orders_dups(spark, sf):
    o = table(spark, sf, "orders")
    return o.unionByName(o.where((F.col("o_orderpriority") == "1-URGENT")
                                 & (F.col("o_orderstatus") == "P")))


def orders_badvals(spark, sf):
    o = table(spark, sf, "orders")
    bad = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    return o.withColumn("o_orderstatus",
                        F.when(bad, F.lit("X")).otherwise(F.col("o_orderstatus")))


def lineitem_outliers(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn(
        "l_extendedprice",
        F.when(F.col("l_linenumber") == 7, F.col("l_extendedprice") * 100)
        .otherwise(F.col("l_extendedprice")))


def part_rare(spark, sf):
    p = table(spark, sf, "part")
    return p.withColumn("p_brand", F.when(F.col("p_size") == 50,
                                          F.concat("p_brand", F.lit("?")))
                        .otherwise(F.col("p_brand")))


def events_mixed(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumn("event_type",
                        F.when(F.col("event_type") == "error",
                               F.col("value").cast("string"))
                        .otherwise(F.col("event_type")))


VIEWS = {
    "orders_nulls": orders_nulls, "orders_dups": orders_dups,
    "orders_badvals": orders_badvals, "lineitem_outliers": lineitem_outliers,
    "part_rare": part_rare, "events_mixed": events_mixed,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views."""
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
