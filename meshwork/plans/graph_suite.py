"""Graph and graph-query keys on ``orders`` (entity) with the dimensions
``o_orderpriority`` and ``o_orderstatus``; status ``F`` plays the churned
status and ``o_totalprice`` the charges."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import graph_queries as Q
from .registry import register
from .tables import table
from .views import orders_dups, with_views


def orders_graph(spark, sf):
    return G.build_graph(table(spark, sf, "orders"), G.ORDERS_GRAPH)


@register("rate_by_dimension", """
select o_orderpriority as dimension, count(*) as total,
       count(*) filter (where o_orderstatus = 'F') as positives,
       round(count(*) filter (where o_orderstatus = 'F') / count(*) * 100, 2) as rate_pct
from orders
where o_orderkey is not null and o_orderpriority is not null and o_orderpriority <> ''
  and o_orderstatus is not null and o_orderstatus <> ''
group by o_orderpriority
""")
def rate_by_dimension(spark, sf):
    return Q.rate_by_dimension(orders_graph(spark, sf), "HAS_PRIORITY",
                               "HAS_STATUS", "F")


def dups_graph(spark, sf):
    """Entities with repeated ids."""
    return G.build_graph(orders_dups(spark, sf), G.ORDERS_GRAPH)


@register("rate_with_repeated_ids", with_views("""
select o_orderpriority as dimension, count(*) as total,
       count(*) filter (where o_orderstatus = 'P') as positives,
       round(count(*) filter (where o_orderstatus = 'P') / count(*) * 100, 2) as rate_pct
from orders_dups
where o_orderkey is not null and o_orderpriority <> '' and o_orderstatus <> ''
group by o_orderpriority
""", "orders_dups"))
def rate_with_repeated_ids(spark, sf):
    return Q.rate_by_dimension(dups_graph(spark, sf), "HAS_PRIORITY", "HAS_STATUS", "P")


@register("measures_with_repeated_ids", with_views("""
select o_orderpriority as dimension, count(*) as row_count,
       avg(o_totalprice) as avg_value, sum(o_totalprice) as sum_value,
       max(o_totalprice) as max_value, min(o_totalprice) as min_value
from orders_dups where o_orderkey is not null and o_orderpriority <> ''
group by o_orderpriority
""", "orders_dups"))
def measures_with_repeated_ids(spark, sf):
    return Q.aggregate_measures(dups_graph(spark, sf), "o_totalprice", by_rel="HAS_PRIORITY")


@register("match_with_repeated_ids", with_views("""
select 'Order:' || o_orderkey as node_id, o_orderpriority as priority,
       o_orderstatus as status, o_custkey
from orders_dups
where o_orderkey is not null and o_orderpriority <> '' and o_orderstatus <> ''
""", "orders_dups"))
def match_with_repeated_ids(spark, sf):
    return Q.match_star(dups_graph(spark, sf), {"HAS_PRIORITY": "priority", "HAS_STATUS": "status"},
                        ["o_custkey"])


@register("graph_nodes", """
select 'Order:' || o_orderkey as node_id, 'Order' as label,
       cast(o_orderkey as varchar) as key,
       'o_custkey=' || o_custkey || ';o_orderdate=' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
         || ';o_orderkey=' || o_orderkey || ';o_orderpriority=' || o_orderpriority
         || case when o_orderstatus <> 'P' then ';o_orderstatus=' || o_orderstatus else '' end
         as props
from orders
union all
select distinct 'Priority:' || o_orderpriority, 'Priority', o_orderpriority, 'type=' || o_orderpriority
from orders where o_orderpriority is not null
union all
select distinct 'Status:' || o_orderstatus, 'Status', o_orderstatus, 'status=' || o_orderstatus
from orders where o_orderstatus <> 'P'
""")
def graph_nodes(spark, sf):
    """Nodes with their properties as sorted text; status P is null here, so
    a null property must be missing. The price is left out: the engines write
    floating-point numbers differently."""
    orders = table(spark, sf, "orders").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).drop("o_totalprice")
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return G.build_graph(orders, G.ORDERS_GRAPH).nodes.withColumn(
        "props", F.array_join(F.array_sort(F.transform(F.map_entries("props"), pair)), ";"))


@register("graph_edges", """
select 'Order:' || o_orderkey as src, 'HAS_PRIORITY' as rel,
       'Priority:' || o_orderpriority as dst, 'Order' as src_label,
       'Priority' as dst_label, o_orderpriority as dst_key
from orders where o_orderkey is not null and o_orderpriority <> ''
union all
select 'Order:' || o_orderkey, 'HAS_STATUS', 'Status:' || o_orderstatus,
       'Order', 'Status', o_orderstatus
from orders where o_orderkey is not null and o_orderstatus <> ''
""")
def graph_edges(spark, sf):
    return orders_graph(spark, sf).edges


@register("label_counts", """
select 'Order' as label, count(*) as node_count from orders
union all
select 'Priority', count(distinct o_orderpriority) from orders
union all
select 'Status', count(distinct o_orderstatus) from orders
""")
def label_counts(spark, sf):
    return G.label_counts(orders_graph(spark, sf))


@register("relationship_counts", """
select 'HAS_PRIORITY' as rel, count(*) as rel_count from orders
where o_orderkey is not null and o_orderpriority <> ''
union all
select 'HAS_STATUS', count(*) from orders
where o_orderkey is not null and o_orderstatus <> ''
""")
def relationship_counts(spark, sf):
    return G.relationship_counts(orders_graph(spark, sf))


@register("graph_totals", """
select (select count(*) + count(distinct o_orderpriority) + count(distinct o_orderstatus)
        from orders) as nodes,
       (select count(*) filter (where o_orderpriority <> '')
             + count(*) filter (where o_orderstatus <> '') from orders
        where o_orderkey is not null) as relationships
""")
def graph_totals(spark, sf):
    return G.graph_totals(orders_graph(spark, sf))


@register("relationship_patterns", """
select 'Order' as src_label, 'HAS_PRIORITY' as rel, 'Priority' as dst_label,
       count(*) as rel_count
from orders where o_orderkey is not null and o_orderpriority <> ''
union all
select 'Order', 'HAS_STATUS', 'Status', count(*)
from orders where o_orderkey is not null and o_orderstatus <> ''
""")
def relationship_patterns(spark, sf):
    return G.relationship_patterns(orders_graph(spark, sf))


@register("label_properties", """
select 'Order' as label, 'o_custkey' as property, 'int' as value_type,
       cast(min(o_custkey) as varchar) as sample from orders
union all select 'Order', 'o_orderdate', 'str', cast(min(o_orderdate) as varchar) from orders
union all select 'Order', 'o_orderkey', 'int', cast(min(o_orderkey) as varchar) from orders
union all select 'Order', 'o_orderpriority', 'str', min(o_orderpriority) from orders
union all select 'Order', 'o_orderstatus', 'str', min(o_orderstatus) from orders
union all select 'Order', 'o_totalprice', 'float', cast(min(o_totalprice) as varchar) from orders
union all select 'Priority', 'type', 'str', min(o_orderpriority) from orders
union all select 'Status', 'status', 'str', min(o_orderstatus) from orders
""")
def label_properties(spark, sf):
    return G.label_properties(orders_graph(spark, sf))


@register("dimension_values", """
select distinct 'Priority' as label, o_orderpriority as value from orders
where o_orderpriority is not null
union all
select distinct 'Status', o_orderstatus from orders where o_orderstatus is not null
""")
def dimension_values(spark, sf):
    return G.dimension_values(orders_graph(spark, sf))


@register("graph_is_current", """
with snap as (
  select 'all' as snapshot, * from orders
  union all select 'not low', * from orders where o_orderpriority <> '5-LOW'
  union all select 'cheap', * from orders where o_totalprice < 450000
  union all select 'no status', o_orderkey, o_custkey, null, o_totalprice, o_orderdate, o_orderpriority from orders)
select snapshot, count(*) as entity_nodes, (select count(*) from orders) as expected_rows,
       (count(distinct o_orderpriority) > 0 and count(distinct o_orderstatus) > 0
        and count(*) >= (select count(*) from orders) * 0.9) as is_current
from snap group by snapshot
""")
def graph_is_current(spark, sf):
    """Snapshots of the graph against the table they were made from: whole,
    too few rows, a few rows short, and without one dimension."""
    orders = table(spark, sf, "orders")
    expected = orders.agg(F.count(F.lit(1)).alias("rows"))
    snapshots = {"all": orders, "not low": orders.where("o_orderpriority <> '5-LOW'"),
                 "cheap": orders.where("o_totalprice < 450000"),
                 "no status": orders.withColumn("o_orderstatus", F.lit(None).cast("string"))}
    out = None
    for name, df in snapshots.items():
        one = G.graph_is_current(G.build_graph(df, G.ORDERS_GRAPH).nodes, expected, "Order",
                                 ["Order", "Priority", "Status"]).select(F.lit(name).alias("snapshot"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("match_1hop", """
select o_orderkey, o_totalprice, o_orderpriority as priority from orders
where o_orderkey is not null and o_orderpriority <> ''
""")
def match_1hop(spark, sf):
    return Q.match_1hop(orders_graph(spark, sf), "HAS_PRIORITY", "priority",
                        ["o_orderkey", "o_totalprice"]).drop("node_id")


@register("match_star", """
select 'Order:' || o_orderkey as node_id, o_orderpriority as priority,
       o_orderstatus as status, o_custkey
from orders
where o_orderkey is not null and o_orderpriority <> '' and o_orderstatus <> ''
""")
def match_star(spark, sf):
    return Q.match_star(orders_graph(spark, sf),
                        {"HAS_PRIORITY": "priority", "HAS_STATUS": "status"},
                        ["o_custkey"])


@register("avg_by_dimension", """
select o_orderpriority as dimension, round(avg(o_totalprice), 2) as avg_value
from orders where o_orderkey is not null and o_orderpriority <> ''
group by o_orderpriority
""")
def avg_by_dimension(spark, sf):
    return Q.avg_by_dimension(orders_graph(spark, sf), "HAS_PRIORITY",
                              "o_totalprice")


@register("filtered_count", """
select count(*) as matched from orders
where o_orderstatus = 'F' and o_totalprice > 250000 and o_orderkey is not null
""")
def filtered_count(spark, sf):
    return Q.filtered_count(orders_graph(spark, sf), "HAS_STATUS", "F",
                            F.col("o_totalprice") > 250000)


@register("status_cross_count", """
select o_orderpriority as dimension, o_orderstatus as status,
       count(*) as entity_count
from orders
where o_orderkey is not null and o_orderpriority <> '' and o_orderstatus <> ''
group by o_orderpriority, o_orderstatus
""")
def status_cross_count(spark, sf):
    return Q.status_cross_count(orders_graph(spark, sf), "HAS_PRIORITY",
                                "HAS_STATUS")


@register("filter_rows", """
select o_orderkey, o_custkey, o_totalprice from orders
where o_totalprice > 400000 and o_orderstatus = 'F'
""")
def filter_rows(spark, sf):
    return Q.filter_rows(orders_graph(spark, sf),
                         (F.col("o_totalprice") > 400000)
                         & (F.col("o_orderstatus") == "F"),
                         ["o_orderkey", "o_custkey", "o_totalprice"])


@register("list_entities", """
select * from orders order by o_orderkey limit 10
""")
def list_entities(spark, sf):
    return Q.list_entities(orders_graph(spark, sf), 10)


@register("aggregate_measures", """
select o_orderpriority as dimension, count(*) as row_count,
       avg(o_totalprice) as avg_value, sum(o_totalprice) as sum_value,
       max(o_totalprice) as max_value, min(o_totalprice) as min_value
from orders where o_orderkey is not null and o_orderpriority <> ''
group by o_orderpriority
""")
def aggregate_measures(spark, sf):
    return Q.aggregate_measures(orders_graph(spark, sf), "o_totalprice",
                                by_rel="HAS_PRIORITY")
