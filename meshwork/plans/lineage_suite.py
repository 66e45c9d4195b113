"""Lineage and run-log keys (L1-L7): conversations as query runs
(conversation = trace, turn = step)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lineage as L
from .registry import register
from .tables import TABLES, table


def runs(spark, sf):
    """One run per conversation: products = its non-user roles, query text
    = first user turn, rows = assistant turns, error = first system turn."""
    c = table(spark, sf, "conversations")
    first = lambda role: F.min(F.when(F.col("role") == role,
                                      F.struct("turn", "text")))["text"]
    return c.groupBy("conv_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") != "user", F.col("role"))))
        .alias("products"),
        first("user").alias("query_text"),
        F.count_if(F.col("role") == "assistant").alias("row_count"),
        first("system").alias("error")).select(
        F.col("conv_id").cast("string").alias("trace_id"), "products", "query_text",
        "row_count", "error")


def catalog(spark):
    return spark.createDataFrame([(t,) for t in TABLES], "product string")


def graphs(spark, sf):
    return L.lineage_graphs(runs(spark, sf), catalog(spark))


RUNS_SQL = f"""
r as (select cast(conv_id as varchar) as trace_id,
             coalesce(list_sort(list(distinct role) filter (where role <> 'user')), []) as products,
             arg_min(text, turn) filter (where role = 'user') as query_text,
             count(*) filter (where role = 'assistant') as row_count,
             arg_min(text, turn) filter (where role = 'system') as error
      from conversations group by conv_id),
cat as (select list_sort([{", ".join(f"'{t}'" for t in TABLES)}]) as c),
rs as (select r.*, case when len(products) > 0 then products else cat.c end as srcs from r, cat),
nodes as (
  select trace_id, trace_id || ':s' || (generate_subscripts(srcs, 1) - 1) as node_id, 'source' as node_type,
         unnest(srcs) as label, 'type=csv' as meta from rs
  union all select trace_id, trace_id || ':t1', 'transform', 'Generated Cypher',
         'cypher=' || substring(coalesce(query_text, ''), 1, 200) from rs
  union all select trace_id, trace_id || ':t2', 'transform', 'Analysis', 'agent=analyst_agent' from rs
  union all select trace_id, trace_id || ':k', 'sink', 'Certified Result', 'rows=' || row_count from rs),
edges as (
  select trace_id, node_id as from_node, trace_id || ':t1' as to_node, 'read' as operation
  from nodes where node_type = 'source'
  union all select trace_id, trace_id || ':t1', trace_id || ':t2', 'analyze' from rs
  union all select trace_id, trace_id || ':t2', trace_id || ':k', 'certify' from rs)"""


def _meta(col):
    return F.array_join(F.transform(F.map_entries(col),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@register("lineage_nodes", f"with {RUNS_SQL} select * from nodes")
def lineage_nodes(spark, sf):
    nodes, _ = graphs(spark, sf)
    return nodes.select("trace_id", "node_id", "node_type", "label",
                        _meta(F.col("metadata")).alias("meta"))


@register("lineage_edges", f"with {RUNS_SQL} select * from edges")
def lineage_edges(spark, sf):
    return graphs(spark, sf)[1]


@register("get_trace", f"with {RUNS_SQL} select trace_id, node_id, label from nodes where trace_id = '7'")
def get_trace(spark, sf):
    nodes, _ = graphs(spark, sf)
    return L.get_trace(nodes, "7").select("trace_id", "node_id", "label")


@register("lineage_edge_labels", f"""
with {RUNS_SQL}
select e.trace_id, e.from_node, e.to_node, e.operation, coalesce(a.label, '?') as from_label,
       coalesce(b.label, '?') as to_label
from edges e left join nodes a on a.trace_id = e.trace_id and a.node_id = e.from_node
left join nodes b on b.trace_id = e.trace_id and b.node_id = e.to_node""")
def lineage_edge_labels(spark, sf):
    nodes, edges = graphs(spark, sf)
    return L.edge_labels(nodes, edges)


@register("trace_sizes", f"with {RUNS_SQL} select trace_id, count(*) as node_count from nodes group by 1")
def trace_sizes(spark, sf):
    return L.trace_sizes(graphs(spark, sf)[0])


@register("trace_times", """
select cast(user_id as varchar) as trace_id, min(ts) as created_at, count(distinct event_type) + 3 as node_count
from events group by user_id""")
def trace_times(spark, sf):
    """Traces with their time; runs are users, products their event types."""
    timed = table(spark, sf, "events").groupBy("user_id").agg(
        F.collect_set("event_type").alias("products"), F.min("ts").alias("created_at"),
        F.count(F.lit(1)).alias("row_count")).select(
        F.col("user_id").cast("string").alias("trace_id"), "products", F.lit("").alias("query_text"), "row_count",
        F.lit(None).cast("string").alias("error"), "created_at")
    return L.trace_sizes(L.lineage_graphs(timed, catalog(spark))[0])


@register("platform_metrics", f"""
with {RUNS_SQL}
select 'Products Loaded' as metric, {len(TABLES)}::bigint as value
union all select 'KG Nodes', (select count(*) + count(distinct o_orderpriority) + count(distinct o_orderstatus) from orders)
union all select 'KG Relationships', (select count(*) filter (where o_orderpriority <> '') + count(*) filter (where o_orderstatus <> '') from orders)
union all select 'Lineage Traces', (select count(distinct trace_id) from nodes)""")
def platform_metrics(spark, sf):
    g = G.build_graph(table(spark, sf, "orders"), G.ORDERS_GRAPH)
    nodes, _ = graphs(spark, sf)
    return L.platform_metrics(catalog(spark), g.nodes, g.edges, nodes)


def steps(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("trace_id"),
                    F.col("turn").alias("step"), F.col("role").alias("agent"),
                    F.when(F.col("role") == "system", "error").otherwise("success").alias("status"),
                    F.length("text").cast("double").alias("duration_ms"),
                    F.col("text").alias("message"))


@register("run_steps", """
select role as agent, count(*) as steps, count(*) filter (where role = 'system') as errors,
       round(avg(cast(length(text) as double)), 2) as avg_duration_ms
from conversations group by role""")
def run_steps(spark, sf):
    return L.run_step_stats(steps(spark, sf))


@register("run_step_table", """
select cast(conv_id as varchar) as trace_id, turn as step, role as agent,
       case when role = 'system' then 'error' else 'success' end as status,
       cast(length(text) as double) as duration_ms, text as message
from conversations""")
def run_step_table(spark, sf):
    return L.run_steps(steps(spark, sf))


@register("run_status", f"""
with {RUNS_SQL}
select trace_id, case when error is not null or coalesce(length(trim(query_text)), 0) = 0
                        or coalesce(row_count, 0) = 0 then 'failed' else 'completed' end as status
from r""")
def run_status(spark, sf):
    return L.run_status(runs(spark, sf))
