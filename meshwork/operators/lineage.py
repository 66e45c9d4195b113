"""Lineage graphs and run logs of query runs (survey ops L1-L7).

Runs are a table ``runs(trace_id, products array<string>, query_text,
row_count, error)``, with ``created_at`` if the time of a run is known; every run gets a small lineage graph: one source node
per product used (else every catalog product, else ``data_source``), two
transform nodes and one sink, linked by read / analyze / certify edges.
Node ids are derived from the trace id, so they are stable when a task is
re-run after an executor loss.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Node labels and edge operations of a run's lineage graph.
TRANSFORM_LABEL = "Generated Cypher"
ANALYSIS_LABEL = "Analysis"
SINK_LABEL = "Certified Result"
QUERY_TEXT_CHARS = 200

NODE_SCHEMA = ("trace_id string, node_id string, node_type string, label string, "
               "metadata map<string,string>")


def lineage_graphs(runs: DataFrame, catalog_products: DataFrame | None = None):
    """L1: (nodes, edges) for every run; nodes have the ``created_at`` of
    runs that have one."""
    spark = runs.sparkSession
    if catalog_products is None:
        catalog_products = spark.createDataFrame([], "product string")
    cat = catalog_products.agg(F.array_sort(F.collect_list("product")).alias("_cat"))
    r = runs.crossJoin(F.broadcast(cat)).withColumn(
        "_srcs",
        F.when(F.size(F.coalesce("products", F.array())) > 0, F.col("products"))
        .when(F.size("_cat") > 0, F.col("_cat"))
        .otherwise(F.array(F.lit("data_source"))))
    tid = F.col("trace_id")
    t1, t2, sk = (F.concat(tid, F.lit(s)) for s in (":t1", ":t2", ":k"))
    run = [c for c in ("trace_id", "created_at") if c in runs.columns]
    src = r.select(*run, F.posexplode("_srcs").alias("pos", "label"))
    src_nodes = src.select(
        *run, F.concat(tid, F.lit(":s"), F.col("pos").cast("string")).alias("node_id"),
        F.lit("source").alias("node_type"), "label",
        F.create_map(F.lit("type"), F.lit("csv")).alias("metadata"))
    arms = F.array(
        F.struct(t1.alias("node_id"), F.lit("transform").alias("node_type"),
                 F.lit(TRANSFORM_LABEL).alias("label"),
                 F.create_map(F.lit("cypher"), F.substring(
                     F.coalesce("query_text", F.lit("")), 1, QUERY_TEXT_CHARS)).alias("metadata")),
        F.struct(t2.alias("node_id"), F.lit("transform").alias("node_type"),
                 F.lit(ANALYSIS_LABEL).alias("label"),
                 F.create_map(F.lit("agent"), F.lit("analyst_agent")).alias("metadata")),
        F.struct(sk.alias("node_id"), F.lit("sink").alias("node_type"),
                 F.lit(SINK_LABEL).alias("label"),
                 F.create_map(F.lit("rows"), F.coalesce(F.col("row_count"), F.lit(0))
                              .cast("string")).alias("metadata")))
    other = r.select(*run, F.inline(arms))
    nodes = src_nodes.unionByName(other)
    read = src_nodes.select("trace_id", F.col("node_id").alias("from_node"),
                            F.concat(tid, F.lit(":t1")).alias("to_node"),
                            F.lit("read").alias("operation"))
    rest = r.select("trace_id", F.inline(F.array(
        F.struct(t1.alias("from_node"), t2.alias("to_node"), F.lit("analyze").alias("operation")),
        F.struct(t2.alias("from_node"), sk.alias("to_node"),
                 F.lit("certify").alias("operation")))))
    return nodes, read.unionByName(rest)


def get_trace(nodes: DataFrame, trace_id: str | None = None) -> DataFrame:
    """L2: all traces, or one by id."""
    return nodes if trace_id is None else nodes.where(F.col("trace_id") == trace_id)


def edge_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L3: each edge with the labels of its ends, ``?`` when a node is
    missing."""
    a = nodes.select("trace_id", F.col("node_id").alias("from_node"),
                     F.col("label").alias("from_label"))
    b = nodes.select("trace_id", F.col("node_id").alias("to_node"),
                     F.col("label").alias("to_label"))
    return (edges.join(a, ["trace_id", "from_node"], "left")
            .join(b, ["trace_id", "to_node"], "left")
            .select("trace_id", "from_node", "to_node", "operation",
                    F.coalesce("from_label", F.lit("?")).alias("from_label"),
                    F.coalesce("to_label", F.lit("?")).alias("to_label")))


def trace_sizes(nodes: DataFrame) -> DataFrame:
    """L4: trace id, time (if nodes have it) and node count."""
    run = [c for c in ("trace_id", "created_at") if c in nodes.columns]
    return nodes.groupBy(*run).agg(F.count(F.lit(1)).alias("node_count"))


def platform_metrics(products: DataFrame, graph_nodes: DataFrame,
                     graph_edges: DataFrame, traces: DataFrame) -> DataFrame:
    """Products loaded, graph nodes, graph edges, lineage traces."""
    parts = [products.agg(F.count(F.lit(1)).alias("value")).select(
                 F.lit("Products Loaded").alias("metric"), "value"),
             graph_nodes.agg(F.count(F.lit(1)).alias("value")).select(
                 F.lit("KG Nodes").alias("metric"), "value"),
             graph_edges.agg(F.count(F.lit(1)).alias("value")).select(
                 F.lit("KG Relationships").alias("metric"), "value"),
             traces.agg(F.count_distinct("trace_id").alias("value")).select(
                 F.lit("Lineage Traces").alias("metric"), "value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_steps(steps: DataFrame) -> DataFrame:
    """The step table: agent, status, duration and message of every step
    with its number among the run's steps."""
    return steps.select("trace_id", "step", "agent", "status", "duration_ms", "message")


def run_step_stats(steps: DataFrame) -> DataFrame:
    """Per agent: steps, errors, mean duration (ms, 2 decimals)."""
    return steps.groupBy("agent").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"))


def run_status(runs: DataFrame) -> DataFrame:
    """Failed when the run has an error, no query text, or an empty
    result (a run returning no rows counts as failed); else completed."""
    no_text = F.coalesce(F.length(F.trim("query_text")), F.lit(0)) == 0
    failed = F.col("error").isNotNull() | no_text | (F.coalesce("row_count", F.lit(0)) == 0)
    return runs.select("trace_id", F.when(failed, "failed").otherwise("completed")
                       .alias("status"))
