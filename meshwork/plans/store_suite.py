"""Keys of the stored graph of several products (Q1-Q9 on stored tables, A5
by content)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fingerprint as FP
from ..operators import graph as G
from ..operators.graph_store import GraphStore
from ..operators.profile_state import ProfileState
from .registry import register
from .session import checkpoint_dir
from .tables import table
from .views import VIEWS, with_views

CUSTOMER_GRAPH = G.GraphSpec("Customer", "c_custkey", (
    G.Dimension("c_mktsegment", "Segment", "IN_SEGMENT"), G.Dimension("c_nationkey", "Nation", "LIVES_IN", "nation")))
EVENT_GRAPH = G.GraphSpec("User", "user_id", (G.Dimension("event_type", "Event", "DID"),))


def _store(spark, sf):
    """Orders (with repeated rows), customers and events (users repeat)."""
    name = f"graph_{uuid.uuid4().hex}"
    store = GraphStore(spark, name, f"{checkpoint_dir(spark).rstrip('/')}/meshwork-{name}",
                       buckets=spark.sparkContext.defaultParallelism)
    store.write({"orders": (VIEWS["orders_dups"](spark, sf), G.ORDERS_GRAPH),
                 "customer": (table(spark, sf, "customer"), CUSTOMER_GRAPH),
                 "events": (table(spark, sf, "events"), EVENT_GRAPH)})
    return store


@register("stored_star", with_views("""
select 'Order:' || o_orderkey as node_id, o_orderpriority as priority, o_orderstatus as status,
       o_totalprice, cast(o_custkey as varchar) as o_custkey
from orders_dups where o_totalprice > 300000
""", "orders_dups"))
def stored_star(spark, sf):
    """Dear orders with both dimensions and a property, repeated ids kept."""
    rows = _store(spark, sf).match_star(
        "orders", {"HAS_PRIORITY": "priority", "HAS_STATUS": "status"}, ("o_totalprice", "o_custkey"),
        lambda props: props["o_totalprice"].cast("double") > 300000)
    return rows.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@register("stored_rates", with_views("""
select 'orders' as product, o_orderpriority as dimension, count(*) as total, count(*) filter (where o_orderstatus = 'F') as positives,
       round(count(*) filter (where o_orderstatus = 'F') / count(*) * 100, 2) as rate_pct from orders_dups group by 2
union all
select 'customer', c_mktsegment, count(*), count(*) filter (where c_nationkey = 3),
       round(count(*) filter (where c_nationkey = 3) / count(*) * 100, 2) from customer where c_nationkey <> 0 group by 2
""", "orders_dups"))
def stored_rates(spark, sf):
    """One question asked of two products of the same graph (nation 0 is no
    value, as in the graph of one product)."""
    store = _store(spark, sf)
    asked = {"orders": ("HAS_PRIORITY", "HAS_STATUS", "F"), "customer": ("IN_SEGMENT", "LIVES_IN", "3")}
    out = [store.rate_by_dimension(p, *q).select(F.lit(p).alias("product"), "*") for p, q in asked.items()]
    return out[0].unionByName(out[1])


@register("stored_measures", """
select event_type as dimension, count(*) as row_count, round(avg(value), 6) as avg_value, round(sum(value), 2) as sum_value,
       max(value) as max_value, min(value) as min_value
from events where user_id is not null and event_type <> '' group by 1""")
def stored_measures(spark, sf):
    return _store(spark, sf).aggregate_measures("events", "value", "DID").withColumns({
        "avg_value": F.round("avg_value", 6), "sum_value": F.round("sum_value", 2)})


@register("stored_patterns", with_views("""
select 'orders' as product, 'HAS_PRIORITY' as rel, 'Priority' as dst_label, count(*) as rel_count, count(distinct o_orderpriority) as "values" from orders_dups
union all select 'orders', 'HAS_STATUS', 'Status', count(*), count(distinct o_orderstatus) from orders_dups
union all select 'customer', 'IN_SEGMENT', 'Segment', count(*), count(distinct c_mktsegment) from customer
union all select 'customer', 'LIVES_IN', 'Nation', count(*), count(distinct c_nationkey) from customer where c_nationkey <> 0
union all select 'events', 'DID', 'Event', count(*), count(distinct event_type) from events
""", "orders_dups"))
def stored_patterns(spark, sf):
    return _store(spark, sf).patterns()


#: Name -> the data that the graph of ``orders`` is held against.
_SNAPSHOTS = ("orders", "orders_dups", "orders_badvals", "orders_nulls")


@register("graph_stale", with_views("\nunion all ".join(f"""
select '{v}' as product, (select count(*) from {v}) as row_count, (select count(*) from orders) as stored_rows,
       (select count(*) from (select * from {v} except all select * from orders)) = 0
       and (select count(*) from (select * from orders except all select * from {v})) = 0 as is_current""" for v in _SNAPSHOTS),
    "orders_dups", "orders_badvals", "orders_nulls"))
def graph_stale(spark, sf):
    """The fingerprint stored with the orders' graph against the same rows in
    another order, doubled rows, changed values and lost values."""
    orders = table(spark, sf, "orders")
    was = FP.content_fingerprint("orders", orders).select(F.col("row_count").alias("stored_rows"), F.col("fingerprint").alias("was"))
    out = None
    for name in _SNAPSHOTS:
        now = orders.repartition(7, "o_custkey") if name == "orders" else VIEWS[name](spark, sf)
        one = FP.content_fingerprint(name, now)
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(was)).select(
        "product", "row_count", "stored_rows", (F.col("fingerprint") == F.col("was")).alias("is_current"))


# -- profile of a product that grows (B2-B5, D1-D3) --------------------------------------

def _grown(spark, sf):
    """Orders with repeated rows in two batches, one of them committed twice;
    then the low-priority ones are replaced by rows with nulls."""
    dups, nulls = VIEWS["orders_dups"](spark, sf), VIEWS["orders_nulls"](spark, sf)
    name = f"profile-{uuid.uuid4().hex}"
    state = ProfileState(spark, f"{checkpoint_dir(spark).rstrip('/')}/meshwork-{name}", "orders", dups.schema)
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    state.commit("urgent", dups.where(urgent))
    for _ in range(2):
        state.commit("rest", dups.where(~urgent))
    state.commit("low again", added=nulls.where(low), removed=dups.where(low))
    return state


_GROWN_SQL = ("(select * from orders_dups where o_orderpriority <> '5-LOW' "
              "union all by name select * from orders_nulls where o_orderpriority = '5-LOW')")
_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


def _profile_sql(column: str) -> str:
    number = column in _ORDER_NUMBERS
    of = lambda sql, name: f"{sql if number else 'null::double'} as {name}"
    return (f"select '{column}' as column_name, count(*) as row_count, count(*) - count({column}) as null_count, "
            f"count(distinct {column}) as distinct_count, {of(f'min({column})::double', 'min_value')}, "
            f"{of(f'max({column})::double', 'max_value')}, {of(f'round(avg({column}), 4)', 'mean_value')}, "
            f"{of(f'round(stddev_samp({column}), 4)', 'std_value')} from {_GROWN_SQL}")


@register("profile_appended", with_views(" union all ".join(map(_profile_sql, _ORDER_COLUMNS)), "orders_dups", "orders_nulls"))
def profile_appended(spark, sf):
    state = _grown(spark, sf)
    facts = state.profile().select("column_name", "row_count", "null_count", "distinct_count")
    return facts.join(state.column_stats().drop("row_count", "null_count", "ordinal"), "column_name").join(
        state.deviations(), "column_name", "left").withColumns({
            "mean_value": F.round("mean_value", 4), "std_value": F.round("std_value", 4)})


@register("duplicates_appended", with_views(f"""
select 'orders' as product, sum(n)::bigint as row_count, sum(n - 1)::bigint as duplicate_rows,
       round(sum(n - 1) / sum(n) * 100, 2) as duplicate_pct
from (select count(*) as n from {_GROWN_SQL} group by {', '.join(_ORDER_COLUMNS)})
""", "orders_dups", "orders_nulls"))
def duplicates_appended(spark, sf):
    return _grown(spark, sf).duplicate_rows().drop("_pct", "issue")
