"""The stored graph answers like the graph of one product, without a shuffle."""
import pytest
from pyspark.sql import functions as F

from meshwork.operators import fingerprint as FP
from meshwork.operators import graph as G
from meshwork.operators import graph_queries as Q
from meshwork.operators.graph_store import GraphStore

SPEC = G.GraphSpec("Thing", "id", (G.Dimension("kind", "Kind", "IS_A"), G.Dimension("size", "Size", "HAS_SIZE"),
                                   G.Dimension("absent", "Absent", "LACKS")))
SCHEMA = "id long, kind string, size int, price double"
ROWS = [(1, "a", 3, 1.5), (1, "a", 3, 1.5), (1, "b", 3, None), (2, "a", 0, 2.0), (3, "", 4, 1.0), (None, "a", 5, 9.0),
        (4, None, 6, 1e-7), (5, "it's", 7, -0.0)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def store(spark, data, tmp_path_factory):
    s = GraphStore(spark, "things_of_a_test", str(tmp_path_factory.mktemp("g")), buckets=4)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    s.write({"things": (data, SPEC), "orders": (orders, G.ORDERS_GRAPH)})
    yield s
    for part in ("nodes", "edges"):
        spark.sql(f"drop table {s.name}_{part}")


def same(a, b):
    assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.select(a.columns).collect())))


def test_it_equals_the_graph_of_one_product(data, store):
    g = G.build_graph(data, SPEC)
    same(store.edges("things").drop("row_id", "product"), g.edges.drop("src_label"))
    same(store.nodes("things").select("node_id", "label", "key", F.to_json("props")),
         g.nodes.where("label = 'Thing'").select("node_id", "label", "key", F.to_json("props")))
    same(store.dimensions().where("product = 'things'").drop("product", "props"), G.dimension_nodes(data, SPEC).drop("props"))
    same(store.match_star("things", {"IS_A": "kind", "HAS_SIZE": "size"}), Q.match_star(g, {"IS_A": "kind", "HAS_SIZE": "size"}))
    same(store.match_star("things", {"LACKS": "x"}), store.match_star("things", {"LACKS": "x"}).limit(0))
    same(store.rate_by_dimension("things", "IS_A", "HAS_SIZE", "3"), Q.rate_by_dimension(g, "IS_A", "HAS_SIZE", "3"))
    same(store.cross_count("things", "IS_A", "HAS_SIZE"), Q.status_cross_count(g, "IS_A", "HAS_SIZE"))
    same(store.aggregate_measures("things", "price", "IS_A"), Q.aggregate_measures(g, "price", "IS_A"))
    got = store.filtered_count("things", "IS_A", "a", lambda p: p["price"].cast("double") > 1.4).first().matched
    assert got == Q.filtered_count(g, "IS_A", "a", "price > 1.4").first().matched == 3


def test_row_ids_are_unique_over_products(store):
    assert store.nodes().count() == store.nodes().select("row_id").distinct().count() == len(ROWS) + store.nodes("orders").count()


def test_patterns_join_without_a_shuffle(spark, store):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = store.match_star("orders", {"HAS_PRIORITY": "p", "HAS_STATUS": "s"}, ("o_totalprice",))
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 2 and "Exchange" not in plan and "PartitionFilters: [isnotnull(product" in plan
        assert len(rows) == store.nodes("orders").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_graph_is_stale_when_the_content_changed(spark, data, store):
    def current(df, product="things"):
        return store.stale({product: df}).first().is_current
    assert current(data) and current(data.orderBy("price").coalesce(1))
    assert not current(data.unionByName(data.limit(1))) and not current(data.where("id is not null"))
    assert not current(data.withColumn("size", F.when(F.col("id") == 2, 1).otherwise(F.col("size"))))
    assert not current(data.withColumn("size", F.col("size").cast("long"))) and not current(data, "unknown")
    swapped = data.withColumns({"kind": F.when(F.col("id") == 4, "6").otherwise(F.col("kind")),
                                "size": F.when(F.col("id") == 4, None).otherwise(F.col("size"))})
    assert not current(swapped)
    # two values that trade places between rows
    traded = data.withColumn("price", F.when(F.col("id") == 2, 1.0).when(F.col("id") == 3, 2.0).otherwise(F.col("price")))
    assert not current(traded)


def test_a_fingerprint_is_one_scan_and_one_exchange(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = FP.content_fingerprint("o", orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1
    assert FP.content_fingerprint("o", orders.limit(0)).first().row_count == 0
