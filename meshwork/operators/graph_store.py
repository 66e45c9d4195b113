"""A stored property graph of several products.

Entities of all products share two tables, bucketed by one row number:

* ``<name>_nodes``  row_id, label, node_id, key, props; by product
* ``<name>_edges``  row_id, src, rel, dst, dst_label, dst_key; by product

``row_id`` is unique over all products and given once, in a written table, so
nodes and edges agree on it; it spreads evenly whatever the entity ids are,
and rows that share an id stay rows of their own. A pattern of several
relationships joins edges with edges and nodes by ``row_id``: both sides lie
in the same buckets, so no row is shuffled. Dimension nodes are a small table
beside them.

With the graph the fingerprint of every product is stored. ``stale`` compares
it with that of the data as it is now: one scan and one exchange a product.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import stored
from . import fingerprint as FP
from . import graph as G

_EDGE = "array<struct<rel:string,dst:string,dst_label:string,dst_key:string>>"


def _entities(product: str, df: DataFrame, spec: G.GraphSpec) -> DataFrame:
    """Rows of a product as nodes with their edges, in common columns."""
    ents = G.entity_table(df, spec)
    types = {f.name: f.dataType for f in df.schema.fields}
    edges = [F.when(F.col("node_id").isNotNull() & G._truthy(G._q(d.column), types[d.column]), F.struct(
        F.lit(d.rel).alias("rel"), F.concat_ws(":", F.lit(d.label), G._q(d.column).cast("string")).alias("dst"),
        F.lit(d.label).alias("dst_label"), G._q(d.column).cast("string").alias("dst_key")))
        for d in G._present_dims(df, spec)]
    edges = F.filter(F.array(*edges), lambda e: e.isNotNull()) if edges else F.array().cast(_EDGE)
    values = [x for c in df.columns for x in (F.lit(c), G._q(c).cast("string"))]
    props = F.map_filter(F.create_map(*values), lambda _, v: v.isNotNull())
    return ents.select(F.lit(product).alias("product"), F.lit(spec.entity_label).alias("label"), "node_id",
                       G._q(spec.id_column).cast("string").alias("key"), props.alias("props"),
                       edges.cast(_EDGE).alias("edges"))


class GraphStore:
    """The graph ``name`` under ``path``. ``buckets``: about the number of
    files per product that a scan of all cores wants."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 32):
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets

    def write(self, products: dict[str, tuple[DataFrame, G.GraphSpec]]) -> None:
        """Load the graph of all products, in place of what was there."""
        rows = dims = marks = None
        for product, (df, spec) in products.items():
            one = _entities(product, df, spec)
            dim = G.dimension_nodes(df, spec).select(F.lit(product).alias("product"), "*")
            mark = FP.content_fingerprint(product, df)
            rows = one if rows is None else rows.unionByName(one)
            dims = dim if dims is None else dims.unionByName(dim)
            marks = mark if marks is None else marks.unionByName(mark)
        rows = stored(rows.withColumn("row_id", F.monotonically_increasing_id()))
        self._save("nodes", rows.select("row_id", "label", "node_id", "key", "props", "product"))
        self._save("edges", rows.select("row_id", F.col("node_id").alias("src"), F.inline("edges"), "product"))
        dims.write.mode("overwrite").parquet(f"{self.path}/dimensions")
        # last: a graph with fingerprints is whole
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fingerprints")

    def _save(self, part: str, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "row_id").write.mode("overwrite").partitionBy("product")
         .bucketBy(self.buckets, "row_id").sortBy("row_id")
         .option("path", f"{self.path}/{part}-{uuid.uuid4().hex}").saveAsTable(f"{self.name}_{part}"))

    # -- what is stored --------------------------------------------------------

    def nodes(self, product: str | None = None) -> DataFrame:
        return self._part("nodes", product)

    def edges(self, product: str | None = None) -> DataFrame:
        return self._part("edges", product)

    def dimensions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/dimensions")

    def fingerprints(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fingerprints")

    def _part(self, part, product):
        rows = self.spark.table(f"{self.name}_{part}")
        return rows if product is None else rows.where(F.col("product") == product)

    def stale(self, products: dict[str, DataFrame]) -> DataFrame:
        """(product, row_count, stored_rows, is_current): whether the stored
        graph is that of the products' present content; false too for
        products that it lacks."""
        now = None
        for product, df in products.items():
            one = FP.content_fingerprint(product, df)
            now = one if now is None else now.unionByName(one)
        was = self.fingerprints().select("product", F.col("row_count").alias("stored_rows"), F.col("fingerprint").alias("was"))
        return now.join(F.broadcast(was), "product", "left").select(
            "product", "row_count", "stored_rows", F.coalesce(F.col("fingerprint") == F.col("was"), F.lit(False)).alias("is_current"))

    # -- queries -----------------------------------------------------------------

    def _reached(self, product: str, rels: dict[str, str]) -> DataFrame:
        """(row_id, node_id, a column per relationship): rows with an edge of
        every relationship."""
        out = None
        for i, (rel, alias) in enumerate(rels.items()):
            edges = self.edges(product).where(F.col("rel") == rel)
            if out is None:
                out = edges.select("row_id", F.col("src").alias("node_id"), F.col("dst_key").alias("__0"))
            else:
                out = out.join(edges.select("row_id", F.col("dst_key").alias(f"__{i}")), "row_id")
        return out.select("row_id", "node_id", *(F.col(f"__{i}").alias(a) for i, a in enumerate(rels.values())))

    def match_star(self, product: str, rels: dict[str, str], properties: tuple[str, ...] = (),
                   condition=None) -> DataFrame:
        """Q1, Q2, Q7: entities with an edge of every relationship (``rels``:
        relationship -> column), the values reached and properties (text).
        ``condition``: of a property map, to a boolean column."""
        out = self._reached(product, rels)
        if properties or condition is not None:
            nodes = self.nodes(product)
            if condition is not None:
                nodes = nodes.where(condition(F.col("props")))
            out = out.join(nodes.select("row_id", *(F.col("props")[p].alias(p) for p in properties)), "row_id")
        return out.drop("row_id")

    def rate_by_dimension(self, product: str, dim_rel: str, status_rel: str, positive: str) -> DataFrame:
        """Q3: total, positives and rate per value of a dimension."""
        pair = self._reached(product, {dim_rel: "dimension", status_rel: "status"})
        hits = F.count_if(F.col("status") == positive)
        return pair.groupBy("dimension").agg(F.count(F.lit(1)).alias("total"), hits.alias("positives"),
                                             F.round(hits / F.count(F.lit(1)) * 100, 2).alias("rate_pct"))

    def cross_count(self, product: str, dim_rel: str, status_rel: str) -> DataFrame:
        """Q6: entities by two dimensions."""
        pair = self._reached(product, {dim_rel: "dimension", status_rel: "status"})
        return pair.groupBy("dimension", "status").agg(F.count(F.lit(1)).alias("entity_count"))

    def filtered_count(self, product: str, rel: str, value: str, condition=None) -> DataFrame:
        """Q5: entities that reach ``value`` and meet a condition."""
        return self.match_star(product, {rel: "dim"}, (), condition).where(F.col("dim") == value).agg(
            F.count(F.lit(1)).alias("matched"))

    def aggregate_measures(self, product: str, measure: str, rel: str) -> DataFrame:
        """Q4, Q9: count, average, sum, largest and least of a measure per
        value of a dimension."""
        number = F.col(measure).try_cast("double")
        rows = self.match_star(product, {rel: "dimension"}, (measure,)).select("dimension", number.alias("x"))
        return rows.groupBy("dimension").agg(
            F.count(F.lit(1)).alias("row_count"), F.avg("x").alias("avg_value"), F.sum("x").alias("sum_value"),
            F.max("x").alias("max_value"), F.min("x").alias("min_value"))

    def patterns(self) -> DataFrame:
        """F4-F7 over all products: edges per product, relationship and label."""
        return self.edges().groupBy("product", "rel", "dst_label").agg(
            F.count(F.lit(1)).alias("rel_count"), F.count_distinct("dst_key").alias("values"))

