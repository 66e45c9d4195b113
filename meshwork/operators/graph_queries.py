"""The query shapes the reference runs on its graph (survey ops Q1-Q10).

An edge belongs to one entity row, and its dimension value is a column of
that row. A 1-hop pattern ``(entity)-[:REL]->(dimension)`` is therefore a
projection of the entity rows that have the edge, and two patterns from the
same entity are one projection with both values. No query joins edges back
to entities: one scan, and for grouped results one exchange after partial
aggregation. Rows with equal entity ids stay single rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph, edge_value


def _hops(g: PropertyGraph, rels: dict, condition: Column | str | None = None) -> DataFrame:
    """Entity rows that have an edge of every relationship, with the values
    reached as the columns ``rels`` names."""
    ents = g.entities if condition is None else g.entities.where(condition)
    ents = ents.where(F.col("node_id").isNotNull())
    ents = ents.select("*", *[edge_value(g, rel).alias(f"__{i}") for i, rel in enumerate(rels)])
    for i in range(len(rels)):
        ents = ents.where(F.col(f"__{i}").isNotNull())
    # a reached value named like an entity column takes its place
    taken = {a.lower() for a in rels.values()}
    rest = [F.col(f"`{c}`") for c in g.entities.columns if c.lower() not in taken]
    return ents.select(*rest, *[F.col(f"__{i}").alias(a) for i, a in enumerate(rels.values())])


def match_1hop(g: PropertyGraph, rel: str, alias: str | None = None,
               columns=None) -> DataFrame:
    """Q1: entities with the dimension value reached over ``rel`` (inner)."""
    alias = alias or g.dimension(rel).prop
    out = _hops(g, {rel: alias})
    return out if columns is None else out.select("node_id", *columns, alias)


def match_star(g: PropertyGraph, rels: dict, columns=None) -> DataFrame:
    """Q2: several relationships from the same entity; ``rels`` maps
    relationship type -> output column name."""
    return _hops(g, rels).select("node_id", *rels.values(), *(columns or []))


def rate_by_dimension(g: PropertyGraph, dim_rel: str, status_rel: str,
                      positive: str, dim_alias: str = "dimension",
                      total_alias: str = "total",
                      positive_alias: str = "positives",
                      rate_alias: str = "rate_pct") -> DataFrame:
    """Q3: per dimension value the total, the count whose status equals
    ``positive`` and ``round(100 * part / total, 2)``."""
    pair = _hops(g, {dim_rel: dim_alias, status_rel: "_status"})
    pos = F.sum(F.when(F.col("_status") == positive, 1).otherwise(0))
    return (pair.groupBy(dim_alias)
            .agg(F.count(F.lit(1)).alias(total_alias), pos.alias(positive_alias))
            .withColumn(rate_alias, F.round(
                F.col(positive_alias) / F.col(total_alias) * 100, 2)))


def avg_by_dimension(g: PropertyGraph, rel: str, measure: str,
                     dim_alias: str = "dimension",
                     avg_alias: str = "avg_value") -> DataFrame:
    """Q4: ``round(avg(measure), 2)`` per dimension value."""
    return (match_1hop(g, rel, dim_alias, columns=[measure])
            .groupBy(dim_alias)
            .agg(F.round(F.avg(F.col(measure)), 2).alias(avg_alias)))


def filtered_count(g: PropertyGraph, rel: str, value: str,
                   entity_filter: Column | str | None = None,
                   alias: str = "matched") -> DataFrame:
    """Q5: count entities with an edge to ``value`` that also pass a filter
    on their own properties."""
    return (_hops(g, {rel: "_dim"}, entity_filter).where(F.col("_dim") == value)
            .agg(F.count(F.lit(1)).alias(alias)))


def status_cross_count(g: PropertyGraph, dim_rel: str, status_rel: str,
                       dim_alias: str = "dimension",
                       status_alias: str = "status",
                       count_alias: str = "entity_count") -> DataFrame:
    """Q6: count by dimension value and status value."""
    return (_hops(g, {dim_rel: dim_alias, status_rel: status_alias})
            .groupBy(dim_alias, status_alias)
            .agg(F.count(F.lit(1)).alias(count_alias)))


def filter_rows(g: PropertyGraph, condition: Column | str,
                columns=None) -> DataFrame:
    """Q7: comparison filters on scalar entity properties (pushed to the scan
    when the entity table is a Parquet read)."""
    out = g.entities.where(condition)
    return out.select(*columns) if columns else out


def list_entities(g: PropertyGraph, n: int = 10, order_by=None) -> DataFrame:
    """Q8: a capped, deterministic listing (top-n by the key; the cap is the
    feature here, Spark plans it as a bounded TakeOrderedAndProject)."""
    key = order_by or g.spec.id_column
    return g.entities.drop("node_id").orderBy(key).limit(n)


def aggregate_measures(g: PropertyGraph, measure: str, by_rel: str | None = None,
                       dim_alias: str = "dimension") -> DataFrame:
    """Q9: count, avg, sum, max, min; grouped by a dimension when given."""
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.avg(measure).alias("avg_value"),
            F.sum(measure).alias("sum_value"),
            F.max(measure).alias("max_value"),
            F.min(measure).alias("min_value")]
    if by_rel is None:
        return g.entities.agg(*aggs)
    return match_1hop(g, by_rel, dim_alias, [measure]).groupBy(dim_alias).agg(*aggs)


def business_questions(g: PropertyGraph) -> dict:
    """Q10: the reference's five demo questions on a telco-shaped graph."""
    return {
        "churn_rate_by_contract": rate_by_dimension(
            g, "HAS_CONTRACT", "HAS_CHURN_STATUS", "Yes", "contract_type",
            "total_customers", "churned", "churn_rate_pct"),
        "churned_seniors_on_fibre": match_star(
            g, {"HAS_CHURN_STATUS": "churn", "USES_INTERNET": "internet"},
            ["SeniorCitizen"])
        .where((F.col("SeniorCitizen") == 1) & (F.col("churn") == "Yes")
               & (F.col("internet") == "Fiber optic"))
        .agg(F.count(F.lit(1)).alias("senior_churned")),
        "avg_charge_by_payment": avg_by_dimension(
            g, "PAYS_BY", "MonthlyCharges", "payment_method", "avg_charges"),
        "customers_with_tech_support": filter_rows(
            g, F.col("TechSupport") == "Yes")
        .agg(F.count(F.lit(1)).alias("with_tech_support")),
        "feedback_of_churned": match_1hop(
            g, "HAS_CHURN_STATUS", "churn", ["customerID", "CustomerFeedback"])
        .where(F.col("churn") == "Yes")
        .select("customerID", "CustomerFeedback"),
    }
