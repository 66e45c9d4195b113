"""Semantic keys (S1-S7): the seed glossary matched against whole document
texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as M
from ..operators import profile as P  # noqa: F401
from ..operators import semantic as S
from . import seeds
from .registry import register
from .tables import table


def _s(x):
    return "'" + x.replace("'", "''") + "'"


GLOSSARY_SQL = "(values " + ", ".join(
    f"({i}, {_s(t)}, [{', '.join(_s(s) for s in syn)}], [{', '.join(_s(c) for c in cols)}], {_s(dom)})"
    for i, (t, _d, syn, cols, dom, _c) in enumerate(seeds.GLOSSARY)) + \
    ") g(term_order, term, synonyms, related_columns, domain)"

INDEX_SQL = f"""
idx as (
  select key, term, min(min(o)) over (partition by key) as key_order
  from (select lower(k) as key, term, term_order::bigint * 4294967296 + pos as o
        from (select term, term_order, unnest([term] || synonyms) as k,
                     generate_subscripts([term] || synonyms, 1) - 1 as pos
              from {GLOSSARY_SQL}))
  group by key, term)"""


def _glossary(spark):
    return seeds.glossary(spark)


# S1 and S6 work on the seed glossary alone, so they are not registered as
# queries (every registered query reads the test tables); they are covered by
# tests and used inside resolve_terms / enrich_queries.
TERM_INDEX_SQL = f"with {INDEX_SQL} select key, term, key_order from idx"


def term_index(spark, sf=None):
    return S.term_index(_glossary(spark))


RESOLVE_SQL = f"""
with {INDEX_SQL},
d as (select distinct unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as input_id,
      from documents),
d2 as (select input_id, input_id as p from d),
m as (select d.input_id, idx.term, idx.key_order, idx.key = d.p as ex
      from d2 d, idx where idx.key = d.p or contains(idx.key, d.p) or contains(d.p, idx.key)),
f as (select *, bool_or(ex) over (partition by input_id) as has_ex from m),
r as (select input_id, term, min(key_order) as key_order from f
      where (has_ex and ex) or not has_ex group by 1, 2)"""


def _documents(spark, sf):
    """The documents over all cores: the test tables are one row group each,
    which one task would read and split into phrases."""
    return table(spark, sf, "documents").select("doc_id", "text").repartition(
        spark.sparkContext.defaultParallelism, "doc_id")


def _resolved(spark, sf):
    """Resolve every distinct word of the documents (the corpus vocabulary)."""
    docs = _documents(spark, sf)
    vocab = S.vocabulary(docs).select(F.col("word").alias("input_id"), F.col("word").alias("text"))
    return S.resolve_terms(vocab, S.term_index(_glossary(spark)))


@register("resolve_terms", RESOLVE_SQL + " select input_id, term, key_order from r")
def resolve_terms(spark, sf):
    return _resolved(spark, sf)


@register("columns_for_term", RESOLVE_SQL + f"""
select distinct r.input_id, unnest(g.related_columns) as column_name
from r join {GLOSSARY_SQL} using (term)""")
def columns_for_term(spark, sf):
    return S.columns_for_term(_resolved(spark, sf), _glossary(spark))


@register("enrich_queries", f"""
with {INDEX_SQL},
w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as ws
      from documents),
p as (select doc_id, i - 1 as pos, l as len, array_to_string(ws[i:i + l - 1], ' ') as phrase
      from w, unnest(range(1, len(ws) + 1)) t(i), (values (1), (2), (3)) ll(l)
      where i + l - 1 <= len(ws)),
k as (select distinct key from idx),
px as (select p.*, p.phrase in (select key from k) as is_ex from p),
m as (select px.doc_id, px.pos, px.len, idx.term, idx.key_order from px, idx
      where case when px.is_ex then idx.key = px.phrase
                 else contains(idx.key, px.phrase) or contains(px.phrase, idx.key) end),
f as (select doc_id, term, min([pos, len, key_order]) as first from m group by 1, 2),
a as (select f.doc_id, string_agg(f.term, '|' order by f.first) as resolved_terms,
             array_to_string(list_sort(list_distinct(flatten(list(g.related_columns)))), ',') as suggested_columns
      from f join {GLOSSARY_SQL} using (term) group by f.doc_id)
select d.doc_id as query_id, coalesce(a.resolved_terms, '') as resolved_terms,
       coalesce(a.suggested_columns, '') as suggested_columns, a.doc_id is not null as enriched
from documents d left join a using (doc_id)
""")
def enrich_queries(spark, sf):
    docs = _documents(spark, sf).select(F.col("doc_id").alias("query_id"), "text")
    out = S.enrich_queries(docs, S.term_index(_glossary(spark)), _glossary(spark))
    return out.select("query_id", F.array_join("resolved_terms", "|").alias("resolved_terms"),
                      F.array_join("suggested_columns", ",").alias("suggested_columns"),
                      "enriched")


SEMANTIC_SUMMARY_SQL = (f"""
select (select count(distinct term) from {GLOSSARY_SQL}) as glossary_terms,
       (select string_agg(distinct domain, ',' order by domain) from {GLOSSARY_SQL}) as domains,
       1::bigint as annotated_products, {len(seeds.ANNOTATIONS)}::bigint as total_annotations
""")


def semantic_summary(spark, sf=None):
    out = S.semantic_summary(_glossary(spark), seeds.annotations(spark))
    return out.withColumn("domains", F.array_join("domains", ","))


# Extra annotations for the orders product (used by the catalog keys).
ORDERS_ANNOTATIONS = (
    ("o_orderkey", "Order ID", "Unique identifier of an order", "identifier", "restricted"),
    ("o_totalprice", "Order Total", "Total price of the order", "measure", "public"),
    ("o_orderstatus", "Order Status", "Status of the order: F, O or P", "dimension", "public"),
)


def orders_annotations(spark):
    rows = [("orders", c, b, d, st, "general", se, "", "")
            for c, b, d, st, se in ORDERS_ANNOTATIONS]
    return seeds.annotations(spark).unionByName(
        spark.createDataFrame(rows, seeds.ANNOTATION_SCHEMA))


@register("annotate_columns", """
with a(column_name, business_name, description, semantic_type, sensitivity) as (values """ +
          ", ".join(f"({_s(c)}, {_s(b)}, {_s(d)}, {_s(st)}, {_s(se)})" for c, b, d, st, se in ORDERS_ANNOTATIONS) + """),
c as (select 'o_orderkey' as column_name, count(distinct o_orderkey) as nunique,
             count(*) filter (where o_orderkey is null) as null_count from orders
      union all select 'o_custkey', count(distinct o_custkey), count(*) filter (where o_custkey is null) from orders
      union all select 'o_orderstatus', count(distinct o_orderstatus), count(*) filter (where o_orderstatus is null) from orders
      union all select 'o_totalprice', count(distinct o_totalprice), count(*) filter (where o_totalprice is null) from orders
      union all select 'o_orderdate', count(distinct o_orderdate), count(*) filter (where o_orderdate is null) from orders
      union all select 'o_orderpriority', count(distinct o_orderpriority), count(*) filter (where o_orderpriority is null) from orders)
select 'orders' as product, c.column_name, c.nunique, c.null_count,
       coalesce(a.business_name, '') as business_name,
       coalesce(a.description, '') as description, coalesce(a.sensitivity, 'public') as sensitivity,
       coalesce(a.semantic_type, '') as semantic_type
from c left join a using (column_name)
""")
def annotate_columns(spark, sf):
    """S5 on catalog columns computed from the orders data."""
    cols = M.catalog_columns("orders", table(spark, sf, "orders")).select(
        "product", "column_name", "nunique", "null_count")
    return S.annotate_columns(cols, orders_annotations(spark))
