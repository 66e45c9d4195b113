"""Semantic layer: glossary index, term resolution, query enrichment and
column annotations (survey ops S1-S7).

Matching is the loose rule: a phrase resolves to the glossary keys equal to
it; when none is equal, to every key that contains it or is contained in it.
Tasks hold all keys (a glossary is metadata; its size is checked before it is
read) and match whole Arrow batches in one pass over each text, see
``functions.matching``. No text is shuffled: ``resolve_terms`` shuffles only
its matches and ``enrich_queries`` nothing.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StringType, StructField, StructType

from ..functions.matching import checked_keys, matcher
from ..functions.text import WS
from ..plans.session import let_workers_import


def term_index(glossary: DataFrame) -> DataFrame:
    """Lower-cased term and synonyms -> term, with the position at which
    each key was first added (``key_order``)."""
    keys = glossary.select(
        "term", "term_order",
        F.posexplode(F.concat(F.array("term"), "synonyms")).alias("pos", "k"))
    keys = keys.select(F.lower("k").alias("key"), "term",
                       (F.col("term_order").cast("long") * 2**32 + F.col("pos")).alias("o"))
    w = Window.partitionBy("key")
    return (keys.withColumn("key_order", F.min("o").over(w))
            .groupBy("key", "term").agg(F.min("key_order").alias("key_order")))


def _terms_of(rows):
    """Key -> its (term, key_order), and the keys, from a term index's rows."""
    terms: dict[str, list] = {}
    for key, term, order in rows:
        terms.setdefault(key, []).append((term, order))
    return tuple(terms), [tuple(t) for t in terms.values()]


def resolve_terms(inputs: DataFrame, index: DataFrame,
                  text_col: str = "text") -> DataFrame:
    """``inputs(input_id, text)`` -> (input_id, term, key_order). A null
    text resolves to nothing, the empty text to every key."""
    let_workers_import(inputs.sparkSession)
    keys, terms = _terms_of(checked_keys(index))

    def matches(batches):
        found = matcher(keys)
        for batch in batches:
            rows, names, orders = [], [], []
            for i, phrase in enumerate(batch.column(1).to_pylist()):
                least: dict[str, int] = {}
                for key in found.match(phrase) if phrase is not None else ():
                    for term, order in terms[key]:
                        least[term] = min(order, least.get(term, order))
                rows += [i] * len(least)
                names += least
                orders += least.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(orders, pa.int64())],
                names=["input_id", "term", "key_order"])

    rows = inputs.select("input_id", F.lower(text_col).alias("phrase"))
    order_type = dict(index.dtypes)["key_order"]
    schema = StructType([rows.schema["input_id"], StructField("term", StringType()), StructField("key_order", LongType())])
    return (rows.mapInArrow(matches, schema).groupBy("input_id", "term")
            .agg(F.min("key_order").cast(order_type).alias("key_order")))


def columns_for_term(resolved: DataFrame, glossary: DataFrame) -> DataFrame:
    """S3: distinct related columns of the resolved terms."""
    return (resolved.join(glossary.select("term", "related_columns"), "term")
            .select("input_id", F.explode("related_columns").alias("column_name"))
            .distinct())


def _words(text_col: str):
    """Lower-cased words of a text, split at white space."""
    return F.filter(F.split(F.lower(F.col(text_col)), f"{WS}+"), lambda w: w != "")


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): the distinct lower-cased words of whole texts."""
    return texts.select(F.explode(_words(text_col)).alias("word")).distinct()


def enrich_queries(texts: DataFrame, index: DataFrame, glossary: DataFrame,
                   id_col: str = "query_id", text_col: str = "text", max_len: int = 3) -> DataFrame:
    """Per text: resolved terms in first-seen order (start word, then
    phrase length, then index order), suggested columns (sorted),
    definitions and an ``enriched`` flag. A phrase is 1 to ``max_len``
    consecutive words; texts are taken whole, each row for itself (repeated
    and null ids too); a null text resolves to nothing."""
    let_workers_import(texts.sparkSession)
    entries = {r["term"]: (r["definition"], list(r["related_columns"] or []))
               for r in glossary.select("term", "definition", "related_columns").collect()}
    keys, terms = _terms_of([r for r in checked_keys(index) if r[1] in entries])
    wanted = {t for own in terms for t, _ in own}

    def enrich(batches):
        found = matcher(keys)
        complete = lambda seen: len({t for k in seen for t, _ in terms[k]}) == len(wanted)
        for batch in batches:
            resolved, columns, definitions = [], [], []
            for text in batch.column(1).to_pylist():
                first: dict[str, tuple] = {}
                for key, place in found.first_matches(text or "", max_len, complete).items():
                    for term, order in terms[key]:
                        first[term] = min((*place, order), first.get(term, (*place, order)))
                order = sorted(first, key=lambda t: (first[t], t))
                resolved.append(order)
                columns.append(sorted({c for t in order for c in entries[t][1]}))
                definitions.append([(t, entries[t][0]) for t in order] or None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(resolved, pa.list_(pa.string())), pa.array(columns, pa.list_(pa.string())),
                 pa.array(definitions, pa.map_(pa.string(), pa.string())), pa.array([bool(r) for r in resolved])],
                names=[id_col, "resolved_terms", "suggested_columns", "definitions", "enriched"])

    rows = texts.select(id_col, F.array_join(_words(text_col), " ").alias("words"))
    names = ArrayType(StringType())
    schema = StructType([rows.schema[id_col], StructField("resolved_terms", names), StructField("suggested_columns", names),
                         StructField("definitions", MapType(StringType(), StringType())), StructField("enriched", BooleanType())])
    return rows.mapInArrow(enrich, schema)


def annotate_columns(columns: DataFrame, annotations: DataFrame) -> DataFrame:
    """Business name, description, sensitivity and semantic type put on
    catalog columns (``product``, ``column_name``); defaults when absent."""
    a = annotations.select("product", "column_name", "business_name",
                           "description", "sensitivity", "semantic_type")
    j = columns.join(a, ["product", "column_name"], "left")
    return j.select(*[c for c in columns.columns],
                    F.coalesce("business_name", F.lit("")).alias("business_name"),
                    F.coalesce("description", F.lit("")).alias("description"),
                    F.coalesce("sensitivity", F.lit("public")).alias("sensitivity"),
                    F.coalesce("semantic_type", F.lit("")).alias("semantic_type"))


def semantic_summary(glossary: DataFrame, annotations: DataFrame) -> DataFrame:
    """Numbers of terms, annotated products and annotations; domains."""
    g = glossary.agg(F.count_distinct("term").alias("glossary_terms"),
                     F.array_sort(F.collect_set("domain")).alias("domains"))
    a = annotations.agg(F.count_distinct("product").alias("annotated_products"),
                        F.count(F.lit(1)).alias("total_annotations"))
    return g.crossJoin(a)
