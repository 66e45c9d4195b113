"""Column expressions for text rules: numeric-looking values, query checks,
reply parsing and error classes (survey ops D6, E4, L8-L10).

All are plain Spark expressions, evaluated inside whole-stage code
generation; none is a Python UDF.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of the reference's read-only query check.
DANGEROUS_SQL = ("DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "GRANT")
# The reference's second list also names DETACH DELETE and DELETE, which can
# never fire because DELETE is in the first list.
DANGEROUS_CYPHER = ("SET", "REMOVE", "CREATE", "MERGE")

# The reference's error classes (lower-cased substrings).
RATE_LIMIT_MARKS = ("429", "rate_limit", "rate limit")
DAILY_LIMIT_MARKS = ("per day", "tpd")
MODEL_UNAVAILABLE_MARKS = ("decommission", "not found", "does not exist",
                           "model_not_active", "invalid model")

# The reference's stop markers after a MATCH / SELECT query.
MATCH_STOPS = ("\n\n", "Note:", "This query", "Explanation", "This Cypher")
SELECT_STOPS = ("\n\n", "Note:", "This query", "Explanation")

# Python str.isspace() characters, as a Java regex class.
WS = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def looks_numeric(c: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')`` gives a number for this text.

    Spark's cast also accepts a trailing ``d``/``f`` (Java float syntax) and
    yields NaN for ``'NaN'``; pandas gives missing for both, so those are
    excluded (``inf`` and ``-inf`` stay numbers in both).
    """
    x = c.try_cast("double")
    java_suffix = c.rlike(r"[dDfF]\s*$") & ~c.rlike(r"(?i)^\s*[+-]?inf(inity)?\s*$")
    return x.isNotNull() & ~F.isnan(x) & ~java_suffix


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def mutation_keywords(text: Column) -> Column:
    """The keywords that make a query text fail the read-only check.

    Upper-cased text; any keyword of the first list anywhere fails it.
    Otherwise SET, REMOVE, CREATE (excused when ``CREATE INDEX`` occurs) and
    MERGE fail it when no RETURN occurs before their first occurrence.
    Substring matching is kept: ``OFFSET`` contains ``SET``.
    """
    u = F.upper(text)
    sql_hits = F.filter(F.array(*[F.lit(k) for k in DANGEROUS_SQL]),
                        lambda k: F.instr(u, k) > 0)

    def cypher_hit(k):
        first = F.instr(u, k)
        before = F.substring(u, F.lit(1), first - 1)
        excused = (k == F.lit("CREATE")) & (F.instr(u, "CREATE INDEX") > 0)
        return (first > 0) & ~excused & (F.instr(before, "RETURN") == 0)

    cypher_hits = F.filter(F.array(*[F.lit(k) for k in DANGEROUS_CYPHER]),
                           cypher_hit)
    return F.when(F.size(sql_hits) > 0, sql_hits).otherwise(cypher_hits)


def py_list_repr(arr: Column) -> Column:
    """``['A', 'B']`` as Python prints a list of strings."""
    quoted = F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


# The patterns by which replies are read.
JSON_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
JSON_BRACES = r"(?s)(\{.*\})"
QUERY_FENCE = r"(?s)```(?:sql|cypher)?\s*\n?(.*?)\n?```"
MATCH_QUERY = r"(?is)(MATCH\s+.+)"
SELECT_QUERY = r"(?is)(SELECT\s+.+)"


def extract_json_candidate(text: Column) -> Column:
    """Text of the JSON object in a reply: the fenced block if any, then the
    widest ``{...}`` span inside it, else the whole (fenced) text."""
    body = F.when(text.rlike(JSON_FENCE), F.regexp_extract(text, JSON_FENCE, 1)).otherwise(text)
    return body, F.regexp_extract(body, JSON_BRACES, 1)


def with_query_text(df, text_col: str, out: str = "query"):
    """Query text of a reply: the fenced block (sql, cypher or unmarked);
    else from the first MATCH, else from the first SELECT, cut at the first
    stop marker after position 0; else the stripped text.

    Computing the candidates as intermediate columns keeps every step
    compiled; as one nested expression it exceeds the generated code size.
    """
    text = F.col(text_col)

    def found(pattern):
        return F.when(text.rlike(pattern), py_strip(F.regexp_extract(text, pattern, 1)))

    def cut(q, stops):
        pos = F.array(*[F.instr(q, s) for s in stops])
        first = F.array_min(F.filter(pos, lambda p: p > 1))
        return F.when(first.isNull(), q).otherwise(py_strip(F.substring(q, F.lit(1), first - 1)))

    staged = df.withColumns({"_fenced": found(QUERY_FENCE), "_mq": found(MATCH_QUERY), "_sq": found(SELECT_QUERY)})
    staged = staged.withColumns({"_mc": cut(F.col("_mq"), MATCH_STOPS),
                                 "_sc": cut(F.col("_sq"), SELECT_STOPS)})
    result = F.coalesce(F.col("_fenced"), F.col("_mc"), F.col("_sc"), py_strip(text))
    return staged.withColumn(out, result).drop("_fenced", "_mq", "_sq", "_mc", "_sc")


def _any_contains(s: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | s.contains(m)
    return out


def is_rate_limit(msg: Column) -> Column:
    return _any_contains(F.lower(msg), RATE_LIMIT_MARKS)


def is_daily_limit(msg: Column) -> Column:
    return is_rate_limit(msg) & _any_contains(F.lower(msg), DAILY_LIMIT_MARKS)


def is_model_unavailable(msg: Column) -> Column:
    return _any_contains(F.lower(msg), MODEL_UNAVAILABLE_MARKS)
