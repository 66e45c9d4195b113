"""One registered query per corpus operator, over its whole table."""
from __future__ import annotations

from functools import wraps

from .common import workers_import

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            workers_import(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run
    return deco


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeats
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


@register("op4_simhash")
def op4_simhash(spark, sf_dir):
    from .simhash import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@register("op5_language_id")
def op5_language_id(spark, sf_dir):
    from .language_id import identify
    return identify(_table(spark, sf_dir, "documents"))


@register("op7_quality")
def op7_quality(spark, sf_dir):
    from .quality import classify
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_WORDS_SQL = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS ws FROM benchmark),
k AS (SELECT item, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i, ws
      FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM k),
p AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS j, ws
      FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT DISTINCT p.r, p.j, p.n, win.item
        FROM (SELECT r, n, j, array_to_string(ws[j:j + n - 1], ' ') AS g FROM p) p JOIN win USING (n, g)),
nh AS (SELECT r, count(*) AS c FROM (SELECT DISTINCT r, unnest(range(j, j + n)) AS pos FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(c, 0) > 0 AND 20 * coalesce(c, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN it USING (r)
"""


@register("op8_decontaminate", OP8_SQL)
def op8_decontaminate(spark, sf_dir):
    from .decontaminate import find_contamination
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, _table(spark, sf_dir, "benchmark"), located=False).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op10_packing")
def op10_packing(spark, sf_dir):
    from .packing import pack
    return pack(_table(spark, sf_dir, "documents"), with_ids=False)


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    from .toxicity import classify
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), good AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.93 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least.component_id,
       v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@register("op1_embedding_dedup", OP1_SQL)
def op1_embedding_dedup(spark, sf_dir):
    from .embedding_dedup import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


@register("op9_pii")
def op9_pii(spark, sf_dir):
    from .pii import find_personal_data
    return find_personal_data(_table(spark, sf_dir, "documents"))


@register("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    """All documents inserted; those with a certain licence line revised
    (the line goes); those of low quality deleted; the revision tried twice."""
    import uuid

    from pyspark.sql import functions as F

    from .common import shared_folder
    from .token_counts import TokenRollup
    docs = _table(spark, sf_dir, "documents")
    line = "Licensed under the Apache License, Version 2.0."
    revised = docs.where(F.col("text").contains(line)).withColumn("text", F.replace("text", F.lit(line), F.lit("")))
    bad = _table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", inserts=docs)
    rollup.commit("licence", revisions=revised)
    rollup.commit("quality", deletes=bad)
    rollup.commit("licence", revisions=revised)
    return rollup.totals()


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), g AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@register("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark, sf_dir):
    from pyspark.sql import functions as F

    from .fill_in_middle import restore, transform
    made = transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("fim_text", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("fim_text"), F.col("form")), 256).alias("restored_sha256"))


@register("op12_whitening")
def op12_whitening(spark, sf_dir):
    from pyspark.sql import functions as F

    from .whitening import whiten
    return whiten(_table(spark, sf_dir, "embeddings"), components=16).withColumn("deviation", F.col("deviation").cast("long"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]

_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = f"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (
  VALUES {', '.join(str(r) for r in URL_RULES)}
), u AS (
  SELECT row_number() OVER () AS r, page_id, html,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), p AS (
  SELECT r, page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_CASE}), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), fits AS (
  SELECT r, arg_min({{'rule': rhost || rpath, 'verdict': verdict}},
                    (-length(rhost || rpath), -length(rhost), verdict <> 'block')) AS best
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY r
), seeds AS (
  SELECT host, avg((best.verdict IS NOT DISTINCT FROM 'allow')::INT) AS allowed,
         avg((best.verdict IS NOT DISTINCT FROM 'block')::INT) AS blocked
  FROM p LEFT JOIN fits USING (r) WHERE host <> '' GROUP BY host
), links AS (
  SELECT src, dst, count(*) AS pages
  FROM (SELECT DISTINCT r, host AS src, translate(unnest(regexp_extract_all(html,
          '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''<>\\s\\\\]+)', 1)), {_CASE}) AS dst FROM p)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), hosts AS (
  SELECT host, max(allowed) AS allowed, max(blocked) AS blocked
  FROM (FROM seeds UNION ALL SELECT src, 0, 0 FROM links UNION ALL SELECT dst, 0, 0 FROM links) GROUP BY host
), base AS (
  SELECT 'trust' AS kind, host, 0.15::DOUBLE * allowed AS a0, 0.85::DOUBLE AS a1, 0.15::DOUBLE AS b0, 0.85::DOUBLE AS b1
  FROM hosts
  UNION ALL SELECT 'distrust', host, blocked, 0.85::DOUBLE * (1 - blocked), 1, 0 FROM hosts
), w AS (
  SELECT src, dst, pages / sum(pages) OVER (PARTITION BY src) AS w FROM links
), e AS (
  SELECT 'trust' AS kind, src, dst, w FROM w UNION ALL SELECT 'distrust', dst, src, w FROM w
  UNION ALL SELECT kind, host, host, 0 FROM base
), ranks AS (
  SELECT 0 AS k, kind, host, a0 AS a, b0 AS b FROM base
  UNION ALL
  SELECT k + 1, e.kind, e.dst, any_value(a0) + any_value(a1) * sum(e.w * a), any_value(b0) + any_value(b1) * sum(e.w * b)
  FROM ranks JOIN e ON e.kind = ranks.kind AND e.src = ranks.host
       JOIN base ON base.kind = e.kind AND base.host = e.dst
  WHERE k < 100 GROUP BY k, e.kind, e.dst
), trust AS (
  SELECT host, max(a / b) FILTER (kind = 'trust') AS t, max(a / b) FILTER (kind = 'distrust') AS d
  FROM ranks WHERE k = 100 GROUP BY host
)
SELECT page_id, p.host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN d >= 0.5 AND d > t THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (r) LEFT JOIN trust ON trust.host = p.host
"""


@register("op11_url_filter", OP11_SQL)
def op11_url_filter(spark, sf_dir):
    from .url_filter import judge, rule_table
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")
