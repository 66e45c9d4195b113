"""Empty inputs and empty glossary keys by the reference's rule: equal keys,
else every key that contains the phrase or is contained in it."""
from meshwork.operators import semantic as S


def _by_rule(phrases, keys):
    return {i: {k for k in keys if k == p} or {k for k in keys if p in k or k in p} for i, p in phrases}


def test_empty_phrases_and_keys(spark):
    phrases = [(1, ""), (2, "churn"), (3, "other"), (4, "two  spaces"), (5, " "), (6, "   ")]
    for keys in (["churn rate", "churn", "plan"], ["churn", "", "plan x"], ["churn", "  ", " plan"], [""]):
        index = spark.createDataFrame([(k, k, i) for i, k in enumerate(keys)], "key string, term string, key_order int")
        out = S.resolve_terms(spark.createDataFrame(phrases, "input_id int, text string"), index).collect()
        got = {i: {r.term for r in out if r.input_id == i} for i, _ in phrases}
        assert got == _by_rule(phrases, keys), keys


def test_empty_key_enriches_every_text(spark):
    index = spark.createDataFrame([("", "any", 0), ("churn", "churn", 1)], "key string, term string, key_order int")
    glossary = spark.createDataFrame([("any", "d", ["x"]), ("churn", "e", ["y"])], "term string, definition string, related_columns array<string>")
    texts = spark.createDataFrame([(1, "hello"), (2, "churn"), (3, "")], "query_id int, text string")
    got = {r.query_id: list(r.resolved_terms) for r in S.enrich_queries(texts, index, glossary).collect()}
    assert got == {1: ["any"], 2: ["churn"], 3: []}
