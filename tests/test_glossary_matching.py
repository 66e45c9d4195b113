"""Keys in texts by the loose rule, against brute force; long words."""
import random
import time

import pytest

from meshwork.functions import matching
from meshwork.functions.matching import KeyMatcher, checked_keys
from meshwork.operators import semantic as S


def rule(phrase, keys):
    return [phrase] if phrase in keys else [k for k in keys if phrase in k or k in phrase]


def first_places(text, keys, max_len):
    words, found = text.split(" ") if text else [], {}
    for i in range(len(words)):
        for n in range(1, min(max_len, len(words) - i) + 1):
            for k in rule(" ".join(words[i:i + n]), keys):
                found.setdefault(k, (i, n))
    return found


def random_case(rng):
    letters = rng.choice(["ab", "abé", "ab "])
    key = lambda: "".join(rng.choice(letters + " ") for _ in range(rng.randint(0 if rng.random() < 0.1 else 1, 9)))
    keys = sorted({key() for _ in range(rng.randint(0, 12))})
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 14))]
    words += [w for k in keys for w in k.split() if rng.random() < 0.5]
    rng.shuffle(words)
    return keys, " ".join(words)


@pytest.mark.parametrize("seed", range(8))
def test_one_pass_equals_the_rule_on_every_phrase(seed):
    rng = random.Random(seed)
    for _ in range(400):
        keys, text = random_case(rng)
        m = KeyMatcher(keys)
        got = {m.keys[k]: place for k, place in m.first_matches(text, 3).items()}
        assert got == first_places(text, keys, 3), (keys, text)
        for phrase in [text, *text.split(" ")[:3], "", " ", "a  b"]:
            assert {m.keys[k] for k in m.match(phrase)} == set(rule(phrase, keys)), (keys, phrase)


def test_ending_early_changes_nothing(monkeypatch):
    monkeypatch.setattr(matching, "_REMEMBERED", 3)
    rng = random.Random(99)
    for _ in range(300):
        keys, text = random_case(rng)
        whole = KeyMatcher(keys).first_matches(text, 3)
        ended = KeyMatcher(keys).first_matches(text, 3, lambda found: len(found) >= 2)
        assert all(whole[k] == place for k, place in ended.items()) and len(ended) >= min(2, len(whole))


def test_a_word_of_a_million_characters():
    m = KeyMatcher(["churn rate", "churn", "clv", "customer age"])
    word = "xchurny" * 150_000
    t0 = time.time()
    assert set(m.match(word)) == {1}
    assert {m.keys[k]: p for k, p in m.first_matches(f"a {word} customer ages {word}", 3).items()} == first_places(
        f"a {word} customer ages {word}", m.keys, 3)
    assert time.time() - t0 < 5


def test_texts_with_nulls_repeated_ids_and_long_words(spark):
    index = spark.createDataFrame([("churn rate", "Churn Rate", 0), ("churn", "Churn Rate", 1), ("plan", "Plan", 2)],
                                  "key string, term string, key_order int")
    glossary = spark.createDataFrame([("Churn Rate", "d1", ["y", "x"]), ("Plan", None, None)],
                                     "term string, definition string, related_columns array<string>")
    long_word = "z" * 100_000 + "plan" + "z" * 100_000
    texts = [(1, "The PLAN\tchurn  rate"), (1, None), (None, "churn"), (2, long_word), (3, ""), (4, "nothing")]
    out = S.enrich_queries(spark.createDataFrame(texts, "query_id int, text string"), index, glossary).collect()
    got = [(r.query_id, r.resolved_terms, r.suggested_columns, r.definitions, r.enriched) for r in out]
    both = ["Plan", "Churn Rate"]
    assert got == [(1, both, ["x", "y"], {"Plan": None, "Churn Rate": "d1"}, True), (1, [], [], None, False),
                   (None, ["Churn Rate"], ["x", "y"], {"Churn Rate": "d1"}, True), (2, ["Plan"], [], {"Plan": None}, True),
                   (3, [], [], None, False), (4, [], [], None, False)]
    resolved = S.resolve_terms(spark.createDataFrame([(1, long_word), (1, "churn"), (2, None), (3, "")],
                                                     "input_id int, text string"), index).collect()
    assert sorted(map(tuple, resolved)) == [(1, "Churn Rate", 1), (1, "Plan", 2), (3, "Churn Rate", 0), (3, "Plan", 2)]


def test_an_empty_glossary_and_one_beyond_the_bound(spark, monkeypatch):
    schema = "key string, term string, key_order int"
    texts = spark.createDataFrame([(1, "a")], "input_id int, text string")
    assert S.resolve_terms(texts, spark.createDataFrame([], schema)).count() == 0
    monkeypatch.setattr(matching, "MAX_KEY_CHARS", 10)
    with pytest.raises(ValueError, match="10 characters"):
        checked_keys(spark.createDataFrame([("eleven chars", "t", 0)], schema))


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = spark.createDataFrame([("a", "t", 0)], "key string, term string, key_order int")
    glossary = spark.createDataFrame([("t", "d", ["x"])], "term string, definition string, related_columns array<string>")
    plan = S.enrich_queries(docs.withColumnRenamed("doc_id", "query_id"), index, glossary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1
