import uuid
from collections import Counter

from meshwork.llm.common import shared_folder
from meshwork.llm.queries import QUERIES
from meshwork.llm.token_counts import TokenRollup, count_tokens, default_versions
from meshwork.llm.tokens import WordTokens, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, docs int"


def counter():
    tokenizer = WordTokens(tokenizer_path("word_bpe_49k.json")).tokenizer
    return {"words-1": lambda t: len(t.encode().split()), "word_bpe_49k-1": lambda t: len(
        tokenizer.encode(t, add_special_tokens=False).ids)}


def brute(state):
    """Totals of (id, text, lang, source) rows."""
    out = Counter()
    docs = Counter()
    for _, text, lang, source in state:
        for version, count in counter().items():
            docs[(source, lang, version)] += 1
            out[(source, lang, version)] += count(text or "")
    return {k: (docs[k], out[k]) for k in docs}


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}


def new(spark):
    return TokenRollup(spark, f"{shared_folder(spark)}/test-{uuid.uuid4().hex}")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_inserts_revisions_and_deletes(spark):
    rollup = new(spark)
    first = [(i, f"Some words {i}, no. {i}! \x0b it's" * (i % 4), ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i}")
             for i in range(60)]
    first += [(100, None, "en", None), (101, "", None, None), (5, *first[5][1:]), (None, "null id", "en", "hot")]
    assert rollup.totals().count() == 0
    assert rollup.commit("a", inserts=frame(spark, first))
    assert totals(rollup) == brute(first)
    change = [(7, "quite another text", "fr", "hot"), (5, "one row of two", "en", "hot"), (900, "not there yet", "en", "new")]
    gone = spark.createDataFrame([(8,), (9,), (9,), (12345,), (None,)], "doc_id long")
    assert rollup.commit("b", revisions=frame(spark, change), deletes=gone)
    state = [r for r in first if r[0] not in (7, 5, 8, 9)] + change
    assert totals(rollup) == brute(state)
    # the second try of a batch changes nothing, whatever it holds
    assert not rollup.commit("b", inserts=frame(spark, first)) and not rollup.commit("a", deletes=gone)
    assert totals(rollup) == brute(state) and rollup.committed() == ["a", "b"]
    assert rollup.commit("c") and totals(rollup) == brute(state)


def test_what_a_failed_try_left_is_overwritten(spark):
    rollup = new(spark)
    rows = [(1, "a b c", "en", "s")]
    rollup._mark = lambda batch: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        rollup.commit("a", inserts=frame(spark, rows * 3))
    except RuntimeError:
        pass
    assert rollup.totals().count() == 0
    del rollup._mark
    assert rollup.commit("a", inserts=frame(spark, rows)) and totals(rollup) == brute(rows)


def test_counts_of_each_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.version): r.tokens for r in count_tokens(docs, default_versions()).collect()}
    for r in docs.collect():
        for version, count in counter().items():
            assert got[(r.doc_id, version)] == count(r.text)


def test_query_against_recount(spark, sf_small):
    line = "Licensed under the Apache License, Version 2.0."
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect() if r.quality == 0}
    state = [(r.doc_id, r.text.replace(line, ""), r.lang, r.source)
             for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect() if r.doc_id not in bad]
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in QUERIES["op2_token_counts"](spark, sf_small).collect()}
    assert got == brute(state)
