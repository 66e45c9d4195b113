"""Batches with nothing, repeated ids, both kinds of change and rival writers."""
import uuid
from collections import Counter

import duckdb
import pytest

from meshwork.llm.common import shared_folder
from meshwork.llm.token_counts import TokenRollup

SCHEMA = "doc_id {}, text string, lang string, source string"


def new(spark):
    return TokenRollup(spark, f"{shared_folder(spark)}/test-{uuid.uuid4().hex}", {"words-1": None})


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA.format(kind))


def ids(spark, *values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"doc_id {kind}")


def totals(rollup):
    return [(r.docs, r.tokens) for r in rollup.totals().collect()]


def test_ids_have_the_type_of_the_first_documents(spark):
    rollup = new(spark)
    assert rollup.commit("nothing") and rollup.commit("deletes only", deletes=ids(spark, 1))
    assert rollup.commit("text ids", inserts=frame(spark, [("x", "a b"), ("y", "c")], "string"))
    assert rollup.commit("gone", deletes=ids(spark, "x", kind="string")) and totals(rollup) == [(1, 1)]
    with pytest.raises(ValueError, match="string"):
        rollup.commit("numbers", inserts=frame(spark, [(1, "a")]))
    numbers = new(spark)
    numbers.commit("long", inserts=frame(spark, [(1, "a"), (2, "b")]))
    assert numbers.commit("int", inserts=frame(spark, [(3, "c")], "int"), deletes=ids(spark, 1, kind="int"))
    assert numbers.commit("short", revisions=frame(spark, [(3, "c c")], "short")) and totals(numbers) == [(2, 3)]
    assert numbers.commit("null", deletes=spark.createDataFrame([(None,)], "doc_id void")) and totals(numbers) == [(2, 3)]


def test_an_id_is_revised_once_per_batch(spark):
    rollup = new(spark)
    rollup.commit("a", inserts=frame(spark, [(1, "one"), (1, "one more"), (2, "two")]))
    rollup.commit("b", revisions=frame(spark, [(1, "x y z")] * 3))
    assert totals(rollup) == [(2, 4)]
    rollup.commit("c", revisions=frame(spark, [(1, "x"), (1, "x y"), (1, "x y z a"), (2, "q"), (2, "q")]).repartition(3))
    docs = {r.doc_id: (r.docs, r.tokens) for r in rollup.documents().collect()}
    assert docs[2] == (1, 1) and docs[1][0] == 1 and docs[1][1] in (1, 2, 4)
    again = new(spark)
    again.commit("c", revisions=frame(spark, [(1, "x y z a"), (1, "x y"), (1, "x"), (2, "q")]))
    assert {r.doc_id: (r.docs, r.tokens) for r in again.documents().collect()} == docs


def test_deletes_come_before_revisions_and_inserts(spark):
    rollup = new(spark)
    rollup.commit("a", inserts=frame(spark, [(1, "old"), (2, "old"), (3, "old")]))
    rollup.commit("b", deletes=ids(spark, 1, 2, 3, 4), inserts=frame(spark, [(1, "n e w"), (4, "n")]),
                  revisions=frame(spark, [(2, "r r")]))
    assert {r.doc_id: r.tokens for r in rollup.documents().collect()} == {1: 3, 4: 1, 2: 2} and totals(rollup) == [(3, 6)]


def test_two_writers_at_once_take_a_document_off_once(spark):
    rollup = new(spark)
    rollup.commit("a", inserts=frame(spark, [(1, "a b c"), (2, "d")]))
    rival = TokenRollup(spark, rollup.folder, rollup.versions)
    mark, tries = rollup._mark, []

    def late(entry):
        if not tries:  # the other writer is done between reading and marking
            assert rival.commit("rival", deletes=ids(spark, 1), inserts=frame(spark, [(3, "e e")]))
        tries.append(entry)
        return mark(entry)

    rollup._mark = late
    assert rollup.commit("b", deletes=ids(spark, 1, 3))
    assert [n for n, _, _ in tries] == [1, 2] and rollup.committed() == ["a", "rival", "b"]
    assert totals(rollup) == [(1, 1)] and totals(rival) == [(1, 1)]
    # a rival with the same batch: it counts once
    tries.clear()
    rival.commit("c", inserts=frame(spark, [(5, "x")]))
    assert not rollup.commit("c", inserts=frame(spark, [(5, "x")])) and totals(rollup) == [(2, 2)]


def test_a_taken_number_is_not_written_over(spark):
    rollup = new(spark)
    assert rollup._mark((0, "first", None)) and not rollup._mark((0, "second", None))
    assert rollup.committed() == ["first"]


def test_words_equal_duckdbs(spark, sf_small):
    rollup = new(spark)
    rollup.commit("all", inserts=spark.read.parquet(f"{sf_small}/documents.parquet"))
    sql = f"""select source, lang, count(*) as docs, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')))
              from '{sf_small}/documents.parquet' group by source, lang"""
    got = Counter({(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect()})
    assert got == {(s, lang): (n, int(t)) for s, lang, n, t in duckdb.sql(sql).fetchall()}
