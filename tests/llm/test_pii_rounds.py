"""Many unseen identifiers in one context, very many matches in one text."""
import random
import time

import pytest
from pyspark.sql import functions as F

from meshwork.llm import pii
from test_pii import KINDS, base, corpus, plain

SCHEMA = "doc_id long, text string"


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: plain(r.spans) for r in pii.find_personal_data(df, **options).collect()}


@pytest.mark.parametrize("seeds, unseen", [(3, 400), (100, 400)])
def test_a_template_with_many_unseen_identifiers(spark, seeds, unseen):
    rows = [(i, f"note {i} call me on +1 ({100 + i}) 555-{1000 + i} today, bye") for i in range(seeds)]
    rows += [(1000 + i, f"word{i} call me on {10_000_000 + 37 * i} today, bye") for i in range(unseen)]
    rows += [(9000 + i, f"part number {50_000_000 + i} in it {i}") for i in range(50)]
    out = found(spark, rows)
    assert all(out[1000 + i] == [("phone", str(len(f"word{i} call me on ")), str(len(f"word{i} call me on ") + 8))]
               for i in range(unseen))
    assert not any(out[9000 + i] for i in range(50))


def test_one_pattern_alone_is_solved_at_once(spark):
    # the word after differs, so only the two words before are shared
    rows = [(i, f"id {i}: call me +1 ({100 + i}) 555-{1000 + i} w{i}") for i in range(3)]
    rows += [(100 + i, f"x{i} call me {10_000_000 + i} v{i}") for i in range(500)]
    out = found(spark, rows)
    assert all(len(out[100 + i]) == 1 for i in range(500))
    # two seeds are no support
    out = found(spark, [r for r in rows if r[0] != 0])
    assert not any(out[100 + i] for i in range(500))


def test_seeds_of_other_kinds_lower_the_confidence(spark):
    rows = [(i, f"a{i} see also +1 ({100 + i}) 555-{1000 + i} w{i}") for i in range(4)]
    rows += [(50 + i, f"a{i} see also name{i}@example.org w{i}") for i in range(8)]
    rows += [(100, "b see also 12345678 end")]
    assert found(spark, rows)[100] == []


def test_numbers_with_single_separators_and_whole_words(spark):
    far = "w" * 200
    rows = [(i, f"{far}{'x' * (i % 2)} mobil +1 ({100 + i}) 555-{1000 + i} {far} z") for i in range(8)]
    rows += [(100, f"{far} mobil 030 1234.567 {far} z"), (101, f"{far[:-1]} mobil 040 1234.567 {far[:-1]} z")]
    out = found(spark, rows)
    assert out[100] == [("phone", "207", "219")] and out[101] == []


def test_a_hundred_thousand_matches_in_one_text(spark):
    mails = " ".join(f"u{i}@example.org" for i in range(100_000))
    df = spark.createDataFrame([(1, mails), (2, "1.2.3.4 " * 50_000)], SCHEMA)
    t0 = time.time()
    out = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert out[1].n_email == 100_000 and out[2].n_ip == 50_000
    assert out[1].spans.endswith(f"email:{len(mails) - len('u99999@example.org')}:{len(mails)}")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == " ".join(["<EMAIL>"] * 100_000) and clean[2] == "<IP> " * 50_000
    assert time.time() - t0 < 90


def redacted(text, spans):
    out, at = "", 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += text[at:start] + f"<{KINDS[kind].upper()}>"
        at = max(at, end)
    return out + text[at:]


def test_redaction_equals_brute_force(spark, monkeypatch):
    rows = [r for r in corpus(9, 200) if r[1] is not None and r[0] is not None and r[0] != 3 and len(r[1]) < 2000]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], SCHEMA)
    monkeypatch.setattr(pii, "PAGE", 7)
    monkeypatch.setattr(pii, "BLOCK", 4)
    spans = {r.doc_id: [(int(a), KINDS.index(k), int(b)) for k, a, b in plain(r.spans)] for r in pii.find_personal_data(df).collect()}
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, text, *_ in rows:
        assert set(base(text)) <= set(spans[i]) and got[i] == redacted(text, spans[i])


def test_columns_of_any_name_are_kept(spark):
    schema = "doc_id long, text string, row int, email string, found int, id long, spans string, clean int, `a.b` int, n_chars int"
    df = spark.createDataFrame([(1, "x a@b.cd y", 2, "e", 3, 4, "s", 5, 6, 10), (2, None, 2, "e", 3, 4, "s", 5, 6, 7)], schema)
    out = pii.redact(df)
    assert out.schema == df.schema or out.columns == df.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (1, "x <EMAIL> y", 2, "e", 3, 4, "s", 5, 6, 11), (2, None, 2, "e", 3, 4, "s", 5, 6, 7)]
    assert {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()} == {1: "email:2:8", 2: ""}


def test_prefixes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 6, 7, 9, 10, 30])]
    df = spark.createDataFrame(rows, "i int, v array<long>")
    add = pii._prefix(F.col("v"), lambda a, b: a + b, F.lit(0).cast("long"))
    for r in df.select("v", add.alias("p")).collect():
        assert (r.p or []) == [sum(r.v[:k]) for k in range(len(r.v))]
