import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.llm import fill_in_middle
from meshwork.llm.fill_in_middle import restore, transform


def brute(doc_id, text):
    """The contract, by Python string slices."""
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def corpus():
    rng = random.Random(5)
    letters = "ab <PSM>é́日😀\n\0\r"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 7, 50, 400])))) for i in range(400)]
    return rows + [(1000, None), (1001, ""), (1002, "😀" * 5000), (1003, "<P>x"), (1004, "x<<S>"), (1005, "<M"),
                   (None, "no id"), (1, rows[1][1]), (1, "another text of id 1"), (-7, "negative")]


@pytest.mark.parametrize("parts", [1, 5])
def test_every_text_equals_the_brute_force(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    out = transform(docs).withColumn("restored", restore(F.col("fim_text"), F.col("form"))).collect()
    got = sorted((str(r.doc_id), r.text or "", r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.fim_text) for r in out)
    want = sorted((str(i), t or "", n, f, str(a), str(b), o) for i, t in rows for n, f, a, b, o in [brute(i, t)])
    assert got == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert all(r.restored == (r.text or "") for r in out)


@pytest.mark.parametrize("limit", [4, 5, 7, 64, 1000])
def test_slices_of_long_texts_join_to_the_same_pieces(limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("aé日😀") for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    cuts = [sorted((rng.randint(0, len(t)), rng.randint(0, len(t)))) for t in texts]
    first, second = (pa.array([c[k] for c in cuts], pa.int64()) for k in (0, 1))
    pieces = fill_in_middle._pieces(np.frombuffer(b"".join(raw), np.uint8), offsets, first, second, limit)
    for t, (a, b), *got in zip(texts, cuts, *(p.to_pylist() for p in pieces)):
        assert got == [t[:a], t[a:b], t[b:]]


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, row int, n string, form int, h1 int, fim_text binary, `a.b` int"
    empty = transform(spark.createDataFrame([], schema))
    assert empty.count() == 0
    rows = [(4, "some text", 9, "n", 3, 8, b"x", 5)]
    out = transform(spark.createDataFrame(rows, schema)).collect()[0].asDict()
    assert out["row"] == 9 and out["h1"] == 8 and out["a.b"] == 5 and out["text"] == "some text"
    assert (out["n"], out["form"], out["fim_text"]) == (9, *[brute(4, "some text")[i] for i in (1, 4)])


def test_one_scan_and_no_shuffle(spark, sf_small):
    from meshwork.llm.queries import QUERIES
    plan = QUERIES["op13_fill_in_middle"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
