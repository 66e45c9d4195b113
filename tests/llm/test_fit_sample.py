"""Repeated ids give one row by a stated order."""
from pyspark.sql import functions as F

from meshwork.llm.labelled import fit_sample


def test_text_and_label_are_of_one_row_in_any_order(spark):
    rows = [(i % 20, f"text {i} {i * i}", "en" if i % 3 else "de") for i in range(200)] + [(99, None, "fr"), (7, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    texts = {}
    for i, t, own in rows:
        texts.setdefault(i, set()).add((t, own))
    out = []
    for parts in (1, 4, 7):
        mixed = docs.repartition(parts, "text").orderBy(F.xxhash64("text", F.lit(parts)))
        out.append(sorted(map(tuple, fit_sample(mixed, mixed, "own", "doc_id", 1000).collect())))
    assert out[0] == out[1] == out[2] and [r[0] for r in out[0]] == [*range(20), 99]
    assert all((t, label) in texts[i] and label == max(x for _, x in texts[i] if x) for i, t, label in out[0])


def test_labels_of_another_table_and_the_bound(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = {r.doc_id: (r.text in ("a", "b"), r.label) for r in fit_sample(docs, labels, "toxic", "doc_id", 10).collect()}
    assert got == {1: (True, 1), 2: (False, 0)}
    assert fit_sample(docs, labels, "toxic", "doc_id", 1).count() <= 1
