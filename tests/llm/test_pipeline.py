from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from meshwork.llm import decontaminate, quality
from meshwork.llm.labelled import fold
from meshwork.llm.tokens import WordTokens, tokenizer_path

from test_decontaminate import brute as brute_contamination
from test_pii import base
from test_simhash import brute as brute_components


def stages(spark, sf_dir, docs=None):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    out = [docs]
    for _, stage in P.STAGES:
        out.append(P.materialise(stage(spark, out[-1], sf_dir)))
    return out


@pytest.fixture(scope="module")
def results(spark, sf_small):
    return stages(spark, sf_small)


def test_stage_order_and_columns(results):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(df.columns == results[0].columns for df in results[1:5])


def test_each_stage_against_brute_force(spark, results, sf_small):
    rows = [df.collect() for df in results]
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    model = quality.fit(results[0], labels.where(~fold("doc_id", 5, 0)))
    good = {r.doc_id for r in quality.score(results[0], model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in rows[1]} == good
    components = brute_components([(r.doc_id, r.text) for r in rows[1]])
    assert sorted(r.doc_id for r in rows[2]) == sorted({c for _, _, c in components})
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    verdict = brute_contamination([(r.doc_id, r.text) for r in rows[2]], bench)
    assert sorted(r.doc_id for r in rows[3]) == sorted(v[0] for v in verdict if not v[5])
    before = {r.doc_id: r.text for r in rows[3]}
    tags = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
    for r in rows[4]:
        text, at, want = before[r.doc_id], 0, ""
        for start, kind, end in base(text):
            if start >= at:
                want += text[at:start] + tags[kind]
            at = max(at, end)
        assert r.text == want + text[at:] and r.n_chars == (len(r.text) if base(text) else r.n_chars)
    assert len(rows[4]) == len(rows[3])
    tokens = WordTokens(tokenizer_path("word_bpe_49k.json")).tokenizer
    pieces = defaultdict(list)
    for r in rows[5]:
        pieces[r.doc_id].append((r.start, r.ids))
    assert set(pieces) == {r.doc_id for r in rows[4]}
    for r in rows[4]:
        ids = [x for _, part in sorted(pieces[r.doc_id]) for x in part]
        assert ids == tokens.encode(r.text, add_special_tokens=False).ids + [2]


def test_run_gives_the_last_stages_rows(spark, results, sf_small):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    total = lambda df: np.sum([r.length for r in df.collect()])
    assert total(P.run(spark, sf_small)) == total(results[-1])
    assert {k[0] for k in key(P.run(spark, sf_small))} == {k[0] for k in key(results[-1])}


def test_nulls_repeats_and_empty_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0),
                                 (10**9 + 1, "word " * 30000, None, "s", 150000)], docs.schema)
    out = stages(spark, sf_small, docs.unionByName(odd))
    assert out[-1].count() > 0 and all(df.columns == docs.columns for df in out[:5])
    assert stages(spark, sf_small, docs.limit(0))[-1].count() == 0
