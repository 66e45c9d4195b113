import zlib

import numpy as np
import pytest

from meshwork.llm import language_id, quality, toxicity

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, label int"


def tables(spark, sf=DIR):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def held(doc_id, folds, part):
    return zlib.crc32(str(doc_id).encode()) % folds == part


def test_language_of_held_out_documents(spark):
    docs, _ = tables(spark)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = language_id.identify(docs).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 4, 2) for r in out)
    own = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.97


def test_language_ignores_what_it_may_not_see(spark):
    docs, _ = tables(spark)
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'xx', lang) lang",
                              "'other' source", "n_chars")
    pick = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(df).collect())
    assert [x[:2] for x in pick(docs)] == [x[:2] for x in pick(changed)]


def test_language_edge_cases(spark):
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate(
        [("the house of the word", "en"), ("das haus und der hund", "de"), ("the the house", "en"), ("das haus", "de")] * 8)]
    rows += [(100, None, "en", "s", 1), (101, "", None, "s", 1), (102, "12 ! 3", "de", "s", 1), (103, "日本", None, "s", 1),
             (104, "the house " * 30000, None, "s", 1), (None, "das haus", "de", "s", 1), (0, rows[0][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[104].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False
    assert language_id.identify(df.limit(0)).count() == 0
    nothing = language_id.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(rows)


def test_bundle_equals_the_sum_of_bound_grams():
    grams = language_id.Grams()
    text = "Ab, cäb"
    p = language_id.letters(text)
    assert p.tolist() == [0, ord("a"), ord("b"), 0, ord("c"), ord("ä"), ord("b"), 0]
    want = sum(np.roll(grams._symbol(int(p[i])), 0) * np.roll(grams._symbol(int(p[i + 1])), 1)
               * np.roll(grams._symbol(int(p[i + 2])), 2) for i in range(len(p) - 2))
    assert np.allclose(language_id.bundles([text, "", None, "x1"], grams)[0], want)


def test_small_gram_cache_changes_nothing(monkeypatch):
    texts = ["the quick brown fox", "jumps over", "the lazy dog", "größe äöü"]
    want = language_id.bundles(texts, language_id.Grams())
    monkeypatch.setattr(language_id, "CACHE_GRAMS", 7)
    grams = language_id.Grams()
    for _ in range(2):
        assert np.allclose(language_id.bundles(texts, grams), want)


def metrics(out, truth):
    own = [(r.score, r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, t in own if t], [s for s, _, t in own if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    return auc, np.mean([p == t for _, p, t in own])


def test_quality_of_held_out_documents(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality.classify(docs, labels).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3) for r in out)
    auc, accuracy = metrics(out, truth)
    print("quality", auc, accuracy)
    assert auc > 0.97 and accuracy > 0.95


def test_quality_features_do_not_cross_texts():
    texts = ["Ab cd", "", "e", "Ab cd", "x" * 40 + " y\n"]
    raw = [t.encode() for t in texts]
    bucket, doc = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    bags = [sorted(bucket[doc == i].tolist()) for i in range(len(texts))]
    for i, t in enumerate(raw):
        alone, _ = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert sorted(alone.tolist()) == bags[i]
    assert bags[0] == bags[3] and not bags[1] and len(bags[2]) == 1


def test_quality_edge_cases(spark):
    rows = [(i, ["good words here", "BAD!! BAD!!"][i % 2] * (i % 3 + 1), "en", "s", 1) for i in range(60)]
    rows += [(100, None, None, None, 1), (101, "", "x", "s", 1), (102, "good words " * 20000, "x", "s", 1),
             (None, "good words here", "x", "s", 1), (0, rows[0][1], "x", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, None), (0, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 64 and got[100].score == got[101].score
    assert got[102].score > 0.5 and got[None].score > 0.5 and got[1].score < 0.5
    assert quality.classify(df.limit(0), labels).count() == 0
    none = quality.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {102, None, 0}


def test_toxicity_of_held_out_documents(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = toxicity.classify(docs, labels).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.3) for r in out)
    auc, accuracy = metrics(out, truth)
    print("toxicity", auc, accuracy)
    assert auc > 0.93 and accuracy > 0.97


def test_string_kernel_against_its_definition():
    def brute(a, b):
        def sub(w):
            s = [0] + [toxicity._codes()[ord(c)] for c in w if c.isalpha()] + [0]
            out = {}
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(i + toxicity.SPAN, len(s))):
                        key = (s[i], s[j], s[k])
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
            return out
        x, y = sub(a), sub(b)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
    words = ["idiot", "id-iot", "idxiot", "a", "größe", "aaaa", "worthless"]
    want = np.array([[brute(a, b) for b in words] for a in words])
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-5)
    assert want[0, 1] == 1 and 0.3 < want[0, 2] < 1


def test_toxicity_tolerates_gaps_and_inserted_characters(spark):
    rng = np.random.default_rng(1)
    bad = ["idiot", "moron", "worthless", "pathetic"]
    plain = ["".join(rng.choice(list("aeioustrnl"), rng.integers(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(plain, n))
    rows = [(i, f"{say(8)} {rng.choice(bad)} {say(5)}. {rng.choice(bad)} {say(3)}" if i % 4 == 0 else say(18), "en", "s", 1)
            for i in range(800)]
    tests = {1000: "x id-iot y mo*ron z", 1001: "the i d i o t and m o r o n", 1002: "the idixot worthxless pathetiic moron",
             1003: "the house " * 9, 1004: None, 1005: "", 1006: "12 !! 3", 1007: "ok " * 50000 + "idiot moron",
             None: "Idiot MORON"}
    df = spark.createDataFrame(rows + [(k, t, None, None, 1) for k, t in tests.items()] + rows[:1], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(None, 1, 1), (7, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    assert all(got[i].predicted == 1 for i in (1000, 1001, 1002, 1007, None))
    assert all(got[i].predicted == 0 for i in (1003, 1004, 1005, 1006)) and got[1004].score == got[1005].score
    assert toxicity.classify(df.limit(0), labels).count() == 0
    none = toxicity.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == df.count()
