"""Scores of the three classifiers recomputed from their definitions."""
import math
from collections import Counter

import numpy as np
import pytest

from meshwork.llm import language_id as L
from meshwork.llm import quality as Q
from meshwork.llm import toxicity as T

TEXTS = ["", "   ", "one", "a b c", "Die  Straße\nist lang, sehr lang.", "you are a f-o-o l, f  o o l!", "日本語 テスト 日本",
         "x" * 300, "ab " * 90, "é́ mixed 123 45 words, words", "it is Bad bad BAD b.a.d stuff\tthere", "\x0b tab \x0c end "]
MASK = 2**32 - 1


def quality_buckets(text):
    """Hashed grams, words and word pairs, byte by byte in whole numbers."""
    data = bytes(32 if b in b"\t\n\x0b\x0c\r " else b for b in text.encode())
    c, m, shift = Q._C.astype(object), int(Q._M), 32 - Q.BITS
    out = []
    for size in Q.GRAMS:
        for i in range(len(data) - size + 1):
            gram = data[i:i + size]
            if 32 not in gram[1:-1]:
                h = size
                for k, b in enumerate(gram):
                    h = ((h ^ int(c[k][b])) * m) & MASK
                out.append(h >> shift)
    hashes = []
    for word in data.split(b" "):
        if word:
            total = 0
            for k, b in enumerate(word):
                v = (int(c[4][b]) * (2 * k + 1) * m) & MASK
                total += (v ^ v >> 15) * m
            h = (total * m) & MASK
            hashes.append(((h ^ h >> 13) * m) & MASK)
    out += [h >> shift for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        both = ((a ^ b) + 1) & MASK
        both = ((both ^ both >> 15) * m) & MASK
        out.append((((both ^ both >> 13) * m) & MASK) >> shift)
    return out


def test_quality_features_and_scores(spark):
    raw = [t.encode() for t in TEXTS]
    bucket, doc = Q.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, text in enumerate(TEXTS):
        assert Counter(bucket[doc == i].tolist()) == Counter(quality_buckets(text)), text
    weight = np.random.default_rng(1).normal(size=Q.BUCKETS)
    got = Q.score(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), (weight, 0.3)).collect()
    for r in got:
        own = quality_buckets(r.text)
        z = (sum(weight[b] for b in own) / len(own) if own else 0.0) + 0.3
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality_training_steps():
    """Two steps of the descent, by hand, of the averaged vectors' softmax."""
    bags = [(1, np.array([1, 5], np.int32), np.array([0.5, 0.5], np.float32)), (0, np.array([2], np.int32), np.array([1.0], np.float32))]
    weight, bias = Q.train(bags, dim=3, epochs=2, rate=1.0, seed=4)
    rng = np.random.default_rng(4)
    vectors = ((rng.random((Q.BUCKETS, 3)) - 0.5) / 3).astype(np.float32)
    layer, b, done = np.zeros((3, 2)), np.zeros(2), 0
    vectors = vectors.astype(float)
    for _ in range(2):
        for i in rng.permutation(2):
            label, ids, shares = bags[i]
            step, done = 1.0 * (1 - done / 4), done + 1
            mean = sum(s * vectors[k] for k, s in zip(ids, shares))
            z = mean @ layer + b
            p = np.exp(z) / np.exp(z).sum() - np.eye(2)[label]
            back = layer @ p
            layer, b = layer - step * np.outer(mean, p), b - 0.1 * step * p
            for k, s in zip(ids, shares):
                vectors[k] = vectors[k] - step * s * back
    assert np.allclose(weight[[1, 2, 5, 7]], (vectors @ (layer[:, 1] - layer[:, 0]))[[1, 2, 5, 7]], atol=1e-5)
    assert math.isclose(bias, b[1] - b[0], abs_tol=1e-5)


def language_bundle(text):
    points = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    if not any(points):
        return np.zeros(L.DIMENSIONS)
    run = [0]
    for p in [*points, 0]:
        if p or run[-1]:
            run.append(p)
    symbol = lambda p: np.random.default_rng([20240607, p]).integers(0, 2, L.DIMENSIONS, dtype=np.int8) * 2.0 - 1
    out = np.zeros(L.DIMENSIONS)
    for i in range(len(run) - 2):
        out += np.prod([np.roll(symbol(p), k) for k, p in enumerate(run[i:i + 3])], axis=0)
    return out


def test_language_bundles_and_cosines(spark):
    learn = {"de": "die straße ist sehr lang und breit", "en": "it is bad stuff and words there"}
    prototypes = {k: (v := language_bundle(t)) / np.linalg.norm(v) for k, t in learn.items()}
    got = L.predict(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), prototypes).collect()
    for r in got:
        v = language_bundle(r.text)
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {k: float(v @ p / np.linalg.norm(v)) for k, p in prototypes.items()}
        assert math.isclose(r.score, min(max(max(cosines.values()), 0), 1), abs_tol=1e-4)
        if abs(cosines["de"] - cosines["en"]) > 1e-3:
            assert r.lang_pred == max(cosines, key=cosines.get)


def word_margin(word, weights):
    """Subsequences of three symbols within SPAN places, gap by gap."""
    letters = [0, *(int(T._codes()[ord(c)]) for c in word.lower() if T._codes()[ord(c)]), 0]
    total = Counter()
    for i in range(len(letters)):
        for j in range(i + 1, len(letters)):
            for k in range(j + 1, min(i + T.SPAN, len(letters))):
                key = letters[i] << 2 * T.LETTER_BITS | letters[j] << T.LETTER_BITS | letters[k]
                total[key] += T.DECAY ** (k - i - 2)
    norm = math.sqrt(sum(v * v for v in total.values()))
    return sum(v / norm * weights[k] for k, v in total.items()) if total else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_margins_and_scores(spark, seed):
    rng = np.random.default_rng(seed)
    table, bias = rng.normal(size=T.SIZE) * 0.3, -0.2
    curve = np.array([0.7, 0.4, 0.2, 0.1, -0.5])
    got = T.score(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), ((table, bias), curve)).collect()
    for r in got:
        words = r.text.lower().split()
        margins = [min(max(word_margin(w, table) + bias, T.LOW), T.HIGH) if T.normal(w) else T.LOW for w in words]
        margins += [min(max(word_margin(w, table) + bias, T.LOW), T.HIGH) for w in T.spelled(words)]
        top = sorted(margins + [T.LOW] * T.TOP, reverse=True)[:T.TOP]
        z = np.array([*top, -math.log1p(len(words))]) @ curve[:-1] + curve[-1]
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6), r.text
