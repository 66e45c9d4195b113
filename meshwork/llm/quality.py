"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its features, a softmax layer
scores the mean. Features are its white-space words, the pairs of words that
follow each other (their hashes by exclusive or, so that a word and its
repetition are one feature for all words) and the 3- and 4-byte grams inside
words (with the white space at their ends), each hashed to one of
``BUCKETS`` vectors; case and punctuation count. Vectors and layer are
trained together by stochastic gradient descent on at most ``fit_docs``
labelled documents (whole texts). The mean of vectors followed by a linear
layer is the mean of one number per feature, so scoring looks up the
difference of the two classes' outputs per bucket.

Edge cases: null and empty texts have no feature and get the score of the
bias alone; a text of any length is read whole; repeated rows get equal
scores; without any label of both kinds every score is the labels' mean
(0.5 without labels); an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, schema_with, text_blocks
from .labelled import fit_sample, fold

BITS = 17
BUCKETS = 1 << BITS
GRAMS = (3, 4)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_C = np.random.default_rng(7).integers(0, 2**32, (5, 256), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_M = np.uint32(0x9E3779B1)


def features(data: np.ndarray, offsets: np.ndarray):
    """(bucket, document) of each feature of the texts."""
    n = len(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    buckets, docs = [], []
    space = _SPACE[data]
    code = np.where(space, np.uint8(32), data)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    inner = np.concatenate([[0], np.cumsum(space)])
    for size in GRAMS:
        m = max(n - size + 1, 0)
        h = np.full(m, size, np.uint32)
        for i in range(size):
            h = (h ^ _C[i][code[i:m + i]]) * _M
        ok = (inner[size - 1:size - 1 + m] == inner[1:m + 1]) & (at[:m] + size <= ends[:m])
        buckets.append(h[ok] >> np.uint32(32 - BITS))
        docs.append(doc[:m][ok])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]])[:n] | first[:n]))
    if len(start):
        letters = np.zeros(n + 1, np.uint32)
        # a sum over the word of letter numbers that depend on the place in it
        word = np.zeros(n, np.int64)
        word[start] = start
        since = at - np.maximum.accumulate(word)
        value = _C[4][code] * (since.astype(np.uint32) * np.uint32(2) + np.uint32(1)) * _M
        value ^= value >> np.uint32(15)
        value[space] = 0
        np.cumsum(value * _M, out=letters[1:], dtype=np.uint32)
        stop = np.append(start[1:], n)
        stop = np.minimum(stop, ends[start])
        h = (letters[stop] - letters[start]) * _M
        h = (h ^ h >> np.uint32(13)) * _M
        buckets.append(h >> np.uint32(32 - BITS))
        docs.append(doc[start])
        pair = doc[start[1:]] == doc[start[:-1]]
        both = (h[1:] ^ h[:-1])[pair] + np.uint32(1)
        both = (both ^ both >> np.uint32(15)) * _M
        buckets.append((both ^ both >> np.uint32(13)) * _M >> np.uint32(32 - BITS))
        docs.append(doc[start[1:]][pair])
    return (np.concatenate(buckets).astype(np.int32) if buckets else np.zeros(0, np.int32),
            np.concatenate(docs) if docs else np.zeros(0, np.int64))


def _bags(batches):
    """Each document's distinct buckets and their shares."""
    for block, data, offsets in text_blocks(batches, "text"):
        bucket, doc = features(data, offsets)
        key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(block.num_rows + 1) * BUCKETS)
        total = np.bincount(doc, minlength=block.num_rows)
        ids = [(key[a:b] % BUCKETS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
        shares = [(count[a:b] / max(t, 1)).astype(np.float32) for a, b, t in zip(cut[:-1], cut[1:], total)]
        yield pa.RecordBatch.from_arrays(
            [block.column(block.schema.get_field_index("label")).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())),
             pa.array(shares, pa.list_(pa.float32()))], names=["label", "ids", "shares"])


def train(bags, dim: int = 12, epochs: int = 8, rate: float = 2.0, seed: int = 11):
    """(output difference per bucket, bias) from (label, ids, shares)."""
    labels = np.array([b[0] for b in bags], np.int64)
    if len(set(labels.tolist())) < 2:
        mean = np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98)
        return np.zeros(BUCKETS, np.float32), float(np.log(mean / (1 - mean)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            label, ids, shares = bags[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = shares @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            vectors[ids] -= step * shares[:, None] * back
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = 3000, id_col: str = "doc_id",
        text_col: str = "text"):
    """A model from the labelled documents; ``labels`` holds the rows that may be used."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = fit_sample(rows, labels, label, id_col, fit_docs)
    bags = sample.select("text", "label").mapInArrow(_bags, "label long, ids array<int>, shares array<float>").toArrow()
    bags = [(int(a.as_py() > 0), b.values.to_numpy(), c.values.to_numpy())
            for a, b, c in zip(*(bags.column(i).combine_chunks() if bags.num_rows else [] for i in range(3)))]
    return train(sorted(bags, key=lambda b: (len(b[1]), b[0], b[1].tobytes())))


def _score(model, text_col, out_col):
    weight, bias = model

    def rows(batches):
        for block, data, offsets in text_blocks(batches, text_col):
            bucket, doc = features(data, offsets)
            total = np.bincount(doc, weight[bucket], block.num_rows)
            z = total / np.maximum(np.bincount(doc, minlength=block.num_rows), 1) + bias
            yield append_columns(block, {out_col: pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())})
    return rows


def score(docs: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows with the probability of label 1."""
    return docs.mapInArrow(_score(model, text_col, out_col), schema_with(docs, f"{out_col} double"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3,
             fit_docs: int = 3000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels.where(~fold("doc_id", folds, held)), fit_docs=fit_docs)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", fold("doc_id", folds, held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = fit(docs, labels, **options)
    return score(docs, model, out_col="__quality").where(F.col("__quality") >= threshold).select(*docs.columns)
