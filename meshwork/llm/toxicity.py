"""Toxicity: subsequence string-kernel SVM with Nystroem landmarks.

Kernel. A word (its letters, lower-cased, between two end marks) is mapped
to its subsequences of three symbols within ``SPAN`` places; each counts
``DECAY`` to the power of the symbols left out. The kernel of two words is
the normalised inner product, so inserted characters and gaps lower it a
little only. Characters that are no letters are dropped from a word, and
runs of three or more one-letter words are read as one word.

Training. Sentences of at most ``fit_docs`` labelled documents (a sentence
of a toxic document need not be toxic: only some word of the document is).
Spark counts in how many different sentences of toxic and of clean documents
each word occurs; copies of a sentence count once, so that the words of a
document that was copied often don't look toxic with it. Words
whose counts give them away as toxic are the positive examples; the words of
clean documents that are most frequent, and those most like a positive, are
the negative ones. Landmarks are taken from both; the kernel against the
landmarks, times the inverse root of their kernel matrix, gives the features
of a linear SVM. Because kernel values are
inner products, landmarks and weights fold into one number per subsequence.

Bounds. ``fit_docs`` bounds the documents of the sample. All its suspects are
tested, and all telling words and all rarer ones that look like them are
positive examples. ``examples`` bounds the negative ones: the ``examples``
most frequent clean words and the 2 * ``examples`` most like a positive of
each round, which are those that decide the margin. Scoring reads all words of
all documents.

Scoring. A sentence scores as its most toxic word; a document has the three
highest margins of its words (repetitions count), and a logistic function of
them and of the number of words,
fitted on the sample, is the probability.

Edge cases: null and empty texts and texts without letters have no word and
get the score of the lowest margins; any length is read whole; repeated rows
score alike; if the sample has no telling word every score is the share of
toxic labels (0.0 without labels); an empty table gives an empty result.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, append_columns, materialise, schema_with, span_ids, text_blocks, word_spans
from .labelled import fit_sample, fold

DECAY = 0.45
SPAN = 5
LETTER_BITS = 6
SIZE = 1 << 3 * LETTER_BITS
ROUNDS = 5
#: Words whose margin a task remembers (20 bytes each).
KNOWN_WORDS = 4_000_000
#: Margins count from LOW (that of no word) to HIGH; a document has TOP of them.
LOW, HIGH, TOP = -2.0, 2.0, 3
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
_CODES = None


def _codes():
    """Letter numbers by code point: a to z are 1 to 26, other letters share
    27 to 63; 0 is no letter."""
    global _CODES
    if _CODES is None:
        _CODES = np.array([0 if not chr(i).isalpha() else i - 96 if 97 <= i <= 122 else 27 + i % 37
                           for i in range(0x110000)], np.int64)
    return _CODES


def subsequences(words: list[str]):
    """(word number, subsequence, weight), one row for each different
    subsequence of a word, with weights of unit length."""
    points = np.frombuffer("\n".join([*words, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    end = points == 10
    code = _codes()[points]
    keep = end | (code > 0)
    end, code = end[keep], code[keep]
    # end marks: a 0 before and after the letters of a word
    word = np.cumsum(end) - end
    first = np.flatnonzero(np.concatenate([[True], end[:-1]])) if len(end) else np.zeros(0, np.int64)
    at = np.arange(len(code)) + word + 1
    flat = np.zeros(len(code) + len(first) + 1, np.int64)
    owner = np.full(len(flat), -1)
    flat[at], owner[at] = code, word
    start = first + np.arange(len(first))
    owner[start] = np.arange(len(first))
    parts = []
    for a, b in _STEPS:
        i = np.arange(max(len(flat) - a - b, 0))
        ok = (owner[i] == owner[i + a + b]) & (owner[i] >= 0)
        i = i[ok]
        triple = (flat[i] << 2 * LETTER_BITS) | (flat[i + a] << LETTER_BITS) | flat[i + a + b]
        parts.append((owner[i] * SIZE + triple, np.full(len(i), DECAY ** (a + b - 2))))
    key, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    weight = np.bincount(which, np.concatenate([w for _, w in parts]), len(key))
    owner = key // SIZE
    norm = np.sqrt(np.bincount(owner, weight**2, len(words)))
    return owner, key % SIZE, weight / norm[owner] if len(owner) else weight


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel values of the words of ``a`` (in parts) and ``b``."""
    owner, sub, weight = subsequences(b)
    subs = np.unique(sub)
    right = np.zeros((len(subs), len(b)), np.float32)
    right[np.searchsorted(subs, sub), owner] = weight
    out = np.empty((len(a), len(b)))
    for lo in range(0, len(a), 500):
        part = a[lo:lo + 500]
        owner, sub, weight = subsequences(part)
        at = np.searchsorted(subs, sub)
        own = at < len(subs)
        own[own] = subs[at[own]] == sub[own]
        left = np.zeros((len(part), len(subs)), np.float32)
        left[owner[own], at[own]] = weight[own]
        out[lo:lo + len(part)] = left @ right
    return out


def margins(words: list[str], weights: np.ndarray) -> np.ndarray:
    owner, sub, weight = subsequences(words)
    return np.bincount(owner, weight * weights[sub], len(words))


def tokens(text: str) -> list[str]:
    return text.lower().split()


def normal(word: str) -> str:
    return "".join(c for c in word if c.isalpha())


def spelled(words: list[str]) -> list[str]:
    """Words spelled out in one-letter words."""
    out, run = [], []
    for w in [*words, "  "]:
        letters = w if len(w) == 1 and w.isalpha() else normal(w)
        if len(letters) == 1:
            run.append(letters)
        elif letters or w == "  ":
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return out


_ENDS = re.compile(r"[.!?\n]+")


def _sentences(batches):
    """The sentences of the sample's documents: identifier, label, words."""
    for block, _, _ in text_blocks(batches, "text"):
        ids, labels, words = [], [], []
        for text, label in zip(block.column(block.schema.get_field_index("text")).to_pylist(),
                               block.column(block.schema.get_field_index("label")).to_pylist()):
            for sentence in {s.strip() for s in _ENDS.split((text or "").lower())}:
                own = tokens(sentence)
                own = {normal(w) for w in own} | set(spelled(own))
                own.discard("")
                if own:
                    ids.append(xxhash.xxh64_intdigest(sentence) - 2**63)
                    labels.append(int(label > 0))
                    words.append(sorted(own))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()),
                                          pa.array(words, pa.list_(pa.string()))], names=["id", "toxic", "words"])


def train_words(toxic: dict[str, int], clean: dict[str, int], landmarks: int = 768, ridge: float = 0.01,
                steps: int = 30):
    """One weight per subsequence, and the offset, from toxic and clean words
    with the numbers of their sentences.

    The linear SVM (squared hinge; clean words weigh ten times as much in
    total, each word by the root of its number) is solved in its primal form by Newton's
    method on the examples inside the margin.
    """
    half = landmarks // 2
    marks = list(dict.fromkeys([*toxic][:half] + [*clean][:half]))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    use = values > 1e-3
    root = vectors[:, use] / np.sqrt(values[use])
    words = [*toxic, *clean]
    x = np.hstack([kernel(words, marks) @ root, np.ones((len(words), 1))])
    sign = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    weight = np.sqrt(np.array([*toxic.values(), *clean.values()], float))
    weight[sign > 0] *= 100 / weight[sign > 0].sum()
    weight[sign < 0] *= 1000 / weight[sign < 0].sum()
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        inside = sign * (x @ w) < 1
        rows = x[inside] * weight[inside, None]
        new = np.linalg.solve(penalty + rows.T @ x[inside], rows.T @ sign[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    alpha = root @ w[:-1]
    owner, sub, value = subsequences(marks)
    return np.bincount(sub, value * alpha[owner], SIZE), float(w[-1])


def telling(counts: list, toxic_n: int, clean_n: int, tests: int):
    """(word, toxic, clean sentences) of words that toxic documents alone explain."""
    base = toxic_n / max(toxic_n + clean_n, 1)
    out = []
    for word, t, c in counts:
        n = t + c
        share = t / n
        if share <= base or t < 2:
            continue
        gain = t * np.log(share / base) + (c * np.log((1 - share) / (1 - base)) if c else 0)
        if gain > np.log(max(tests, 1)) - 3 and share > 0.75:
            out.append((word, t, c))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_docs: int = 20_000, id_col: str = "doc_id",
        text_col: str = "text", examples: int = 1500):
    """A model from the labelled documents; ``labels`` holds the rows that may be used."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = fit_sample(rows, labels, label, id_col, fit_docs).select("text", "label")
    # copies count once: of the documents and, for the words, of the sentences
    sample = materialise(sample.dropDuplicates(["text", "label"]), narrow=True)
    base = sample.agg(F.avg((F.col("label") > 0).cast("int"))).first()[0] or 0.0
    sentences = sample.mapInArrow(_sentences, "id long, toxic long, words array<string>").dropDuplicates(["id", "toxic"])
    sentences = materialise(sentences, narrow=True)
    kinds = {r.toxic: r.n for r in sentences.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_n, clean_n = kinds.get(1, 0), kinds.get(0, 0)
    words = sentences.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    words = materialise(words, narrow=True)
    # at most one row per word of the bounded sample
    tests = words.count()
    suspects = words.where(F.col("t") >= F.greatest(F.lit(2), 3 * F.col("c"))).orderBy(F.desc("t"), "word")
    suspects = [(r.word, r.t, r.c) for r in suspects.collect()]
    found = telling(suspects, toxic_n, clean_n, tests) if toxic_n and clean_n else []
    toxic = {w: t for w, t, _ in found}
    if not toxic:
        return None, base
    plain = words.where("t <= c").where("c >= 1")
    common = {r.word: r.c for r in plain.orderBy(F.desc("c"), "word").limit(examples).collect()}
    sums = subsequences([*toxic])
    weights = (np.bincount(sums[1], sums[2], SIZE) / len(toxic), 0.0)
    for turn in range(ROUNDS):
        # words of clean documents that look toxic so far, and rarer words of
        # toxic documents that do
        scored = plain.select("word", "c").mapInArrow(_margins(weights), "word string, c long, margin double")
        like = scored.orderBy(F.desc("margin"), "word").limit(2 * examples).collect()
        common = {**{r.word: r.c for r in like}, **common}
        if turn == ROUNDS - 1:
            m = margins([w for w, _, _ in suspects], weights[0]) + weights[1]
            rarer = sorted(((x, w, t) for (w, t, _), x in zip(suspects, m.tolist()) if x > 0.5), reverse=True)
            toxic = {**toxic, **{w: t for _, w, t in rarer if w not in toxic}}
        weights = train_words(toxic, common)
    rows = sample.mapInArrow(_score((weights, None), "text", "z"), schema_with(sample, "z array<double>"))
    rows = [(r.z, int(r.label > 0)) for r in rows.select("z", "label").collect()]
    return weights, logistic(np.array([z for z, _ in rows]), np.array([y for _, y in rows]))


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (the last an offset) of the probability of y by z, by Newton's
    method with a weak prior; no weight is negative but the offset."""
    x = np.hstack([z, np.ones((len(z), 1))])
    prior = np.array([0.5] * z.shape[1] + [0.0])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.05 * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
        w[:-1] = np.maximum(w[:-1], 0.01)
    return w


def _margins(weights):
    table, bias = weights

    def rows(batches):
        for batch in batches:
            word = batch.column(0)
            m = margins(word.to_pylist(), table) + bias if len(word) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([word, batch.column(1), pa.array(m)], names=["word", "c", "margin"])
    return rows


class Words:
    """Margins of known words by their 64-bit identifiers."""

    def __init__(self, weights):
        self.weights = weights
        self._forget()

    def _forget(self):
        self.keys, self.margin = np.zeros(0, np.uint64), np.zeros(0)
        self.letters = np.zeros(0, np.int8)  # none, one or more than one

    def measure(self, words: list[str]) -> np.ndarray:
        out = [margins(words[lo:lo + 20_000], self.weights[0]) for lo in range(0, len(words), 20_000)]
        return np.clip(np.concatenate([*out, np.zeros(0)]) + self.weights[1], LOW, HIGH)

    def _learn(self, keys, words):
        letters = np.array([min(len(normal(w)), 2) for w in words], np.int8)
        margin = self.measure(words)
        margin[letters == 0] = LOW  # nothing but end marks
        for i, w in enumerate(words):
            if len(parts := w.split()) > 1:  # other white space than ASCII
                margin[i] = self.measure(parts).max()
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.margin = np.insert(self.margin, at, margin)
        self.letters = np.insert(self.letters, at, letters)

    def highest(self, data, offsets) -> np.ndarray:
        """The TOP highest margins of each text of a block, and the negative
        logarithm of its number of words."""
        start, stop = word_spans(data, offsets)
        counts = np.diff(np.searchsorted(start, offsets))
        keys, first, which = np.unique(span_ids(LOWER[data], start, stop), return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.searchsorted(self.keys, keys)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == keys[known]
            if known.all():
                break
            if len(self.keys) + np.count_nonzero(~known) > KNOWN_WORDS:
                self._forget()
                known[:] = False
            raw, new = data.tobytes(), first[~known]
            self._learn(keys[~known], [raw[a:b].decode().lower() for a, b in zip(start[new].tolist(), stop[new].tolist())])
        margin, letters = self.margin[at][which], self.letters[at][which]
        doc = np.repeat(np.arange(len(counts)), counts)
        # spelled out words: three or more one-letter words, signs between them
        some = np.flatnonzero(letters)
        one = letters[some] == 1
        run = np.flatnonzero(one[:-2] & one[1:-1] & one[2:] & (doc[some][:-2] == doc[some][2:])) if len(some) > 2 else some[:0]
        if len(run):
            raw, extra, owner = data.tobytes(), [], []
            for row in np.unique(doc[some[run]]).tolist():
                found = spelled(tokens(raw[offsets[row]:offsets[row + 1]].decode()))
                extra += found
                owner += [row] * len(found)
            margin = np.concatenate([margin, self.measure(extra)])
            doc = np.concatenate([doc, np.array(owner, np.int64)])
        order = np.lexsort((-margin, doc))
        doc, margin = doc[order], margin[order]
        begin = np.searchsorted(doc, np.arange(len(counts) + 1))
        out = np.full((len(counts), TOP + 1), LOW)
        out[:, TOP] = -np.log1p(counts)  # long texts have high margins by chance
        for k in range(TOP):
            has = begin[:-1] + k < begin[1:]
            out[has, k] = margin[begin[:-1][has] + k]
        return out


def _score(model, text_col, out_col):
    weights, curve = model

    def rows(batches):
        words = Words(weights)
        for block, data, offsets in text_blocks(batches, text_col):
            if weights is None:
                yield append_columns(block, {out_col: pa.array(np.full(block.num_rows, curve), pa.float64())})
                continue
            z = words.highest(data, offsets)
            if curve is None:
                yield append_columns(block, {out_col: pa.array(z.tolist(), pa.list_(pa.float64()))})
                continue
            p = 1 / (1 + np.exp(-np.clip(z @ curve[:-1] + curve[-1], -30, 30)))
            yield append_columns(block, {out_col: pa.array(p, pa.float64())})
    return rows


def score(docs: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows with the probability that they are toxic."""
    return docs.mapInArrow(_score(model, text_col, out_col), schema_with(docs, f"{out_col} double"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3,
             fit_docs: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels.where(~fold("doc_id", folds, held)), fit_docs=fit_docs)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", fold("doc_id", folds, held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
