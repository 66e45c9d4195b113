"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A
gram of three symbols (letters of the lower-cased text; what is no letter is
one symbol) is bound by multiplying their vectors, rotated by their place in
the gram. A document is the bundle (sum) of its grams, a language the bundle
of its training documents; the language of the greatest cosine is predicted
and the cosine (0 if negative) is the score.

Tasks count grams before they bundle, so a gram costs one vector sum however
often it occurs. Prototypes are summed by Spark: one vector per task and
language reaches the shuffle.

Edge cases: null texts and texts without letters are ``und`` with score 0,
as is every text when no language was learned; texts of any length are read
whole; repeated rows get equal results; of equal cosines the language that
sorts first; an empty table gives an empty result.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, schema_with, text_blocks
from .labelled import fit_sample, fold

DIMENSIONS = 1024
GRAM = 3
#: Gram vectors that a task keeps (4 KB each).
CACHE_GRAMS = 16_384
_IS_LETTER = None


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other symbols as one 0,
    with a 0 at both ends; empty if there is no letter."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_IS_LETTER[points], points, 0)
    if not points.any():
        return points[:0]
    points = np.concatenate([[0], points, [0]])
    return points[(points != 0) | np.concatenate([[True], points[:-1] != 0])].astype(np.int64)


class Grams:
    """Vectors of grams, kept for the next block."""

    def __init__(self):
        self.symbol = {}
        self.keys = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, DIMENSIONS), np.float32)

    def _symbol(self, point):
        if point not in self.symbol:
            if len(self.symbol) >= CACHE_GRAMS:
                self.symbol.clear()
            rng = np.random.default_rng([20240607, point])
            self.symbol[point] = (rng.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.float32)
        return self.symbol[point]

    def bind(self, key):
        out = np.ones(DIMENSIONS, np.float32)
        for place in range(GRAM):
            out *= np.roll(self._symbol(key >> 21 * place & 0x1FFFFF), place)
        return out

    def lookup(self, keys):
        """Vectors of sorted distinct keys, as rows."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = keys[~known]
            made = np.array([self.bind(int(k)) for k in new], np.float32)
            if len(self.keys) + len(new) > CACHE_GRAMS:
                out = np.empty((len(keys), DIMENSIONS), np.float32)
                out[known], out[~known] = self.vectors[at[known]], made
                self.keys, self.vectors = keys[:CACHE_GRAMS], out[:CACHE_GRAMS]
                return out
            place = np.searchsorted(self.keys, new)
            self.keys = np.insert(self.keys, place, new)
            self.vectors = np.insert(self.vectors, place, made, axis=0)
            at = np.searchsorted(self.keys, keys)
        return self.vectors[at]


def bundles(texts, grams: Grams) -> np.ndarray:
    """One bundle per text (zero if it has no letter)."""
    keys, docs = [], []
    for i, text in enumerate(texts):
        p = letters(text or "")
        if len(p) >= GRAM:
            keys.append(p[:-2] | p[1:-1] << 21 | p[2:] << 42)
            docs.append(np.full(len(p) - 2, i))
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if keys:
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = len(distinct)
        pair, count = np.unique(np.concatenate(docs) * n + which, return_counts=True)
        for lo in range(0, n, 4096):  # bounds the dense count matrix
            own = (pair % n >= lo) & (pair % n < lo + 4096)
            dense = np.zeros((len(texts), min(4096, n - lo)), np.float32)
            dense[pair[own] // n, pair[own] % n - lo] = count[own]
            out += dense @ grams.lookup(distinct[lo:lo + 4096])
    return out


def _blocks(batches, limit=256 << 10):
    for block, _, _ in text_blocks(batches, "text", limit):
        yield block, block.column(block.schema.get_field_index("text")).to_pylist()


def _learn(batches):
    grams, sums = Grams(), defaultdict(lambda: np.zeros(DIMENSIONS))
    for block, texts in _blocks(batches):
        made = bundles(texts, grams)
        length = np.linalg.norm(made, axis=1, keepdims=True)
        made /= np.maximum(length, 1)
        for lang in set(langs := block.column(block.schema.get_field_index("label")).to_pylist()):
            sums[lang] += made[[x == lang for x in langs]].sum(0, dtype=np.float64)
    place = pa.array(np.arange(DIMENSIONS, dtype=np.int32))
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), place, pa.array(total)],
                                         names=["lang", "place", "value"])


def fit(docs: DataFrame, fit_docs: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of the languages of ``docs``, from at most ``fit_docs`` of
    its documents with a language (the first in hash order of the id)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("own"))
    langs = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    sample = fit_sample(rows, langs, "lang", "doc_id", fit_docs).select("text", F.col("label").cast("string").alias("label"))
    parts = sample.mapInArrow(_learn, "lang string, place int, value double")
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.lang):
        v = np.array([x["value"] for x in r.v])
        if np.linalg.norm(v) > 0:
            out[r.lang] = v / np.linalg.norm(v)
    return out


def _predict(prototypes, lang_out, score_out):
    names = list(prototypes)
    matrix = np.array(list(prototypes.values()), np.float32).reshape(-1, DIMENSIONS)

    def rows(batches):
        grams = Grams()
        for block, texts in _blocks(batches):
            made = bundles(texts, grams)
            length = np.linalg.norm(made, axis=1)
            if names:
                cosine = made @ matrix.T / np.maximum(length, 1e-9)[:, None]
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
                lang = [names[b] if n > 0 else "und" for b, n in zip(best, length)]
                score[length == 0] = 0
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield append_columns(block, {lang_out: pa.array(lang, pa.string()), score_out: pa.array(score, pa.float64())})
    return rows


def predict(docs: DataFrame, prototypes: dict, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The rows (with a column ``text``) with language and score."""
    return docs.mapInArrow(_predict(prototypes, lang_out, score_out),
                           schema_with(docs, f"{lang_out} string, {score_out} double"))


def identify(docs: DataFrame, folds: int = 4, held: int = 2, fit_docs: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    prototypes = fit(docs.where(~fold("doc_id", folds, held)), fit_docs)
    out = predict(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", fold("doc_id", folds, held).alias("held_out"), "lang_pred", "score")
