"""Benchmark decontamination with suffix arrays over the training text.

Each block of documents is a shard: its words are numbered by 64-bit
identifiers, the word suffixes that begin like some test suffix are sorted
(a suffix array to the depth of a window), and every test suffix is
binary-searched in it. The range found is all places of the window; chained
windows give the longest verbatim matches. No document leaves its shard, so
nothing is shuffled. The tests go to the tasks in blocks of at most
``TEST_BYTES`` of text (measured first); documents pass once per block.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased; a window is ``window`` consecutive words of a test item, or all
words of a shorter one. A document word inside an occurrence is hit. A
document is contaminated if ``min_share`` or more of its words are hit.

Edge cases: null or empty texts have no words and are clean; items without
words hit nothing; repeated rows are judged one by one; items with the same
id count once, a null id counts as the empty string; without documents the
result is empty, without items all documents are clean.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, refine, schema_with, span_ids, text_blocks

TEST_BYTES = 16 << 20
#: Words by which a suffix is compared before it enters the array.
LEAD = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_ids(data, offsets):
    """(identifier of each word, number of words of each text)."""
    low = _LOWER[data]
    word = _WORD[low]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if n else word
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.concatenate([word[1:], [False]]) if n else word
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return span_ids(low, start, stop) | np.uint64(1), counts


def _leads(ids, n):
    x = ids[:max(len(ids) - n + 1, 0)]
    for k in range(1, n):
        x = refine(x, ids[k:len(ids) - n + 1 + k])
    return x


class Tests:
    """The windows of a block of test items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        raw = [t.encode() for _, t in items]
        ids, counts = word_ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        windows = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
        of = np.repeat(np.arange(len(items)), windows)
        at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        ends = np.cumsum(counts)
        start = (ends - counts)[of] + at
        rows = np.zeros((len(of), window), np.uint64)
        for k in range(window):
            inside = start + k < ends[of]
            rows[inside, k] = ids[start[inside] + k]
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        #: The row of each window, item by item, and where an item's begin.
        self.sequence, self.begin = which, np.cumsum(windows) - windows
        self.places = np.stack([of, at], axis=1)[order]
        self.first = np.searchsorted(which[order], np.arange(len(self.rows) + 1))
        self.length = (self.rows != 0).sum(1)
        self.names = [name for name, _ in items]
        self.lead = min([LEAD, *self.length.tolist()])
        self.row_lead = np.zeros(0, np.uint64)
        if len(self.rows):
            x = self.rows[:, 0]
            for k in range(1, self.lead):
                x = refine(x, self.rows[:, k])
            self.row_lead = x
        self.leads = np.unique(self.row_lead)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.leads & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def suffix_array(self, ids, counts):
        """Sorted suffixes that begin like a test: (places, their words)."""
        lead = _leads(ids, self.lead)
        at = np.flatnonzero(self.table[(lead & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[np.isin(lead[at], self.leads)]
        ends = np.repeat(np.cumsum(counts), counts)
        at = at[at + self.lead <= ends[at]]
        padded = np.concatenate([ids, np.zeros(self.window, np.uint64)])
        step = np.arange(self.window)
        words = padded[at[:, None] + step]
        words[at[:, None] + step >= ends[at][:, None]] = 0
        order = np.lexsort(words.T[::-1]) if len(at) else at
        return at[order], words[order], lead[at]

    def bounds(self, words, tests, after):
        """Binary search: where each test suffix begins or, ``after``, ends."""
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(words))
        want, length = self.rows[tests], self.length[tests]
        beyond = np.arange(self.window) >= length[:, None]
        while (busy := low < high).any():
            mid = (low + high) // 2
            got = words[np.minimum(mid, len(words) - 1)]
            differs = (got != want) & ~beyond
            at = differs.argmax(1)
            pick = np.arange(len(tests))
            same = ~differs[pick, at]
            right = np.where(same, after, got[pick, at] < want[pick, at]) & busy
            low = np.where(right, mid + 1, low)
            high = np.where(busy & ~right, mid, high)
        return low

    def matches(self, ids, counts):
        """(test, place of its first word) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.rows) or len(ids) < self.lead:
            return none, none
        at, words, leads = self.suffix_array(ids, counts)
        if not len(at):
            return none, none
        tests = np.flatnonzero(np.isin(self.row_lead, leads))
        low, high = self.bounds(words, tests, False), self.bounds(words, tests, True)
        n = high - low
        pick = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(tests, n), at[pick]


def _merge(first, last):
    """Union of ranges, as (first, last) of its parts."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return first[new].tolist(), reach[np.append(new[1:], len(first)) - 1].tolist()


_ADDED = ("n_words long, hits array<struct<start: long, end: long>>, items array<string>, "
          "matches array<struct<item_id: string, item_word: long, doc_word: long, n_words: long>>")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()),
                             ("n_words", pa.int64())]))


def _starts(tests, row, p, before):
    """Pairs (item, its word, document word) at which a chain of windows
    begins: the windows before differ. ``row``, ``p``: the windows of a text
    in order of place, ``before``: the row of the window before each, or -1."""
    order = np.argsort(row, kind="stable")
    own, bounds = np.unique(row[order], return_index=True)
    bounds = np.append(bounds, len(order))
    found = []
    for r, a, b in zip(own.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        here, places = order[a:b], tests.places[tests.first[r]:tests.first[r + 1]]
        item, at = places[:, 0], places[:, 1]
        old = np.where(at > 0, tests.sequence[tests.begin[item] + at - 1], -2)
        # of equal windows before, only pairs with another one start a chain
        for value in np.unique(before[here]).tolist():
            mine, other = here[before[here] == value], np.flatnonzero(old != value)
            found.append(np.stack([np.repeat(item[other], len(mine)), np.repeat(at[other], len(mine)),
                                   np.tile(p[mine], len(other))]))
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def _longest(tests, test, place):
    """The longest chains of windows that follow each other in item and
    document, which are the longest verbatim matches."""
    order = np.argsort(place, kind="stable")
    test, place = test[order], place[order]
    full = tests.length[test] == tests.window
    out = []
    short, p = test[~full], place[~full]
    n = tests.first[short + 1] - tests.first[short]
    pick = np.repeat(tests.first[short], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out += zip(tests.places[pick, 0].tolist(), tests.places[pick, 1].tolist(), np.repeat(p, n).tolist(),
               np.repeat(tests.length[short], n).tolist())
    row, p = test[full], place[full]
    if len(row):
        rows = np.full(int(p[-1]) + 2, -1, np.int64)
        rows[p] = row
        item, at, word = _starts(tests, row, p, np.where(p > 0, rows[p - 1], -1))
        size = np.diff(np.append(tests.begin, len(tests.sequence)))
        length, going = np.full(len(item), tests.window), np.arange(len(item))
        step = 1
        while len(going):
            i, j, k = item[going], at[going] + step, word[going] + step
            on = (j < size[i]) & (k < len(rows))
            going, i, j, k = going[on], i[on], j[on], k[on]
            going = going[tests.sequence[tests.begin[i] + j] == rows[k]]
            length[going] += 1
            step += 1
        out += zip(item.tolist(), at.tolist(), word.tolist(), length.tolist())
    return [{"item_id": tests.names[i], "item_word": a, "doc_word": d, "n_words": n} for i, a, d, n in out]


def _items(tests, test):
    """The names of the items that windows belong to."""
    rows = np.unique(test)
    n = tests.first[rows + 1] - tests.first[rows]
    pick = np.repeat(tests.first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return {tests.names[i] for i in np.unique(tests.places[pick, 0]).tolist()}


def _search(tests, text_col, names, again, located):
    n_words, hits_, items_, matches_ = names

    def rows(batches):
        for block, data, offsets in text_blocks(batches, text_col):
            ids, counts = word_ids(data, offsets)
            test, place = tests.matches(ids, counts)
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, place, "right")
            old = [block.column(block.schema.get_field_index(c)).to_pylist() if again else [[]] * block.num_rows
                   for c in (hits_, items_, matches_)]
            hits, items, matches = (list(x) for x in old)
            order = np.argsort(doc, kind="stable")
            hit, bounds = np.unique(doc[order], return_index=True)
            for row, own in zip(hit.tolist(), np.split(order, bounds[1:])):
                t, p = test[own], place[own] - (ends[row] - counts[row])
                first = np.concatenate([p, [h["start"] for h in hits[row]]]).astype(np.int64)
                last = np.concatenate([p + tests.length[t], [h["end"] for h in hits[row]]]).astype(np.int64)
                hits[row] = [{"start": a, "end": b} for a, b in zip(*_merge(first, last))]
                if located:
                    matches[row] = matches[row] + _longest(tests, t, p)
                items[row] = sorted({*items[row], *_items(tests, t)})
            yield append_columns(block, {n_words: pa.array(counts, pa.int64()), hits_: pa.array(hits, _SPAN),
                                         items_: pa.array(items, pa.list_(pa.string())),
                                         matches_: pa.array(matches, _MATCH)})
    return rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.05,
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       prefix: str = "", located: bool = True) -> DataFrame:
    """The documents with n_words, hits (word ranges), items, matches (the
    longest verbatim matches and where they are; none unless ``located``),
    n_hit, n_items, items_sha256 and contaminated; ``prefix`` names them apart
    from columns that the documents have already.

    A text that repeats a test's words has as many matches as there are ways
    to lay one along the other; without ``located`` they cost nothing."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(item_text_col), F.lit("")).alias("words"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item") + 16), F.lit(0))).first()[0]
    blocks = -(-size // TEST_BYTES) or 1
    added = _ADDED
    names = [prefix + n for n in ("n_words", "hits", "items", "matches")]
    for n in ("n_words long", "hits array", "items array", "matches array"):
        added = added.replace(n, prefix + n, 1)
    out = docs
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i)
        tests = Tests([(r.item, r.words) for r in part.collect()], window)
        out = out.mapInArrow(_search(tests, text_col, names, i > 0, located), schema_with(out, added))
    n_hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    out = out.withColumn(f"{prefix}n_hit", n_hit)
    share = F.col(f"{prefix}n_hit") >= F.lit(min_share).cast("decimal(20,10)") * F.col(names[0])
    return (out.withColumn(f"{prefix}n_items", F.size(names[2]).cast("long"))
            .withColumn(f"{prefix}items_sha256", F.sha2(F.array_join(names[2], ","), 256))
            .withColumn(f"{prefix}contaminated", (F.col(f"{prefix}n_hit") > 0) & share))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = find_contamination(docs, benchmark, prefix="__test_", located=False, **options)
    return found.where(~F.col("__test_contaminated")).select(*docs.columns)
