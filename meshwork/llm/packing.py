"""Sum-of-squares online packing of token ids into sequences.

Every task packs the documents of its partition as they come. A document
(its ids and an end id) of ``capacity`` tokens or more fills whole sequences
first; the rest goes to the fill level that minimises the sum of the squared
numbers of partly filled sequences per level, which is kept in a level
array (an empty sequence is level 0; of equal levels the fullest). What is
still partly filled when the partition ends is joined and cut anew, and the
last part of it is cut at powers of two, where no padding is needed.

A task holds its open sequences (of which the rule keeps few) and no more;
no text is shuffled. Sequence ids are ``partition << 32 | number``, the same
when a task is repeated.

Edge cases: null and empty texts are one piece that holds the end id;
a text of any length is cut in as many pieces as it needs; repeated rows
are packed one by one; an empty table gives no pieces; extra columns are
ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .tokens import WordTokens, tokenizer_path


class Levels:
    """Numbers of partly filled sequences by fill level, and where they are."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.at = [[] for _ in range(capacity + 1)]

    def choose(self, size: int) -> int:
        """The level (0: a new sequence) for a piece of ``size`` tokens."""
        n = self.count
        top = self.capacity - size  # level capacity holds nothing: it is full
        change = 2 * (n[1 + size:self.capacity + 1] - n[1:top + 1]) + 2
        if top > 0:
            change[-1] -= 1  # a full sequence is no longer counted
            change = np.where(n[1:top + 1] > 0, change, np.iinfo(np.int64).max)
            best = top - 1 - int(change[::-1].argmin())
            if change[best] <= (2 * n[size] + 1 if size < self.capacity else 0):
                return best + 1
        return 0

    def place(self, size: int, new):
        """The sequence that takes the piece and its offset there."""
        level = self.choose(size)
        if level:
            self.count[level] -= 1
            sequence = self.at[level].pop()
        else:
            sequence = new()
        if level + size < self.capacity:
            self.count[level + size] += 1
            self.at[level + size].append(sequence)
        return sequence, level


class Packer:
    """Pieces: (document, start, ids, tokens of the document, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.levels, self.open = Levels(capacity), {}

    def new(self):
        self.next += 1
        return self.next - 1

    def add(self, doc, ids: bytes):
        """Pieces of sequences that are full now."""
        total, at, cap = len(ids) // 4, 0, self.capacity
        while total - at >= cap:
            yield doc, at, ids[4 * at:4 * (at + cap)], total, self.new(), 0
            at += cap
        if at < total:
            sequence, offset = self.levels.place(total - at, self.new)
            pieces = self.open.setdefault(sequence, [])
            pieces.append((doc, at, ids[4 * at:], total, sequence, offset))
            if offset + total - at == cap:
                yield from self.open.pop(sequence)

    def finish(self):
        """The open sequences, joined and cut so that nothing is padded."""
        left = sum(len(p[2]) // 4 for pieces in self.open.values() for p in pieces)
        room = offset = 0
        for pieces in self.open.values():
            for doc, start, ids, total, _, _ in pieces:
                at, n = 0, len(ids) // 4
                while at < n:
                    if offset == room:
                        room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                        sequence, offset = self.new(), 0
                    take = min(n - at, room - offset)
                    yield doc, start + at, ids[4 * at:4 * (at + take)], total, sequence, offset
                    at, offset, left = at + take, offset + take, left - take
        self.open = {}


_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _batch(pieces, id_type, with_ids):
    docs, starts, ids, totals, sequences, offsets = zip(*pieces)
    columns = {"doc_id": pa.array(docs, id_type), "start": pa.array(starts, pa.int64()),
               "length": pa.array([len(i) // 4 for i in ids], pa.int64()),
               "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
               "doc_tokens": pa.array(totals, pa.int64()), "sequence_id": pa.array(sequences, pa.int64()),
               "offset": pa.array(offsets, pa.int64())}
    if with_ids:
        columns["ids"] = pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _pack(path, capacity, end_id, with_ids):
    def rows(batches):
        tokens = WordTokens(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4").tobytes()
        pieces, id_type = [], None
        for block, data, offsets in text_blocks(batches, "text"):
            id_type = block.column(0).type
            ids, starts = tokens.encode(data, offsets)
            raw, cuts = ids.astype("<u4").tobytes(), (4 * starts).tolist()
            for doc, a, b in zip(block.column(0).to_pylist(), cuts[:-1], cuts[1:]):
                pieces.extend(packer.add(doc, raw[a:b] + end))
            if len(pieces) >= 1000:
                yield _batch(pieces, id_type, with_ids)
                pieces = []
        pieces.extend(packer.finish())
        if pieces:
            yield _batch(pieces, id_type, with_ids)
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 2,
         with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``with_ids``, the ids.

    ``tokenizer``: path of a ``tokenizers`` file, the same on all executors.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, {_COLUMNS}" + (", ids array<int>" if with_ids else "")
    return texts.mapInArrow(_pack(tokenizer or tokenizer_path("word_bpe_49k.json"), capacity, end_id, with_ids), schema)
