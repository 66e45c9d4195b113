"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed when a string of ``length`` bytes that covers it also
starts at another place of the corpus (of the same document or another; no
string crosses documents; overlaps count; all is judged on the input).

Method. The places of the corpus are suffixes, grouped in buckets by their
first bytes and refined from there:

1. The bucket identifier of a 2n-byte string is made from the identifiers of
   the n-byte strings at its start and at the later offset n (``refine``),
   so 8-byte strings lead to 128-byte strings in four steps, and any longer
   string takes two identifiers that overlap.
2. Each window of ``length`` bytes is represented by its least 64-byte gram
   (the first of equals), which depends on the window's content alone. The
   windows of one gram are a run; runs fall in q-gram buckets. A bucket with
   one run holds no repeat and is dropped.
3. Runs of a bucket whose whole contexts have the same identifier repeat in
   full. What is left is cut into cells of 8 windows and sorted into buckets
   by the identifier of the bytes that all windows of a cell share; what is
   still left is cut into single windows. ``classify`` is used for each of
   the three levels, on the few suffixes that the level before left open.

Rows in Spark are identifiers and places; all texts cross the network once, by
a 64-bit key of id and text, to meet the places found in them (later levels
only those left open), unless these are few enough to be broadcast. A bucket of any size is counted with
map-side aggregation and joined back, where adaptive execution splits it.
Identifiers have 64 bits, those that must agree together 128.

Edge cases: null and empty texts have no bytes (n_bytes 0, the hash of the
empty string); repeated rows are copies of each other and repeat in full;
a null doc_id is an id like any other; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, refine, text_blocks

GRAM = 64
CELLS = (8, 1)
#: Bits of a key that hold a place of the block; a longer text is cut into
#: overlapping parts of PART bytes.
PLACE_BITS = 24
PART = 8 << 20


def bucket_ids(data: np.ndarray) -> dict[int, np.ndarray]:
    """Identifiers of the 64- and 128-byte strings at every place."""
    n = len(data)
    if n < 8:
        return {64: np.zeros(0, np.uint64), 128: np.zeros(0, np.uint64)}
    x = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,))
    ids, size = {}, 8
    while size < 128:
        m = max(len(x) - size, 0)
        x = refine(x[:m], x[size:size + m])
        size *= 2
        ids[size] = x
    return ids


def string_id(ids, at, length):
    """Identifier of the string of ``length`` (128 to 256) bytes at ``at``."""
    return refine(ids[128][at], ids[128][at + (length - 128)])


def context_id(ids, first, last, anchor, length):
    """Identifier of all bytes of the windows ``first`` to ``last`` and of
    where they lie about their anchor."""
    return refine(refine(string_id(ids, first, length), string_id(ids, last, length)),
                  ((anchor - first) * 65536 + (last - first)).astype(np.uint64))


def runs(offsets, ids, length):
    """(first, last, anchor) of each run of windows with a common anchor."""
    h, total = ids[GRAM], int(offsets[-1])
    n, span = total - length + 1, length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    mask = np.uint64((1 << PLACE_BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[:len(key) - (span - size)], key[span - size:])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + length <= ends)
    if not len(at):
        return none, none, none
    anchor = (key[at] & mask).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(at)) - 1
    return at[start], at[stop], anchor[start]


def _parts(data, offsets, length):
    """The block in parts that a key can number; (data, offsets, first row,
    bytes of that row before the part)."""
    if len(data) <= (1 << PLACE_BITS):
        yield data, offsets, 0, 0
        return
    for row in range(len(offsets) - 1):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        for s in range(lo, max(hi - length, lo) + 1, PART):
            part = data[s:min(s + PART + length - 1, hi)]
            yield part, np.array([0, len(part)]), row, s - lo


def _pack(first, last, anchor):
    return (first << 16) | ((last - first) << 8) | (anchor - first)


_ROWS = "bucket long, full long, k long, place long"


def _rows_batch(bucket, full, k, place):
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.view(np.int64)), pa.array(full.view(np.int64)), pa.array(k), pa.array(place)],
        names=["bucket", "full", "k", "place"])


def _run_rows(length):
    def rows(batches):
        for block, data, offsets in text_blocks(batches, "text"):
            keys = block.column(0).to_numpy()
            for part, part_offsets, row, before in _parts(data, offsets, length):
                ids = bucket_ids(part)
                first, last, anchor = runs(part_offsets, ids, length)
                if len(first):
                    doc = np.searchsorted(part_offsets, first, "right") - 1
                    base = part_offsets[doc] - before
                    yield _rows_batch(ids[GRAM][anchor], context_id(ids, first, last, anchor, length),
                                      keys[row + doc], _pack(first - base, last - base, anchor - base))
    return rows


def cells(ids, first, last, anchor, width, length):
    """The windows first..last cut into cells on a grid about the anchor:
    (bucket, full, first, last, anchor)."""
    low, high = (anchor - last) // width, (anchor - first) // width
    count = high - low + 1
    run = np.repeat(np.arange(len(first)), count)
    cell = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + low[run]
    x = anchor[run]
    lo = np.maximum(first[run], x - cell * width - (width - 1))
    hi = np.minimum(last[run], x - cell * width)
    bucket = refine(string_id(ids, x - cell * width, length - width + 1), cell.astype(np.uint64))
    return bucket, context_id(ids, lo, hi, x, length), lo, hi, x


def _cell_rows(width, length):
    def rows(batches):
        for block, data, offsets in text_blocks(batches, "text"):
            keys, active = block.column(0).to_numpy(), block.column(2)
            for row in range(block.num_rows):
                place = np.asarray(active[row].values.to_numpy(zero_copy_only=False))
                ids = bucket_ids(data[offsets[row]:offsets[row + 1]])
                first = place >> 16
                bucket, full, lo, hi, x = cells(ids, first, first + (place >> 8 & 255), first + (place & 255),
                                                width, length)
                yield _rows_batch(bucket, full, np.full(len(lo), keys[row]), _pack(lo, hi, x))
    return rows


def classify(rows: DataFrame) -> DataFrame:
    """(k, flag and place as ``mark``) of the suffixes that share a bucket:
    flag 1 if the whole context repeats, 2 if it must be refined (also one
    example of each repeated context that others may repeat in part)."""
    # counts become tables of their own, so that the joins with them can be
    # split where a bucket is hot
    shared = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), narrow=True)
    shared = materialise(rows.join(shared, "bucket", "left_semi"), narrow=True)
    classes = shared.groupBy("bucket", "full").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "place")).alias("example"))
    mixed = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    classes = materialise(classes.join(mixed, "bucket", "left"), narrow=True)
    open_ = F.col("classes").isNotNull() & ((F.col("n") == 1) | (F.col("example") == F.struct("k", "place")))
    flag = (F.col("n") > 1).cast("long") + open_.cast("long") * 2
    return (shared.join(classes, ["bucket", "full"]).withColumn("flag", flag).where("flag > 0")
            .select("k", F.col("place").bitwiseOR(F.shiftleft("flag", 60)).alias("mark")))


def _mark_docs(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """The texts with the marks of each document as an array."""
    marks = marks.groupBy("k").agg(F.collect_set("mark").alias("marks"))
    return texts.join(marks, "k", how)


def covered(n: int, first, last, length) -> np.ndarray:
    """Which of n bytes lie in windows first..last."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + length, -1)
    return np.cumsum(step[:n]) > 0


_DONE = ("doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
         "spans array<struct<start: long, end: long>>, kept binary")
_OPEN = ", k long, text string, repeated array<long>, open array<long>"


def _resolve(length, keep, leave_open):
    """Texts with their marks; the documents that need no refinement get
    their result, the others keep text and marks."""
    def rows(batches):
        for block, data, offsets in text_blocks(batches, "text"):
            col = {n: block.column(block.schema.get_field_index(n)) for n in block.schema.names}
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept",
                                   "k", "text", "repeated", "open")}
            for row in range(block.num_rows):
                marks = col["marks"][row].values
                marks = marks.to_numpy(zero_copy_only=False) if marks is not None else np.zeros(0, np.int64)
                place = marks & ((1 << 60) - 1)
                repeated, active = place[marks >> 60 & 1 > 0], place[marks >> 61 & 1 > 0]
                if "repeated" in col:
                    repeated = np.concatenate([repeated, col["repeated"][row].values.to_numpy(zero_copy_only=False)])
                text = data[offsets[row]:offsets[row + 1]]
                is_open = leave_open and len(active) > 0
                out["k"].append(col["k"][row].as_py() if is_open else None)
                out["text"].append(text.tobytes().decode() if is_open else None)
                out["repeated"].append(repeated if is_open else None)
                out["open"].append(active if is_open else None)
                out["n_bytes"].append(len(text))
                if is_open:
                    for n in ("n_removed", "n_spans", "kept_sha256", "spans", "kept"):
                        out[n].append(None)
                    continue
                first = repeated >> 16
                gone = covered(len(text), first, first + (repeated >> 8 & 255), length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = text[~gone].tobytes()
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(len(edge) // 2)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                out["kept"].append(kept if keep else None)
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
                     "kept_sha256": pa.string(), "kept": pa.binary(), "k": pa.int64(), "text": pa.string(),
                     "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                     "repeated": pa.list_(pa.int64()), "open": pa.list_(pa.int64())}
            names = list(out)[:None if leave_open else 6]
            yield pa.RecordBatch.from_arrays([col["doc_id"], *(pa.array(out[n], kinds[n]) for n in names)],
                                             names=["doc_id", *names])
    return rows


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                   keep_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    spans (removed byte ranges) and, with ``keep_bytes``, the kept bytes.

    ``length`` is 192 to 256 bytes here (a longer one needs more refinement
    steps of the same kind).
    """
    if not GRAM + 128 <= length <= 256:
        raise ValueError("length must be between 192 and 256")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text")
    first = materialise(texts.select("k", "text").mapInArrow(_run_rows(length), _ROWS))
    done = _DONE.format(id=dict(texts.dtypes)["doc_id"])
    table = materialise(_mark_docs(texts, classify(first), "left").mapInArrow(
        _resolve(length, keep_bytes, True), done + _OPEN))
    open_ = table.where("open is not null").select("doc_id", "k", "text", "repeated", "open")
    marks, todo = [], open_.select("k", "text", "open")
    for width in CELLS:
        level = classify(materialise(todo.mapInArrow(_cell_rows(width, length), _ROWS)))
        if width == 1:
            marks.append(level)
            break
        level = materialise(level, narrow=True)
        marks.append(level.where(F.col("mark").bitwiseAND(F.lit(1 << 60)) > 0))
        again = level.where(F.col("mark").bitwiseAND(F.lit(1 << 61)) > 0).select(
            "k", F.col("mark").bitwiseAND(F.lit((1 << 60) - 1)).alias("mark"))
        todo = _mark_docs(open_.select("k", "text"), again, "inner").select(
            "k", "text", F.col("marks").alias("open"))
    found = marks[0]
    for m in marks[1:]:
        found = found.unionByName(m)
    rest = _mark_docs(open_.drop("open"), found, "left").mapInArrow(_resolve(length, keep_bytes, False), done)
    out = table.where("open is null").drop("k", "text", "repeated", "open").unionByName(rest)
    return out if keep_bytes else out.drop("kept")
