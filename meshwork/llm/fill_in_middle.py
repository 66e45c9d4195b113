"""Fill-in-the-middle transformation of documents.

Every text is cut at two places into prefix, middle and suffix, and the three
are written in an order that puts the middle last, behind sentinels:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is

Cuts and form follow from a hash of the document's id and count code points,
so they do not depend on partitions, order or retries. A task works on Arrow
batches with ``pyarrow.compute``: a block of texts becomes a list array of
units (code points), which is flattened with the index of each unit's text;
the unit's ordinal in its text gives its role, units are filtered by role,
lists are rebuilt and joined to pieces, and the pieces are joined row by row.
A block holds about a megabyte of text and a longer text is taken in slices
of that size, so a task needs its Arrow batch and some 100 MB whatever the
lengths are. There is no shuffle.

``restore`` gives back the exact text from output and form. This is possible
because a text that holds a sentinel stays plain, and a sentinel cannot start
inside a piece and end in the next sentinel.

Edge cases: a null text counts as empty and stays plain with 0 code points; a
null id is hashed like an empty one; repeated rows and ids are transformed
each on its own, alike; an empty table gives an empty result. Columns of the
input stay, except those named like a result column, which are replaced.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import BLOCK_BYTES, text_blocks

SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "fim_text")


def _units(data, offsets):
    """List array of the code points of each text, zero-copy over its bytes."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), pa.int64()), units)


def _slice_pieces(data, offsets, base, first, second):
    """Prefix, middle and suffix of each text of a slice; ``base`` units of a
    text came before the slice. Also the units of each text in the slice."""
    lists = _units(data, offsets)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(lists.offsets, parent))
    ordinal = pc.add(ordinal, pc.take(pa.array(base), parent))
    role = pc.add(pc.greater_equal(ordinal, pc.take(first, parent)).cast(pa.int8()),
                  pc.greater_equal(ordinal, pc.take(second, parent)).cast(pa.int8()))
    pieces = []
    for wanted in range(3):
        mask = pc.equal(role, pa.scalar(wanted, pa.int8()))
        counts = np.bincount(pc.filter(parent, mask).to_numpy(), minlength=len(lists))
        rebuilt = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pc.filter(units, mask))
        pieces.append(pc.binary_join(rebuilt, pa.scalar("", pa.large_string())))
    return pieces, pc.list_value_length(lists).to_numpy()


def _slices(data, offsets, limit):
    """Cut the bytes of a block into slices of at most ``limit`` bytes and
    whole code points: (rows from, rows to, byte from, byte to)."""
    at = 0
    while True:
        stop = min(at + limit, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        lo = max(int(np.searchsorted(offsets, at, "right")) - 1, 0) if at else 0
        hi = len(offsets) - 1 if stop == len(data) else int(np.searchsorted(offsets, stop, "left"))
        yield lo, hi, at, stop
        if stop == len(data):
            return
        at = stop


def _pieces(data, offsets, first, second, limit=BLOCK_BYTES):
    """Prefix, middle and suffix of each text of a block."""
    rows = len(offsets) - 1
    done = np.zeros(rows, np.int64)
    parts, owners = ([], [], []), []
    for lo, hi, at, stop in _slices(data, offsets, limit):
        inner = np.clip(offsets[lo:hi + 1], at, stop) - at
        found, counts = _slice_pieces(data[at:stop], inner, done[lo:hi], first[lo:hi], second[lo:hi])
        done[lo:hi] += counts
        owners.append(np.arange(lo, hi))
        for k in range(3):
            parts[k].append(found[k])
    if len(owners) == 1:
        return [p[0] for p in parts]
    # rows of neighbouring slices are in order, so parts of a row are adjacent
    ends = pa.array(np.append(0, np.cumsum(np.bincount(np.concatenate(owners), minlength=rows))))
    return [pc.binary_join(pa.LargeListArray.from_arrays(ends, pa.concat_arrays(p)),
                           pa.scalar("", pa.large_string())) for p in parts]


def _transform(sentinels):
    p, s, m = (pa.scalar(x, pa.large_string()) for x in sentinels)
    none = pa.scalar("", pa.large_string())

    def rows(batches):
        for block, data, offsets in text_blocks(batches, "text"):
            form = block.column("form").cast(pa.large_string())
            first = block.column("prefix_chars").fill_null(0)
            second = pc.add(first, block.column("middle_chars").fill_null(0))
            prefix, middle, suffix = _pieces(data, offsets, first, second)
            output = pc.case_when(
                pc.make_struct(pc.equal(form, "psm"), pc.equal(form, "spm")),
                pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none),
                pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
                pc.binary_join_element_wise(prefix, middle, suffix, none))
            names = ["row", *RESULTS]
            yield pa.RecordBatch.from_arrays(
                [*(block.column(x) for x in names[:-1]), output.cast(pa.large_string())], names=names)
    return rows


def _draw(id_text: Column, k: int) -> Column:
    """The k-th 8-digit group of the hash of a document's id, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), id_text), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 90,
              spm_rate: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The documents with ``fim_text``, ``form``, ``n`` (code points of the
    text), ``prefix_chars`` and ``middle_chars`` (null where plain).

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of
    those in the order suffix, prefix, middle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"),
                       F.length(text).cast("long").alias("n"),
                       *(_draw(F.coalesce(F.col(id_col).cast("string"), F.lit("")), k).alias(f"h{k + 1}")
                         for k in range(4)))
    holds = F.lit(False)
    for sentinel in sentinels:
        holds = holds | F.contains("text", F.lit(sentinel))
    form = (F.when((F.col("n") == 0) | holds | (F.col("h3") % 100 >= rate), "plain")
            .when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    cut = lambda size: F.when(F.col("form") != "plain", size)
    rows = rows.withColumn("form", form).select(
        "row", "text", "n", "form", cut(F.least(*cuts)).alias("prefix_chars"),
        cut(F.greatest(*cuts) - F.least(*cuts)).alias("middle_chars"))
    made = rows.mapInArrow(_transform(sentinels), StructType([
        *(f for f in rows.schema.fields if f.name != "text"), StructField("fim_text", StringType())]))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULTS]
    return made.select(*kept, *RESULTS)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of, from the output and its form."""
    p, s, m = (rf"\Q{x}\E" for x in sentinels)

    def halves(skip: str, inner: str):
        """The piece after the first sentinel, and the two around ``<M>``."""
        head = F.split(F.substr(output, F.lit(len(skip) + 1)), inner, 2)
        return head[0], F.split(head[1], m, 2)

    prefix, rest = halves(sentinels[0], s)
    psm = F.concat(prefix, rest[1], rest[0])
    suffix, rest = halves(sentinels[1], p)
    spm = F.concat(rest[0], rest[1], suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
