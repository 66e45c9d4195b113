"""Helpers shared by the corpus operators."""
from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import checkpoint_dir, intermediate_path

#: Text handled at once by the numpy kernels; bounds a task's memory whatever
#: the number of documents in an Arrow batch.
BLOCK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``
    (a local session without that setting gets a folder of its own)."""
    return checkpoint_dir(spark).rstrip("/")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package when the driver
    found it by ``sys.path`` only. A cluster has it installed or gets it with
    ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def materialise(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: after the loss of an executor later steps read the
    table again, and rows and their numbering stay as they were written.
    ``narrow`` tables hold a few numbers per row: they are written by at most
    four tasks per core, so that many shuffle partitions don't become as many
    tiny files. ``plans.session.clean_up`` deletes what was written.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = intermediate_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The UTF-8 text of a batch; null counts as empty."""
    array = batch.column(batch.schema.get_field_index(column))
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    return array.fill_null("")


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES):
    """Cut batches into blocks of whole documents of about ``limit`` bytes.

    Yields ``(rows, data, offsets)``: the rows of the block, their texts as
    one uint8 array, and where each text starts (one entry more than rows).
    A document longer than ``limit`` is a block of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = text_column(batch, column)
        _, offset_buffer, data_buffer = text.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield (batch.slice(start, stop - start), data[offsets[start]:offsets[stop]],
                   offsets[start:stop + 1] - offsets[start])
            start = stop


_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S29, _S31, _S32, _S33 = (np.uint64(x) for x in (29, 31, 32, 33))


def refine(first, later):
    """The 64-bit identifier of a longer string, from those of the string at
    its start and of the string at a later offset."""
    x = first * _K1
    x += (later << _S31 | later >> _S33) * _K2
    x ^= x >> _S29
    x *= _K3
    x ^= x >> _S32
    return x


_BASE = np.uint64(0x2545F4914F6CDD1D)
_LETTERS = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n):
    """Powers of _BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 2**64)))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def span_ids(data, start, stop):
    """64-bit identifiers of the byte strings start..stop, by prefix sums."""
    n = len(data)
    up, down = _powers_of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[:n], out=total[1:])
    return refine((total[stop] - total[start]) * down[start], (stop - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data, offsets, cut=None):
    """(start, stop) of the words between ASCII white space and ends of
    texts; ``cut`` marks places inside words at which they are cut too (its
    entry i lies between bytes i and i + 1)."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:][space] = edge[:-1][space] = True
    if cut is not None:
        edge[1:-1] |= cut
    return np.flatnonzero(~space & edge[:-1]), np.flatnonzero(~space & edge[1:]) + 1


def append_columns(rows: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The rows with more columns; a column of the same name is replaced."""
    names = [n for n in rows.schema.names if n not in columns]
    arrays = [rows.column(rows.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *columns.values()], names=[*names, *columns])


def schema_with(df: DataFrame, columns: str) -> str | object:
    """The schema of ``df`` with the columns of a DDL string added or replaced."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    added = _parse_datatype_string(columns)
    names = {f.name for f in added.fields}
    return StructType([*(f for f in df.schema.fields if f.name not in names), *added.fields])
