"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: ASCII letters lower-cased, words split at ASCII white space,
shingles of ``shingle`` words joined by one space (repeats count; a shorter
document is one shingle; none: fingerprint zero), each hashed with XXH64
(seed 42). A bit is set if it is set in over half the hashes.

Search: a fingerprint is cut into ``max_bits // 2 + 1`` segments, so that of
two fingerprints within ``max_bits`` one segment differs by at most one bit.
Each segment is indexed once for every bit left out (its one-wildcard
variants), equal variants meet, and the whole distance is verified. Equal
fingerprints are one node. A bucket gives a spanning set of its links, not
all pairs; one with more than ``BUCKET`` fingerprints is split by equal
parts of the bits that are still free (one of ``max_bits + 1`` parts must be
equal), again and again, so no task holds more and no link is lost.

Edge cases: null and empty texts have fingerprint zero and link like any
other; repeated rows share a component; component_id is the smallest
non-null doc_id of the component (null if it has none); an empty table gives
an empty result; other columns are ignored or, in ``deduplicate``, kept.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, materialise, schema_with, text_blocks
from .components import connected_components

BUCKET = 2048
#: With so few free bits a bucket has at most BUCKET different fingerprints.
FEW = 11
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each document's hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(text_col, out_col, shingle):
    def rows(batches):
        for block, data, offsets in text_blocks(batches, text_col):
            raw, hashes, counts = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = shingle_hashes(raw[a:b], shingle)
                hashes += own
                counts.append(len(own))
            prints = majority(np.array(hashes, np.uint64), np.array(counts, np.int64))
            yield append_columns(block, {out_col: pa.array(prints.view(np.int64))})
    return rows


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """The rows with their fingerprint as a long (the bits of an unsigned one)."""
    return docs.mapInArrow(_fingerprint(text_col, out_col, shingle), schema_with(docs, f"{out_col} long"))


def _variants(max_bits):
    segments = max_bits // 2 + 1
    cuts = [64 * i // segments for i in range(segments + 1)]

    def rows(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mask = np.uint64(((1 << (hi - lo)) - 1) << lo)
                for bit in range(lo, hi):
                    key = (fp & mask & ~np.uint64(1 << bit)) * _MIX
                    key = (key ^ key >> np.uint64(32)) * _MIX2 + np.uint64(64 * lo + bit)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])
    return rows


def _parts(max_bits):
    """Cut the free bits of a row into parts of which one must be equal; the
    bits of that part are then no longer free."""
    def rows(batches):
        for batch in batches:
            key, fp, free = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            for now in np.unique(free):
                bits = [b for b in range(64) if int(now) >> b & 1]
                own = free == now
                for i in range(max_bits + 1):
                    part = bits[len(bits) * i // (max_bits + 1):len(bits) * (i + 1) // (max_bits + 1)]
                    mask = np.uint64(sum(1 << b for b in part))
                    sub = (fp[own] & mask) * _MIX
                    sub = (key[own] ^ sub ^ sub >> np.uint64(31)) * _MIX2 + mask
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sub.view(np.int64)), pa.array(fp[own].view(np.int64)),
                         pa.array(np.full(len(sub), now & ~mask).view(np.int64))], names=["key", "fp", "free"])
    return rows


def spanning_links(fp: np.ndarray, max_bits: int):
    """Links between distinct fingerprints that connect all within max_bits."""
    a, b = [], []
    rest = fp
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            found = rest[near]
            if len(found):
                a += [x] * len(found)
                b += found.tolist()
                front += list(found)
                rest = rest[~near]
    return a, b


def _links(max_bits):
    def rows(batches):
        for batch in batches:
            a, b = [], []
            groups = batch.column(0)
            values = groups.flatten().to_numpy().view(np.uint64)
            sizes = np.asarray(groups.value_lengths())
            ends = np.cumsum(sizes)
            two = sizes == 2  # most buckets
            x, y = values[ends[two] - 2], values[ends[two] - 1]
            near = np.bitwise_count(x ^ y) <= max_bits
            for size, end in zip(sizes[~two].tolist(), ends[~two].tolist()):
                more = spanning_links(values[end - size:end], max_bits)
                a += more[0]
                b += more[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[near], np.array(a, np.uint64)]).view(np.int64)),
                 pa.array(np.concatenate([y[near], np.array(b, np.uint64)]).view(np.int64))], names=["a", "b"])
    return rows


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints (distinct rows of column
    ``fp``) within ``max_bits`` of each other."""
    spark = prints.sparkSession
    # a row becomes dozens: spread them over all tasks first
    spread = prints.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = spread.mapInArrow(_variants(max_bits), "key long, fp long")
    found = None
    while True:
        # a table of its own and a merge join, so that the join can be split
        # where a key is hot and runs alike at every size
        sizes = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), narrow=True)
        rows = materialise(rows.join(sizes.hint("merge"), "key"), narrow=True)
        large = (F.col("n") > BUCKET) & (F.bit_count("free") > FEW) if "free" in rows.columns else F.col("n") > BUCKET
        small = rows.where(~large).groupBy("key").agg(F.collect_set("fp").alias("fps"))
        small = small.select("fps").mapInArrow(_links(max_bits), "a long, b long")
        found = small if found is None else found.unionByName(small)
        rows = rows.where(large)
        if rows.isEmpty():
            return found
        free = F.col("free") if "free" in rows.columns else F.lit(-1).cast("long").alias("free")
        rows = rows.select("key", "fp", free).mapInArrow(_parts(max_bits), "key long, fp long, free long")


def components(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, root) for every fingerprint of a table with column ``fp``."""
    nodes = materialise(prints.select("fp").distinct(), narrow=True)
    roots = connected_components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(fingerprints(texts, shingle).select("doc_id", "fp"))
    roots = components(prints, max_bits)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(roots, "fp")
    least = materialise(least, narrow=True)
    ids = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = materialise(least.select("fp", "root").join(ids, "root").select("fp", "component_id"), narrow=True)
    return prints.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The documents with one of each component kept: the one with the
    smallest doc_id (a null id last; of repeated rows, one)."""
    table = docs.withColumn("__row", F.monotonically_increasing_id())
    table = materialise(fingerprints(table, shingle, text_col, "__fp"))
    prints = table.select(F.col("__fp").alias("fp"),
                          F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("who"))
    roots = components(prints, max_bits)
    first = prints.groupBy("fp").agg(F.min("who").alias("who")).join(roots, "fp")
    kept = first.groupBy("root").agg(F.min("who").alias("who")).select(F.col("who.row").alias("__row"))
    return table.join(kept, "__row", "left_semi").select(*docs.columns)
