"""Embedding near-duplicates with randomised-rotation binary codes.

Vectors of one label are linked if their cosine is at least ``threshold``.

1. Equal vectors become one class with a count.
2. A class gets the signs of its unit vector after a random rotation (its
   code, one bit a dimension) and the correction factor f = <code, rotated
   vector>; both are computed once and stored with it. Further rotations give the bits of ``tables`` bucket keys; bits per key grow with
   the logarithm of the label's classes, tables so that a pair at the
   threshold shares no key with probability ``miss`` at most, and so that the
   expected number of lost links of the label, were all pairs at the
   threshold, is below one. A label of up
   to ``TARGET`` classes is one bucket and is searched exhaustively.
3. Inside a bucket <code x, rotated y> / f(x) estimates the inner product
   without bias; its error is sqrt((1 - f^2) / f^2 / (D - 1)) times about a
   standard normal. Pairs whose estimate plus ``SIGMAS`` errors is below the
   threshold are dropped, all others are recomputed exactly in double
   precision from the vectors. A pair counts in the first table it shares.
4. A bucket larger than ``BLOCK`` is cut into blocks that meet two by two in
   tasks of their own. Tasks return the number of links of each class and
   links that span its components, never all pairs.

Edge cases: null, zero or non-finite vectors, vectors with null components
and vectors without label link with nothing (n_links 0, their own
component); vectors of different length never link; repeated rows link like
other equal vectors; component_id is the smallest non-null vec_id reachable;
an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, materialise, schema_with
from .components import connected_components

TARGET = 256
BLOCK = 2048
SIGMAS = 5.0
_CHUNK = 1 << 16


@lru_cache(maxsize=64)
def rotation(dim: int, turn: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, turn, 17]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan_tables(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits per key, tables) for a label of so many classes."""
    bits = max(0, math.ceil(math.log2(max(classes, 1) / TARGET)))
    if not bits or threshold <= 0:
        return 0, 1
    # at most classes**2 / 2 links
    miss = min(miss, 2 / classes**2)
    same = (1 - math.acos(min(threshold, 1)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of every vector in every table."""
    if not bits:
        return np.zeros((len(unit), tables), np.int64)
    dim = unit.shape[1]
    turns = -(-bits * tables // dim)
    signs = np.hstack([unit @ rotation(dim, 1 + t).T >= 0 for t in range(turns)])[:, :bits * tables]
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def binary_codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, one bit a dimension, and the
    correction factor <code, rotated vector> of each."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def _coded(batches):
    """Classes with their code and factor, which are stored."""
    for batch in batches:
        vec = batch.column(batch.schema.get_field_index("embedding"))
        dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
        raw, ends = vec.flatten().to_numpy().astype(np.float64), np.cumsum(dims)
        codes, factors = [b""] * len(dims), np.zeros(len(dims))
        for d in set(dims.tolist()):
            own = np.flatnonzero(dims == d)
            values = raw[(ends[own] - d)[:, None] + np.arange(d)]
            packed, factors[own] = binary_codes(values / np.linalg.norm(values, axis=1, keepdims=True))
            for i, code in zip(own.tolist(), packed):
                codes[i] = code.tobytes()
        yield append_columns(batch, {"code": pa.array(codes, pa.binary()), "factor": pa.array(factors)})


def _rows(threshold, miss):
    def rows(batches):
        for batch in batches:
            rep, n, label, vec, dim, classes, code, factor = (batch.column(i) for i in range(8))
            raw = vec.flatten().to_numpy().astype(np.float64)
            dims, sizes = dim.to_numpy(), classes.to_numpy()
            ends = np.cumsum(dims)
            for d, size in sorted(set(zip(dims.tolist(), sizes.tolist()))):
                own = np.flatnonzero((dims == d) & (sizes == size))
                values = raw[(ends[own] - d)[:, None] + np.arange(d)]
                unit = values / np.linalg.norm(values, axis=1, keepdims=True)
                bits, tables = plan_tables(size, threshold, miss)
                at = keys(unit, bits, tables)
                pick = pa.array(own)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [rep.take(pick), n.take(pick), label.take(pick), vec.take(pick), dim.take(pick),
                         classes.take(pick), code.take(pick), factor.take(pick),
                         pa.array(np.full(len(own), t, np.int32)), pa.array(at[:, t])],
                        names=["rep", "n", "label", "embedding", "dim", "classes", "code", "factor", "tbl", "bucket"])
    return rows


def linked_pairs(vectors: np.ndarray, codes: np.ndarray, factor: np.ndarray, left: np.ndarray, right: np.ndarray,
                 threshold: float):
    """Pairs (i of left, j of right) with a cosine of at least threshold, in
    parts; estimated from the codes and factors of left, recomputed where the
    bound allows it."""
    norm, dim = np.linalg.norm(vectors, axis=1), vectors.shape[1]
    code = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    error = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + 1e-5
    least = ((threshold - error) * factor).astype(np.float32)
    # only the other side is turned, without a code
    turned = np.zeros(vectors.shape, np.float32)
    turned[right] = (vectors[right] / norm[right][:, None]) @ rotation(dim, 0).T
    step = max(1, (1 << 21) // max(len(right), 1))
    for at in range(0, len(left), step):
        own = left[at:at + step]
        i, j = np.nonzero(code[own] @ turned[right].T >= least[own][:, None])
        i, j = own[i], right[j]
        for lo in range(0, len(i), _CHUNK):
            a, b = i[lo:lo + _CHUNK], j[lo:lo + _CHUNK]
            cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b])
            ok = (cosine >= threshold) & (a != b)
            yield a[ok], b[ok]


def spanning(n: int, pairs) -> list[tuple[int, int]]:
    """Of links given in parts, those that first connect two components."""
    up, out = np.arange(n), []
    for a, b in pairs:
        while True:
            x, y = up[a], up[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            out += zip(a[first].tolist(), b[first].tolist())
            up[high] = np.minimum(x, y)[first]
            while (up != (higher := up[up])).any():
                up = higher
    return out


def _bucket(threshold, miss):
    def group(table: pa.Table) -> pa.Table:
        rep, weight = table.column("rep").to_numpy(), table.column("n").to_numpy()
        side, table_no = table.column("side").to_numpy(), table.column("tbl")[0].as_py()
        dim, classes = table.column("dim")[0].as_py(), table.column("classes")[0].as_py()
        flat = np.concatenate([c.flatten().to_numpy() for c in table.column("embedding").chunks])
        vectors = flat.astype(np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)
        factor = table.column("factor").to_numpy()
        bits, tables = plan_tables(classes, threshold, miss)
        earlier = None
        if table_no:
            earlier = keys(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), bits, tables)[:, :table_no]
        same = side[0] == 2
        left = np.arange(len(rep)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        count = np.zeros(len(rep), np.int64)

        def pairs():
            for a, b in linked_pairs(vectors, codes, factor, left, right, threshold):
                if earlier is not None:
                    new = ~(earlier[a] == earlier[b]).any(1)
                    a, b = a[new], b[new]
                np.add.at(count, a, weight[b])
                if not same:
                    np.add.at(count, b, weight[a])
                yield a, b
        links = spanning(len(rep), pairs())
        some = np.flatnonzero(count)
        a = np.concatenate([rep[some], rep[[x for x, _ in links]] if links else rep[:0]])
        b = pa.array([None] * len(some) + [int(rep[y]) for _, y in links], pa.int64())
        n = pa.array([*count[some].tolist(), *[0] * len(links)], pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": n})
    return group


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with the pair of blocks in which they are compared: a bucket of
    up to BLOCK rows is one block; in a larger one each block meets itself
    (side 2) and every other (sides 0 and 1)."""
    where = ["label", "dim", "tbl", "bucket"]
    large = materialise(rows.groupBy(*where).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK), narrow=True)
    if large.isEmpty():
        return rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    rows = rows.join(large, where, "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    names = [c for c in rows.columns if c not in ("size", "blocks")]
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        *names, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, miss: float = 1e-4, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    e = F.col("embedding")
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    table = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"),
                           F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)
    table = materialise(table.withColumn("usable", F.coalesce(usable, F.lit(False))))
    good = table.where("usable")
    classes = good.groupBy("label", "embedding").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = classes.withColumn("dim", F.size("embedding").cast("long"))
    classes = materialise(classes.mapInArrow(_coded, schema_with(classes, "code binary, factor double")), narrow=True)
    sizes = materialise(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("classes")), narrow=True)
    rows = classes.join(sizes, ["label", "dim"]).select(
        "rep", "n", "label", "embedding", "dim", "classes", "code", "factor")
    label = dict(rows.dtypes)["label"]
    rows = materialise(rows.where("classes > 1").mapInArrow(
        _rows(threshold, miss), f"rep long, n long, label {label}, embedding {kind}, dim long, classes long, "
        "code binary, factor double, tbl int, bucket long"))
    found = materialise(_blocks(rows).groupBy("label", "dim", "tbl", "bucket", "i", "j").applyInArrow(
        _bucket(threshold, miss), "a long, b long, n long"), narrow=True)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "rep")
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    classes = classes.join(counts, "rep", "left").join(roots, "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("root"))
    members = materialise(good.join(materialise(classes, narrow=True), ["label", "embedding"])
                          .select("row", "vec_id", "n_links", "root"), narrow=True)
    ids = materialise(members.groupBy("root").agg(F.min("vec_id").alias("component_id")), narrow=True)
    members = members.join(ids, "root").select("vec_id", "n_links", "component_id")
    alone = table.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
