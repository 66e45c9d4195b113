import math

import numpy as np
import pytest

from meshwork.llm.whitening import polar_factor, spectral_components, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


def matrices():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    a = rng.normal(size=(40, 30))
    yield "random", a.T @ a
    yield "repeated", q @ np.diag([5.0] * 8 + [2.0] * 8 + [1e-3] * 8) @ q.T
    yield "identity", 3.0 * np.eye(7)
    yield "rank one", np.outer(q[0], q[0])
    yield "decades", q @ np.diag(10.0 ** -np.arange(0, 12, 0.5)) @ q.T
    yield "mean is an eigenvalue", q[:5, :5] @ np.diag([1.0, 2, 3, 4, 5]) @ q[:5, :5].T
    yield "diagonal with its mean", np.diag([1.0, 2.0, 3.0, 4.0, 5.0])
    yield "one", np.array([[4.0]])
    yield "zero", np.zeros((3, 3))
    b = rng.normal(size=(10, 64))
    yield "fewer rows than dimensions", b.T @ b


@pytest.mark.parametrize("name, v", list(matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_components_equal_a_direct_solver(name, v):
    v = (v + v.T) / 2
    values, vectors = spectral_components(v)
    scale = max(np.linalg.norm(v), 1e-300)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1], atol=1e-13 * scale * len(v))
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-12 * scale


def test_polar_factor_of_ill_conditioned_matrices():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    for least in (1e-2, 1e-8, 1e-12):
        d = np.geomspace(1, least, 20) * np.where(np.arange(20) % 3, 1, -1)
        u = polar_factor((q * d) @ q.T)
        assert np.abs(u @ u - np.eye(20)).max() < 1e-12
        assert np.abs(u - (q * np.sign(d)) @ q.T).max() < 1e-3 * 1e-12 / least + 1e-11


def brute(rows, k=16):
    """Whitening with numpy's eigenvalue solver and Python integers."""
    kept = [(i, [math.floor(64.0 * float(np.float32(c))) + 10**6 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        d = [n * a - s for a, s in zip(x, sums)]
        w = (np.array(d, float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out[i] = sum(c * c for c in d), w, values[:k] / values.sum()
    return n, out


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_equal_the_brute_force(spark, parts):
    rng = np.random.default_rng(parts)
    mix = rng.normal(size=(20, 20)) * np.geomspace(1, 0.2, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate((rng.normal(size=(300, 20)) @ mix).astype(np.float32))]
    rows += [(400 + i, rows[0][1]) for i in range(200)]
    rows += [(700, None), (701, [None] * 20), (702, [float("nan")] * 20), (703, [float("inf")] + [0.0] * 19),
             (704, [0.0] * 20), (705, [-0.001] * 20)]
    n, want = brute(rows)
    other = [(800, [1.0]), (801, [])]
    table = [(i, v, "x", 1, "c") for i, v in rows + other]
    got = whiten(spark.createDataFrame(table, SCHEMA).repartition(parts)).collect()
    assert {r.vec_id for r in got} == set(want) and len(got) == 16 * len(want)
    signs = {}
    for r in got:
        deviation, w, explained = want[r.vec_id]
        assert r.n == n and r.deviation == deviation and r.identity_error < 1e-9
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        a, b = r.whitened, w[r.component - 1]
        assert math.isclose(abs(a), abs(b), rel_tol=1e-6, abs_tol=1e-6)
        if abs(b) > 1e-3:
            assert signs.setdefault(r.component, a * b > 0) == (a * b > 0)


def test_tables_without_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], "x", 1, "c") for i in range(5)], SCHEMA)
    assert whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "x", 1, "c") for i in range(5)] + [(None, None, None, None, None)], SCHEMA)
    got = whiten(line).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, 1) for i in range(5)]


def test_very_large_entries_stay_exact(spark):
    rows = [(0, [1e14, 1.0]), (1, [-1e12, 1.0]), (2, [3.0, 2.0]), (3, [0.5, -1e300])]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
           .where("component = 1").collect()}
    limit = 2**62
    x = [[min(max(math.floor(64 * c), -limit), limit) + 10**6 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((4 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    assert got == {i: w if w < 10**38 else None for i, w in enumerate(want)}
    assert None in got.values() and any(w and w > 2**64 for w in got.values())
