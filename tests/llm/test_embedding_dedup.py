import numpy as np
import pytest

from meshwork.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep int"


def brute(rows, t=0.93):
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
          for r in rows]
    links, comp = [0] * n, list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    vec = [np.array(r[1], np.float32).astype(float) if k else None for r, k in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]):
                if vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j]) >= t:
                    links[i] += 1
                    links[j] += 1
                    comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i)), r[0] is not None and r[0] == least.get(find(i)))
                   for i, r in enumerate(rows)), key=str)


def corpus(seed, n=500, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    base = rng.standard_normal((n, dim))
    for i in range(n):
        v = base[i] if i % 3 else base[i // 9 * 3] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3, 0.4])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2 if i % 5 else 7), "x", 1))
    for i in range(n, n + 60):  # a dense group, scaled copies and equal vectors
        v = base[0] + rng.standard_normal(dim) * 0.1
        rows.append((i, (v if i % 4 else base[0] * 2).astype(np.float32).tolist(), 0, "x", None))
    v = rows[0][1]
    rows += [(900, None, 0, "x", 1), (901, v, None, "x", 1), (902, [0.0] * dim, 0, "x", 1), (903, [float("nan")] * dim, 0, "x", 1),
             (904, [None, *v[1:]], 0, "x", 1), (905, v[:5], 0, "x", 1), (906, [], 0, "x", 1), (907, [float("inf"), *v[1:]], 0, "x", 1),
             (908, v, 7, "x", 1), (908, v, 7, "x", 1), (None, v, 7, "x", 1), (909, [-0.0, 1.0], 3, "x", 1), (910, [0.0, 1.0], 3, "x", 1)]
    return rows


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus(0)
    assert result(E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_many_tables_and_split_buckets(spark, monkeypatch):
    rows = corpus(1)
    monkeypatch.setattr(E, "TARGET", 16)
    monkeypatch.setattr(E, "BLOCK", 20)
    got, want = result(E.near_duplicates(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    assert np.sum([r[1] for r in got]) >= 0.999 * np.sum([r[1] for r in want])
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.99


@pytest.mark.parametrize("threshold", [0.93, 0.95])
def test_pairs_at_the_threshold_are_found(spark, threshold):
    rng = np.random.default_rng(3)
    n, dim = 3000, 64
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = threshold + 1e-4
    near = c * a + np.sqrt(1 - c * c) * b
    rows = [(i, v.astype(np.float32).tolist(), 1, "", 0) for i, v in enumerate(np.vstack([a, near]))]
    got = {r[0]: r for r in result(E.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold))}
    recall = np.mean([got[i + n][2] == got[i][2] for i in range(n)])
    assert recall >= 0.999
    assert sum(r[1] for r in got.values()) <= 2 * n + 20


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    dim = 64
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ E.rotation(dim, 0).T
    code, factor = np.sign(turned) / np.sqrt(dim), np.abs(turned).sum(1) / np.sqrt(dim)
    off = code @ turned.T / factor[:, None] - x @ x.T
    off = off[~np.eye(400, dtype=bool)]
    error = (np.sqrt((1 - factor**2) / factor**2 / (dim - 1)))[:, None].repeat(399, 1).ravel()
    assert abs(off.mean()) < 2e-3 and (np.abs(off) < 5 * error).mean() > 0.99999 and 0.9 < (off / error).std() < 1.1


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
