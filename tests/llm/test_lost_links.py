import math

import numpy as np
import pytest

from meshwork.llm import embedding_dedup as E


@pytest.mark.parametrize("classes", [257, 6000, 10**6, 10**9])
@pytest.mark.parametrize("threshold", [0.8, 0.93, 0.99])
def test_less_than_one_lost_link_is_expected(classes, threshold):
    bits, tables = E.plan_tables(classes, threshold, 1e-4)
    miss = (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** tables
    assert bits and miss <= 1e-4 and miss * classes * (classes - 1) / 2 < 1


def test_recall_on_a_large_label_against_brute_force(spark):
    """Recall of all links of one label; prints the figures."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((2000, 48))
    x = (np.repeat(base, 4, 0) + rng.standard_normal((8000, 48)) * rng.choice([0.1, 0.25, 0.3], (8000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.array([int(np.count_nonzero(unit[i] @ unit.T >= 0.93)) - 1 for i in range(len(x))])
    found = np.array([got[i] for i in range(len(x))])
    print(f"links found {found.sum() // 2} of {want.sum() // 2}")
    assert (found <= want).all() and want.sum() > 2000 and (want - found).sum() <= 2
