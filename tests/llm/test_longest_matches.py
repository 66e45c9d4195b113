"""Longest matches against brute force, and repetitive texts."""
import random
import time

import numpy as np
import pytest

from meshwork.llm.decontaminate import Tests, _longest, _merge, word_ids


def chains(items, text, window):
    """Maximal runs of equal words on every diagonal that hold a window (a
    shorter item: all its words)."""
    out, w = set(), text.split()
    for name, item in items:
        b = item.split()
        for d in range(-len(b) + 1, len(w)):
            run = None
            for j in range(len(b) + 1):
                same = j < len(b) and 0 <= d + j < len(w) and b[j] == w[d + j]
                if same and run is None:
                    run = j
                if not same and run is not None:
                    if j - run >= window or (len(b) < window and j - run == len(b)):
                        out.add((name, run, d + run, j - run))
                    run = None
    return out


def found(items, text, window):
    tests = Tests(items, window)
    data = text.encode()
    ids, counts = word_ids(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    got = _longest(tests, *tests.matches(ids, counts))
    rows = [(m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in got]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(6))
def test_matches_are_the_longest_runs(seed):
    rng = random.Random(seed)
    for _ in range(30):
        letters = rng.choice(["ab", "a", "abc"])
        say = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(f"i{k}", say(rng.randint(1, 9))) for k in range(rng.randint(1, 4))]
        text = say(rng.randint(0, 25))
        assert found(items, text, 3) == chains(items, text, 3), (items, text)


def test_half_a_million_equal_words(spark):
    from meshwork.llm import decontaminate as D
    docs = spark.createDataFrame([(1, "same " * 500_000), (2, "same " * 40)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "same " * 500)], "item_id string, text string")
    t0 = time.time()
    out = {r.doc_id: r for r in D.find_contamination(docs, bench, located=False).collect()}
    assert out[1].n_hit == out[1].n_words == 500_000 and out[1].items == ["a"] and out[2].n_hit == 40
    assert time.time() - t0 < 20
    assert found([("a", "x " * 40)], "x " * 3000, 13) == chains([("a", "x " * 40)], "x " * 3000, 13)


def test_ranges_are_merged():
    rng = random.Random(1)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 5)) for a in (rng.randint(0, 30) for _ in range(rng.randint(1, 8)))]
        first, last = _merge(np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
        covered = {x for a, b in spans for x in range(a, b)}
        assert {x for a, b in zip(first, last) for x in range(a, b)} == covered
        assert all(b < a for b, a in zip(last[:-1], first[1:]))
