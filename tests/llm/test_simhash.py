import random
import re

import numpy as np
import pytest
import xxhash

from meshwork.llm import simhash
from meshwork.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, root int"


def brute_print(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows, k=3):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= k:
                comp[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", ids.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéÉXY") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(0, 40)), "z", 1) for i in range(150)]
    base = [rng.choice(words) for _ in range(400)]
    for i in range(150, 260):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "QQ"
        rows.append((i, rng.choice([" ", "\n", "\t\x0b"]).join(w), "z", None))
    rows += [(260, None, "z", 1), (261, "", None, 1), (262, " \n", None, 1), (263, "One", "", 2), (264, "oNE", "", 2),
             (None, "one", "", 3), (5, rows[5][1], "", 4), (5, rows[5][1], "", 4), (265, "a\xa0b \x1c c", "", 1),
             (None, say(30), "", 1)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(simhash.near_duplicates(df)) == brute(rows)


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    monkeypatch.setattr(simhash, "FEW", 30)
    rows = corpus(1)
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("k", [0, 1, 3, 5])
def test_links_for_other_distances(spark, k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for n in range(1, 8):
            x = int(b)
            for bit in rng.choice(63, n, replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    want = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= k}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    pairs = [(r.a, r.b) for r in simhash.links(df, k).collect()]
    assert {frozenset(p) for p in pairs} <= want
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        up[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in map(tuple, want))


def test_components_of_chain_star_and_copies(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (1, 0), (0, 1)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r.node: r.root for r in out}
    assert len(out) == len(root) == 201 + 200
    assert len({root[i] for i in range(201)}) == 1 and len({root[i] for i in range(1000, 1200)}) == 1
    assert root[0] != root[1000] and all(root[r] == r for r in root.values())


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = sorted({c for _, _, c in brute(rows) if c is not None})
    assert ids == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
