import hashlib
import random
from collections import Counter

from meshwork.llm import suffix_dedup
from meshwork.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, bucket int, k string"


def brute(rows, length=200):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line, base = say(80), say(18), say(200)
    rows = [(i, say(rng.randint(0, 150)), 1, "x") for i in range(60)]
    for i in range(60, 130):
        rows.append((i, say(rng.randint(0, 60)) + passage[rng.randint(0, 90):] + say(5) + line, 1, "x"))
    for i in range(130, 170):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "XX"
        rows.append((i, " ".join(w), 1, "x"))
    rows += [(170, "a" * 500, 1, "x"), (171, "ab" * 400, 1, "x"), (172, "a" * 199, 1, "x"), (173, None, 1, "x"),
             (174, "", 1, "x"), (175, rows[0][1], 1, "x"), (175, rows[0][1], 1, "x"), (None, say(70), 1, "x"),
             (176, "Oneaea " * 60, 2, None), (177, "Oneaea " * 45, 2, None), (178, rows[3][1][:200], 1, "x")]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert result(got) == brute(rows)


def test_long_text_is_cut_into_parts(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(suffix_dedup, "PART", 300)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 12)
    from meshwork.llm.suffix_dedup import _parts, bucket_ids, runs
    import numpy as np
    data = np.frombuffer(("x".join(r[1] or "" for r in rows)).encode()[:5000], np.uint8)
    seen = set()
    for part, offsets, row, before in _parts(data, np.array([0, len(data)]), 200):
        first, last, _ = runs(offsets, bucket_ids(part), 200)
        for a, b in zip(first + before, last + before):
            seen.update(range(a, b + 1))
    assert seen == set(range(len(data) - 199))


def test_spans_rebuild_the_kept_bytes(spark):
    rows = corpus(4)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), keep_bytes=True).collect():
        kept, at = b"", 0
        for s in r.spans:
            kept, at = kept + text[r.doc_id][at:s.start], s.end
        assert kept + text[r.doc_id][at:] == bytes(r.kept)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
