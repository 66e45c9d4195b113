import hashlib
import random
import re

from meshwork.llm import decontaminate as D

SCHEMA = "doc_id long, text string, n_words string, items int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def brute(docs, bench, k=13):
    out = []
    for d in docs:
        w = words(d[1])
        hit, items = set(), set()
        for item, text in bench:
            b = words(text)
            wins = [b[i:i + k] for i in range(len(b) - k + 1)] if len(b) >= k else ([b] if b else [])
            for win in wins:
                for i in range(len(w) - len(win) + 1):
                    if w[i:i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        items.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d[0], len(w), len(hit), len(items), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéA9") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    say = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(vocab) for _ in range(n))
    bench = [(i, say(rng.randint(13, 40))) for i in range(25)]
    bench += [(100, say(5)), (101, vocab[0] + " " + vocab[1]), (102, ""), (103, None), (104, "..."), (None, say(20)),
              (3, say(15)), (105, bench[0][1]), (106, " ".join([vocab[2]] * 16))]
    docs = []
    for i in range(150):
        t = say(rng.randint(0, 60))
        if rng.random() < 0.6:
            b = re.split(r"[ ,\-\n]+", rng.choice(bench)[1] or "")
            a = rng.randint(0, 6)
            t += " " + " ".join(b[a:]).upper() + "; " + say(rng.choice([2, 30, 300]))
        docs.append((i, t, "x", 1))
    docs += [(200, None, "x", 1), (201, "", None, 1), (None, bench[0][1], "x", None), (5, docs[5][1], "x", 1),
             (5, docs[5][1], "x", 1), (202, " ".join([vocab[2]] * 40), "x", 1), (203, "a" * 5000, "x", 1)]
    return docs, bench


def result(df):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def frames(spark, docs, bench):
    return (spark.createDataFrame(docs, SCHEMA).repartition(3).select("doc_id", "text"),
            spark.createDataFrame(bench, "item_id long, text string"))


def test_against_brute_force(spark):
    docs, bench = corpus()
    assert result(D.find_contamination(*frames(spark, docs, bench))) == brute(docs, bench)
    # longer windows only: the lead has four words then
    long_only = [b for b in bench if len(words(b[1])) >= 13]
    assert result(D.find_contamination(*frames(spark, docs, long_only))) == brute(docs, long_only)


def test_tests_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "TEST_BYTES", 1500)
    docs, bench = corpus(1)
    assert result(D.find_contamination(*frames(spark, docs, bench))) == brute(docs, bench)


def test_longest_matches_are_verbatim(spark):
    docs, bench = corpus(2)
    items = {}
    for i, t in bench:
        items.setdefault("" if i is None else str(i), []).append(words(t))
    for r in D.find_contamination(*frames(spark, docs, bench)).collect():
        w = words(r.text)
        for m in r.matches:
            got = w[m.doc_word:m.doc_word + m.n_words]
            assert any(b[m.item_word:m.item_word + m.n_words] == got for b in items[m.item_id])


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, bench = corpus(3)
    df = spark.createDataFrame(docs, SCHEMA)
    kept = D.decontaminate(df, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == df.columns
    clean = sum(not r[5] for r in brute(docs, bench))
    assert kept.count() == clean


def test_empty_tables(spark):
    docs, bench = frames(spark, *corpus(4))
    assert D.find_contamination(docs.limit(0), bench).count() == 0
    assert D.find_contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
