import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from meshwork.llm import tokens as tokens_module
from meshwork.llm.packing import Levels, pack
from meshwork.llm.tokens import WordTokens, tokenizer_path

SCHEMA = "doc_id long, text string, start string, length int"


def corpus(seed=0):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCÄÖÜßéèñçøþµªº0123456789²½" + "...,!?#$%&*|()-'\"/_@+=~^`<>"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    space = [" ", "\n", "\t", "  ", "\xa0", "\x85", "\x0b", "\x0c", "\r\n"]
    texts = ["".join(word() + rng.choice(space) for _ in range(rng.choice([0, 1, 5, 60, 300, 2500]))) for _ in range(120)]
    texts += ["", None, "it's we're I'm don't they'll 'tis rock'n'roll's", "A<|endoftext|>b", "a\x1cb\x1fc",
              "日本語 テスト", "é", "İstanbul ΣΑΣ ǅ", "a" * 9000, "x " * 20000, "!!! *** &&&", "--a-- 'b' \"c\"",
              "!'s", ".'ll.", "a.'s", "e \u0301a e\u0301 A\u030a", "a\0b \0 \0\0 c", "\u2028x\u3000y\xa0z", " x　y", "\x00\x01a"]
    return [(i, t, "q", 1) for i, t in enumerate(texts)] + [(None, "null id", "q", 1), (3, "again", "q", 1), (3, "again", "q", 1)]


@pytest.mark.parametrize("known", [10**6, 50])
def test_known_words_give_the_tokenizers_ids(monkeypatch, known):
    monkeypatch.setattr(tokens_module, "KNOWN_WORDS", known)
    tokens = WordTokens(tokenizer_path("word_bpe_49k.json"))
    texts = [t or "" for _, t, _, _ in corpus(1)]
    for lo in range(0, len(texts), 10):
        raw = [t.encode() for t in texts[lo:lo + 10]]
        ids, starts = tokens.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for t, a, b in zip(texts[lo:lo + 10], starts[:-1], starts[1:]):
            assert ids[a:b].tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_rebuild_every_document(spark, parts):
    tokens = WordTokens(tokenizer_path("word_bpe_49k.json"))
    rows = [r for r in corpus() if r[0] not in (None, 3)]
    out = pack(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text, _, _ in rows:
        pieces = sorted(docs[i], key=lambda r: r.start)
        ids = [x for p in pieces for x in p.ids]
        assert ids == tokens.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        sizes = [p.length for p in pieces]
        assert [p.offset for p in pieces] == np.cumsum([0] + sizes)[:-1].tolist()
        assert sum(sizes).bit_count() == 1 and sum(sizes) <= 4096  # nothing is padded


def test_level_choice_is_the_least_sum_of_squares():
    rng = random.Random(5)
    levels, n = Levels(32), 0
    for _ in range(3000):
        size = rng.randint(1, 31)
        count = levels.count.copy()

        def cost(h):
            after = count.copy()
            if h:
                after[h] -= 1
            if h + size < 32:
                after[h + size] += 1
            return int((after[1:32] ** 2).sum())
        possible = [0] + [h for h in range(1, 33 - size) if count[h]]
        assert cost(levels.choose(size)) == min(map(cost, possible))
        levels.place(size, lambda: n)
        assert levels.count[1:32].tolist() == [len(x) for x in levels.at[1:32]]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = corpus()
    out = pack(spark.createDataFrame(rows, SCHEMA), with_ids=False).collect()
    assert sum(1 for r in out if r.doc_id is None and r.start == 0) == 1
    assert sum(r.start == 0 for r in out) == len(rows)
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
