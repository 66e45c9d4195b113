import numpy as np
import pytest

from meshwork.llm.tokens import WordTokens, tokenizer_path

TEXTS = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|EndOfText|>", "x<|endoftext|>Y x<|ENDOFTEXT|>Y X<|endoftext|>y",
         "<|startoftext|> <|STARTOFTEXT|> <|STARTOFTEXT|>.", "", "Word, WORD word"]


@pytest.mark.parametrize("order", [1, -1])
@pytest.mark.parametrize("size", [1, 2, 7])
def test_special_tokens_respect_case(order, size):
    tokens = WordTokens(tokenizer_path("word_bpe_49k.json"))
    texts = TEXTS[::order]
    for lo in range(0, len(texts), size):
        raw = [t.encode() for t in texts[lo:lo + size]]
        ids, starts = tokens.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for t, a, b in zip(texts[lo:lo + size], starts[:-1], starts[1:]):
            assert ids[a:b].tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_special_token_across_two_texts_is_none():
    tokens = WordTokens(tokenizer_path("word_bpe_49k.json"))
    raw = [b"A <|ENDOF", b"TEXT|> B"]
    ids, starts = tokens.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, a, b in zip(raw, starts[:-1], starts[1:]):
        assert ids[a:b].tolist() == tokens.tokenizer.encode(t.decode(), add_special_tokens=False).ids
