"""Token ids of texts by public tokenizers, with a table of known words."""
from __future__ import annotations

import re

import numpy as np

from .common import LOWER, span_ids, word_spans

#: Words remembered by a task (about 30 bytes each).
KNOWN_WORDS = 4_000_000

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?#$%&*|()\"-'")] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokens:
    """Ids by a ``tokenizers`` file that ignores case and whose pieces never
    hold ASCII white space, nor punctuation after a letter or digit: the ids
    of a text are then those of its words (cut at both), one after the other.
    Words are looked up by a 64-bit identifier; new ones go to the tokenizer.
    Special tokens respect case, so words that hold one in any case have the
    identifier of their own bytes, all others that of their lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a word that only stands between others
        self.between = self._encode("\0")
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode_words(self, words: list[str]):
        """(ids of all words, number of ids of each)."""
        counts = np.zeros(len(words), np.int64)
        kind = np.array([0 if w.isalpha() and max(w) < "\u0100" else 2 if "\0" in w else 1 for w in words], np.int8)
        parts = []
        # Latin letters only: one piece, so each ends with an end-of-word token
        own = np.flatnonzero(kind == 0)
        ids = self._encode(" ".join([words[i] for i in own.tolist()]))
        counts[own] = np.diff(np.concatenate([[0], np.flatnonzero(self.word_end[ids]) + 1]))
        parts.append((own, ids))
        own = np.flatnonzero(kind == 1)
        if len(own) and len(self.between) == 1:
            ids = self._encode(" \0 ".join([words[i] for i in own.tolist()]))
            cut = np.flatnonzero(ids == self.between[0])
            counts[own] = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            parts.append((own, ids[ids != self.between[0]]))
        rest = np.flatnonzero(kind == 2) if len(self.between) == 1 else np.flatnonzero(kind > 0)
        for i in rest.tolist():
            ids = self._encode(words[i])
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        start = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for own, ids in parts:
            out[_ranges(start[own], counts[own])] = ids
        return out, counts

    def _learn(self, keys, words):
        ids, counts = self.encode_words(words)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(counts) - counts)
        self.length = np.insert(self.length, at, counts)
        self.used += len(ids)

    def _folded(self, data, start, stop):
        """The bytes in lower case, but for words that hold a special token
        in any case."""
        folded = LOWER[data]
        text = folded.tobytes()
        for special in {s.lower() for s in self.special}:
            if special and special in text:
                at = np.array([m.start() for m in re.finditer(re.escape(special), text)])
                word = np.unique(np.searchsorted(start, at, side="right") - 1)
                own = _ranges(start[word], stop[word] - start[word])
                folded[own] = data[own]
        return folded

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all texts, where each text's ids start) of a block of
        UTF-8 texts."""
        raw = data.tobytes()
        # no piece goes on from an ASCII letter or digit to punctuation
        cut = None if any(s in raw for s in self.special) else _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
        start, stop = word_spans(data, offsets, cut)
        words = np.diff(np.searchsorted(start, offsets))
        keys, first, which = np.unique(span_ids(self._folded(data, start, stop), start, stop), return_index=True, return_inverse=True)
        for attempt in range(2):
            at = np.searchsorted(self.keys, keys)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == keys[known]
            if known.all():
                break
            if len(self.keys) + np.count_nonzero(~known) > KNOWN_WORDS:
                self._forget()
                known[:] = False
            new = first[~known]
            self._learn(keys[~known], [raw[a:b].decode() for a, b in zip(start[new].tolist(), stop[new].tolist())])
        length = self.length[at][which]
        ids = self.ids[_ranges(self.start[at][which], length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids, ends[np.concatenate([[0], np.cumsum(words)])]


def _ranges(start, length):
    """The numbers of all ranges start..start+length, one after the other."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + length, length)
