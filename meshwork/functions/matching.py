"""Which of many keys lie in a text, and which hold it, in one pass.

``KeyMatcher`` holds the keys as an Aho-Corasick automaton (keys inside a
text: time linear in the text and the matches, however long its words are)
and the keys' short pieces as a table (keys around a phrase: only keys that
hold the phrase's first characters are looked at). It runs inside tasks on
Arrow batches; its size is that of the keys, which ``checked_keys`` bounds.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all keys and terms that a task may hold: about a hundred
#: thousand keys and half a gigabyte. A glossary beyond it is refused, not cut.
MAX_KEY_CHARS = 2_000_000
_PIECE = 6
#: Words whose matches a task remembers before it starts afresh.
_REMEMBERED = 200_000


def checked_keys(index: DataFrame) -> list:
    """The rows (key, term, key_order) of a term index, whose size is checked
    before they are read on the driver."""
    rows = index.where("key is not null").select("key", "term", "key_order")
    size = rows.agg(F.sum(F.length("key") + F.length(F.coalesce("term", F.lit(""))))).first()[0] or 0
    if size > MAX_KEY_CHARS:
        raise ValueError(f"keys and terms of a glossary may have {MAX_KEY_CHARS} characters in all")
    return sorted(tuple(r) for r in rows.collect())


class KeyMatcher:
    def __init__(self, keys):
        import ahocorasick
        self.keys = list(dict.fromkeys(keys))
        self.exact = {k: i for i, k in enumerate(self.keys)}
        self.longest = max(map(len, self.keys), default=0)
        self.empty = (self.exact[""],) if "" in self.exact else ()
        self.pieces: dict[str, list[int]] = {}
        self.all, self.spaced = ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, k in enumerate(self.keys):
            for piece in {k[a:a + n] for a in range(len(k)) for n in range(1, _PIECE + 1)}:
                self.pieces.setdefault(piece, []).append(i)
            if k:
                self.all.add_word(k, (i, len(k)))
            if " " in k:
                self.spaced.add_word(k, (i, len(k)))
        for a in (self.all, self.spaced):
            if len(a):
                a.make_automaton()
        self.words: dict[str, tuple | None] = {}

    def inside(self, text: str) -> tuple:
        """Keys that lie in the text."""
        if not len(self.all):
            return self.empty
        return (*self.empty, *{i for _, (i, _) in self.all.iter(text)})

    def around(self, phrase: str) -> list:
        """Keys that hold the phrase."""
        if not phrase:
            return list(range(len(self.keys)))
        if len(phrase) > self.longest:
            return []
        found = self.pieces.get(phrase[:_PIECE], [])
        return found if len(phrase) <= _PIECE else [i for i in found if phrase in self.keys[i]]

    def match(self, phrase: str):
        """The equal key, else all keys around and inside the phrase."""
        equal = self.exact.get(phrase)
        return (equal,) if equal is not None else (*self.around(phrase), *self.inside(phrase))

    # -- texts of words, phrase by phrase -----------------------------------------

    def _word(self, word):
        """(keys around, keys inside) of a word; None without any."""
        if word not in self.words:
            if len(self.words) >= _REMEMBERED:
                self.words.clear()
            around, inside = self.around(word), self.inside(word)
            self.words[word] = (around, inside) if around or inside else None
        return self.words[word]

    def _spanning(self, text, words):
        """First word -> (last word, key) of the keys with spaces that lie in
        a text of words joined by single spaces."""
        if not len(self.spaced):
            return {}
        found, first, at, places = {}, 0, 0, sorted((e - n + 1, e, i) for e, (i, n) in self.spaced.iter(text))
        if not places:
            return found
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        from bisect import bisect_right
        for s, e, i in places:
            a = bisect_right(starts, s, first) - 1
            b = bisect_right(starts, e, a) - 1 + (text[e] == " ")
            first = a
            found.setdefault(a, []).append((b, i))
        return found

    def first_matches(self, text: str, max_len: int, enough=None) -> dict:
        """Key -> (word, length) of the first phrase of 1 to ``max_len`` words
        (by first word, then length) that the key matches as in ``match``.
        ``text``: words joined by single spaces. Ends early when ``enough``
        (found so far -> bool) says so."""
        words = text.split(" ") if text else []
        known = [self._word(w) for w in words]
        spanning = self._spanning(text, words)
        found: dict[int, tuple] = {}
        todo = sorted({i for j, k in enumerate(known) if k for i in range(max(j - max_len + 1, 0), j + 1)}
                      | {i for a in spanning for i in range(max(a - max_len + 1, 0), a + 1)})
        for i in todo:
            before = len(found)
            for n in range(1, min(max_len, len(words) - i) + 1):
                part = known[i:i + n]
                keys = []
                if all(k and k[0] for k in part):  # only such phrases lie in a key
                    phrase = " ".join(words[i:i + n])
                    equal = self.exact.get(phrase)
                    if equal is not None:
                        found.setdefault(equal, (i, n))
                        continue
                    keys += part[0][0] if n == 1 else self.around(phrase)
                for k in part:
                    if k:
                        keys += k[1]
                if spanning:
                    keys += [key for a in range(i, i + n) for b, key in spanning.get(a, ()) if b < i + n]
                for key in keys:
                    found.setdefault(key, (i, n))
            if enough and len(found) > before and enough(found):
                break
        return found


@lru_cache(maxsize=2)
def matcher(keys: tuple) -> KeyMatcher:
    """One matcher per Python worker and glossary."""
    return KeyMatcher(keys)
