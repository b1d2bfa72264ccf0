"""Exact byte-pair encoding: vocabulary, linear-time encoder, offset-table decoder.

The encoder never replays merges.  An Aho-Corasick automaton over the vocabulary
reports every token at every place of a word; tokens are then taken longest first
and kept only if the pair with the token before is one that merging could leave
standing (the pair-compatibility table, filled on demand).  A dead end clears a bit
for its position, so that each position fails at most once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from weakref import WeakSet

import ahocorasick
import numpy as np

END = "Ā"  # stands for the end-of-word mark in byte strings kept as latin-1 text


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


# The capitals of Unicode 16 that Python 3.13's tables do not lower yet.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
NEWER = re.compile("[%s]" % "".join(map(chr, NEWER_LOWER))).search


class Vocabulary:
    """Tokens and merges of a ``tokenizers`` file whose ids are in merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {letter: chr(b) for b, letter in enumerate(byte_letters())}
        self.written = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        self.raw = [""] * len(self.written)
        for token, i in model["vocab"].items():
            self.written[i] = token
            body, end = (token[: -len(self.suffix)], END) if self.suffix and token.endswith(self.suffix) else (token, "")
            self.raw[i] = "".join(to_byte[c] for c in body) + end
        for token, i in self.special.items():
            self.written[i] = token
        self.ids = {raw: i for i, raw in enumerate(self.raw) if raw}
        self.merge: dict[tuple[int, int], int] = {}
        n = len(self.written)
        self.left, self.right = list(range(n)), list(range(n))
        last = -1
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = model["vocab"][a + b]
            if made <= last:
                raise ValueError("the vocabulary's ids must follow its merges")
            last = made
            x, y = model["vocab"][a], model["vocab"][b]
            self.merge[x, y], self.left[made], self.right[made] = made, x, y
        self._fits: dict[int, bool] = {}

    def fits(self, one: int, two: int) -> bool:
        """Whether merging a text can leave ``one`` and ``two`` side by side."""
        key = one << 32 | two
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[key] = self._stand(one, two)
        return known

    def _stand(self, one: int, two: int) -> bool:
        # Undo the merges on both sides of the border, the later one first; the pair falls
        # if a merge across the border would have come before the one just undone.
        limit = len(self.written)
        while True:
            across = self.merge.get((one, two))
            if across is not None and across < limit:
                return False
            if one > two and self.right[one] != one:
                limit, one = one, self.right[one]
            elif self.left[two] != two:
                limit, two = two + 1, self.left[two]
            elif self.right[one] != one:
                limit, one = one, self.right[one]
            else:
                return True


class Encoder:
    """Backtracking encoder of single words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for raw, i in vocabulary.ids.items():
            self.automaton.add_word(raw, (len(raw), i))
        self.automaton.make_automaton()

    def __call__(self, raw: str) -> list[int]:
        """The ids of ``raw``, one word's bytes as latin-1 text, with ``END`` where the vocabulary marks ends."""
        whole = self.vocabulary.ids.get(raw)
        if whole is not None and self._whole(whole):
            return [whole]
        n, fits = len(raw), self.vocabulary.fits
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(raw):
            at[end - found[0] + 1].append(found)  # by rising end, so by rising length
        left = [len(x) for x in at]  # candidates of each start not yet tried
        dead = bytearray(n + 1)
        out: list[int] = []
        starts: list[int] = []
        pos = 0
        while pos < n:
            before, taken = out[-1] if out else -1, False
            while left[pos]:
                left[pos] -= 1
                length, token = at[pos][left[pos]]
                if not dead[pos + length] and (before < 0 or fits(before, token)):
                    out.append(token)
                    starts.append(pos)
                    pos += length
                    taken = True
                    break
            if taken:
                if pos < n:
                    left[pos] = len(at[pos])
                continue
            if not out:
                raise ValueError("the vocabulary cannot spell this word")
            dead[pos] = 1
            out.pop()
            pos = starts.pop()
        return out

    def _whole(self, token: int) -> bool:
        """Whether merging the token's own text gives the token (true of all that merges make)."""
        v = self.vocabulary
        return v.left[token] == token or v.fits(v.left[token], v.right[token]) is False


class OffsetDecoder:
    """Token texts in one string, found through a table of offsets."""

    def __init__(self, vocabulary: Vocabulary):
        self.blob = "".join(vocabulary.written)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in vocabulary.written])]).tolist()

    def __call__(self, ids: list[int]) -> list[str]:
        blob, offset = self.blob, self.offset
        return [blob[offset[i] : offset[i + 1]] for i in ids]


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space (Unicode's White_Space)."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = "".join(chr(o) for o in range(0x110000) if not 0xD800 <= o < 0xE000)
    for k, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\p{White_Space}")):
        found = "".join(regex.findall(pattern, points))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k
    return table


def _ranges(top: int, *kinds: int) -> str:
    inside = np.isin(letter_classes()[:top], kinds)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))


class WordSplitter:
    """Words of the lower-cased, composed text, as the word vocabulary's own splitter takes them."""

    def __init__(self, special: dict[str, int]):
        self.latin, self.plain, self.wide = (self._pattern(top) for top in (0x100, 0x10000, 0x110000))
        self.beyond_latin, self.beyond_plane = (re.compile(f"[^\x00-{c}]").search for c in ("\xff", "\uffff"))
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.mark = special

    def __call__(self, text: str) -> list[str]:
        """Special strings come back as they stand; no word can equal one, for each of them has marks and letters."""
        if "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.mark else self._words(part)
        return out

    @staticmethod
    def _pattern(top: int):
        # The smaller a character set, the faster it is searched, so each text gets the smallest that holds it.
        letters, numbers, any_known = _ranges(top, 1), _ranges(top, 2), _ranges(top, 1, 2, 3)
        return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{any_known}]+").findall

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin(text.lower())
        text = unicodedata.normalize("NFC", text)
        if NEWER(text):
            text = text.translate(NEWER_LOWER)
        if "Σ" in text:  # str.lower() would look at the letters around it
            text = text.replace("Σ", "σ")
        text = text.lower()
        return (self.wide if self.beyond_plane(text) else self.plain if self.beyond_latin(text) else self.latin)(text)


class BoundedCache(dict):
    """Values made by ``make`` on a miss; two generations, so that frequent keys stay and memory is bounded.

    Keys longer than ``longest`` are rare and their values long, so these are not kept.  A
    worker serves one operator after another: ``forget`` empties the caches of all others.
    """

    every: WeakSet = WeakSet()
    working: str = ""

    def __init__(self, make, most: int = 120_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old, self.owner = make, most, longest, {}, BoundedCache.working
        BoundedCache.every.add(self)

    __hash__ = object.__hash__

    def __reduce__(self):
        return BoundedCache, (self.make, self.most, self.longest)

    @classmethod
    def forget(cls, working: str) -> None:
        """From now on ``working`` is at work, and what others kept is dropped."""
        cls.working = working
        for cache in list(cls.every):
            if cache.owner != working:
                cache.clear()
                cache.old = {}

    def __missing__(self, key):
        self.owner = BoundedCache.working
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(4)
def word_tools(path: str) -> tuple[WordSplitter, BoundedCache, BoundedCache]:
    """The splitter; words to their ids as little-endian bytes; words to (ids, decoded) text."""
    v = vocabulary(path)
    split, encode, decode = WordSplitter(v.special), Encoder(v), OffsetDecoder(v)
    end = END if v.suffix else ""

    def ids(word: str) -> list[int]:
        return [v.special[word]] if word in v.special else encode(word.encode().decode("latin-1") + end)

    def texts(word: str) -> tuple[str, str, int]:
        found = ids(word)
        return " ".join(map(str, found)), " ".join(decode(found)), len(found)

    return split, BoundedCache(lambda w: np.array(ids(w), "<u4").tobytes()), BoundedCache(texts)
