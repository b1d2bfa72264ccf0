"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE vocabulary.

* The *splitter* reads classes of code points.  A transition says whether a word
  starts at this code point and whether one starts at the code point before (known
  late for white space and contractions).  A text is cut into chunks; for every chunk
  the map from each entry state to its exit state is computed, all chunks in step;
  the maps compose through a parallel prefix scan, which gives each chunk's true
  entry state, and a second pass reads off the starts.
* The *counter* reads the bytes of one word.  Its state is the set of vocabulary
  prefixes that are still open, each with the last token before it and the count
  there relative to now; a transition carries the change in the count of tokens.
  States and transitions are compiled when first met, and kept.

Nulls and empty texts count 0 tokens.  Special strings inside a text count one token,
as the library's default has it.  Texts are read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.bpe import BoundedCache, Vocabulary, letter_classes, vocabulary
from textloom.llm.common import arrow_map, over_slices

CHUNK = 256
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, STMD, R, V, L, E, STOP = range(12)
(START, WORD, DIGITS, MARKS, TICK, TICK_R, TICK_V, TICK_L, BLANK, BLANKS, GAP, GAPS) = range(12)
HERE, BEFORE = 1, 2  # a word starts at this code point; at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start marks for every state and class."""
    state = np.zeros((12, 12), np.uint8)
    marks = np.zeros((12, 12), np.uint8)
    kind = {LETTER: WORD, STMD: WORD, R: WORD, V: WORD, L: WORD, E: WORD, NUMBER: DIGITS, OTHER: MARKS, QUOTE: MARKS}
    fresh = kind | {QUOTE: TICK, SPACE: BLANK, WHITE: GAP}
    for s in range(12):
        for c in range(11):
            state[s, c], marks[s, c] = fresh[c], HERE  # unless a word goes on
        state[s, STOP] = START
        for c, to in kind.items():
            if s in (WORD, DIGITS, MARKS) and to == s:
                state[s, c], marks[s, c] = s, 0
            if s in (BLANK, BLANKS):  # the last space belongs to what follows
                state[s, c], marks[s, c] = to, BEFORE if s == BLANKS else 0
            if s == GAPS:
                marks[s, c] = HERE | BEFORE
            if s in (TICK_R, TICK_V, TICK_L):  # no contraction after all: its letter starts a word
                state[s, c], marks[s, c] = (WORD, BEFORE) if to == WORD else (fresh[c], HERE | BEFORE)
        if s in (BLANK, BLANKS, GAP, GAPS):
            for c, to in ((SPACE, BLANKS), (WHITE, GAPS)):
                state[s, c], marks[s, c] = to, 0
        if s in (TICK_R, TICK_V, TICK_L):
            for c in (SPACE, WHITE):
                marks[s, c] = HERE | BEFORE
            marks[s, STOP] = BEFORE
    for c in (OTHER, QUOTE):
        state[TICK, c], marks[TICK, c] = MARKS, 0
    state[TICK, STMD], marks[TICK, STMD] = START, 0
    for c, to in ((R, TICK_R), (V, TICK_V), (L, TICK_L)):
        state[TICK, c], marks[TICK, c] = to, 0
    for s, c in ((TICK_R, E), (TICK_V, E), (TICK_L, L)):
        state[s, c], marks[s, c] = START, 0
    return state, marks


@lru_cache(1)
def _point_classes() -> np.ndarray:
    known = letter_classes()
    table = np.full(0x110001, OTHER, np.uint8)
    for kind, to in ((1, LETTER), (2, NUMBER), (3, WHITE)):
        table[:0x110000][known == kind] = to
    for chars, to in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in chars]] = to
    table[0x110000] = STOP
    return table


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each place of a sequence of classes, which begins as after STOP."""
    state, marks = _splitter()
    n = len(classes)
    lanes = -(-(n + 1) // CHUNK)
    padded = np.full(lanes * CHUNK, STOP, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)  # one row of the grid for each step
    flat = state.ravel()
    maps = np.broadcast_to(np.arange(12, dtype=np.uint8), (lanes, 12)).copy()
    for row in grid:  # every chunk's map, all chunks in step
        maps = flat[maps * np.uint8(12) + row[:, None]]
    step = 1
    while step < lanes:  # inclusive prefix scan under composition
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    now = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((CHUNK, lanes), np.uint8)
    flat_marks = marks.ravel()
    for k, row in enumerate(grid):
        at = now * np.uint8(12) + row
        out[k] = flat_marks[at]
        now = flat[at]
    said = out.T.ravel()
    starts = (said[:n] & HERE) > 0
    starts |= (said[1 : n + 1] & BEFORE) > 0
    return starts


class CountTransducer:
    """Counts the tokens of single words, compiled as needed and rebuilt when it has ``most`` states."""

    def __init__(self, v: Vocabulary, most: int = 60_000):
        self.fits, self.most = v.fits, most
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for raw, i in v.ids.items():
            if i in v.special.values():
                continue
            node = 0
            for b in raw.encode("latin-1"):
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self._clear()

    def _clear(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.open, self.next = {first: 0}, [first], [{}]

    def _compile(self, s: int, b: int) -> tuple[int, int]:
        opened, change, last = [], 0, -1
        for node, before, count in self.open[s]:
            to = self.children[node].get(b)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and last < 0 and (before < 0 or self.fits(before, t)):
                last, change = t, count + 1
            if self.children[to]:
                opened.append((to, before, count))
        if last < 0:
            raise ValueError("the vocabulary cannot spell this word")
        key = (*((node, before, count - change) for node, before, count in opened), (0, last, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.open)
            self.open.append(key)
            self.next.append({})
        self.next[s][b] = to, change
        return to, change

    def __call__(self, word: bytes) -> int:
        if len(self.open) > self.most:
            self._clear()
        s = total = 0
        table = self.next
        for b in word:
            step = table[s].get(b)
            s, change = step if step is not None else self._compile(s, b)
            total += change
        return total


@lru_cache(2)
def _tools(path: str):
    v = vocabulary(path)
    special = re.compile("|".join(map(re.escape, v.special)) or "(?!)")
    return BoundedCache(CountTransducer(v)), special


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text under the byte-level vocabulary at ``path``."""
    counts, special = _tools(path)
    extra = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        if "<|" in text:
            pieces = special.split(text)
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        else:
            parts.append(text)
            owner.append(i)
    points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in parts]
    sizes = np.array([len(p) for p in points], np.int64)
    ends = np.cumsum(sizes + 1)
    total = int(ends[-1]) if len(ends) else 0
    if not sizes.sum():
        return extra
    whole = np.full(total, 0x110000, np.uint32)
    keep = np.ones(total, bool)
    keep[ends - 1] = False
    whole[keep] = np.concatenate(points)
    starts = word_starts(_point_classes()[whole])
    starts[~keep] = False
    width = np.ones(total, np.int8)
    for limit in (0x80, 0x800, 0x10000):
        width += whole >= limit
    width[~keep] = 0
    at = np.cumsum(width, dtype=np.int64) - width
    where = np.flatnonzero(starts)
    data = "".join(parts).encode()
    offsets = np.append(at[where], len(data)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    each = np.array([counts[w] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    part = np.searchsorted(ends, where, side="right")
    return extra + np.bincount(np.array(owner)[part], each, len(texts)).astype(np.int64)


def with_token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of every row.

    A null text counts as empty; repeated rows are each counted; other columns are not read.
    """
    kept = docs.select(key, text)
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batch: pa.RecordBatch) -> list:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = count_tokens(texts, path)
        return [batch.column(0), [len(t.encode()) for t in texts], n, n > limit]

    return arrow_map(kept, over_slices(count, schema, text), f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")
