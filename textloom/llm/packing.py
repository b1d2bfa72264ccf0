"""Packing of documents into sequences of bounded length.

Tokens are counted once, row by row, and each document becomes pieces of at most
``capacity`` tokens.  Packing itself looks only at lengths, so the whole instance is a
histogram of at most ``capacity`` numbers, whatever the size of the corpus; the driver
plans on it and never sees a document.

* Reduction (Martello and Toth): a set of one or two lengths that dominates every other
  set with its largest member is fixed for good: a full piece; a piece that nothing
  fits; a pair that fills a sequence exactly; the largest partner where no two partners
  fit, or where it is as long as any two that do.
* Best fit, longest first, over the rest: classes of equal sequences (same room left)
  take classes of equal pieces.

The plan is a list of runs: "pieces number x to y of this length go to these sequences
at this offset".  Every piece gets its number among those of its length from its
partition's count and the counts of the partitions before (a sum over the small table of
counts by partition and length).  The plan has at most some ``capacity ** 2`` runs, a few
thousands in practice, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import BoundedCache, WordSplitter, byte_letters
from textloom.llm.common import arrow_map, cut, slices


def reduce_instance(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take dominating sets out of ``count`` (pieces by length, changed in place); (lengths, how many) of each."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        for x in lengths:
            count[x] -= n
        fixed.append((lengths, n))

    if count[capacity]:
        fix((capacity,), int(count[capacity]))
    for big in range(capacity - 1, capacity // 2, -1):
        if n := int(min(count[big], count[capacity - big])):
            fix((big, capacity - big), n)
    if capacity % 2 == 0 and (n := int(count[capacity // 2]) // 2):
        fix((capacity // 2,) * 2, n)
    for big in range(capacity - 1, 0, -1):
        while count[big]:
            count[big] -= 1  # the piece itself
            small = np.flatnonzero(count[: capacity - big + 1])
            count[big] += 1
            if not len(small):
                fix((big,), int(count[big]) if 2 * big > capacity else 1)
                continue
            low = [int(x) for x in np.repeat(small[:3], np.minimum(count[small[:3]], 3))[:3]]
            best = int(small[-1])
            room = capacity - big
            if len(low) > 1 and low[0] + low[1] <= room:
                if len(low) > 2 and sum(low[:3]) <= room:
                    break
                pairs = [int(a + small[i]) for a in small.tolist() if (i := np.searchsorted(small, room - a, "right") - 1) >= 0 and (small[i] != a or count[a] > 1)]
                if max(pairs, default=0) > best:
                    break
            fix((big, best), int(min(count[big], count[best])) if best != big else max(1, int(count[big]) // 2))
    return fixed


class Plan:
    """Runs of pieces of one length: arrays sorted by (length, first number)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            count[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first number, first sequence, pieces in each, offset
        self.sequences = 0
        for lengths, n in reduce_instance(count, capacity):
            if len(set(lengths)) == 1:
                self._run(lengths[0], n * len(lengths), self.sequences, len(lengths), 0)
            else:
                at = 0
                for x in lengths:
                    self._run(x, n, self.sequences, 1, at)
                    at += x
            self.sequences += n
        self._best_fit(count, capacity)
        self.runs.sort()
        table = np.array(self.runs, np.int64).reshape(-1, 5)
        self.length, self.first, self.sequence, self.each, self.offset = table.T
        self.key = (self.length << 44) + self.first

    def _run(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), sequence, each, offset))
        self.used[length] += n

    def _best_fit(self, count: np.ndarray, capacity: int) -> None:
        room: dict[int, list[tuple[int, int]]] = {}  # room left: classes of sequences (first, how many)
        for length in range(capacity, 0, -1):
            left = int(count[length])
            for r in sorted(r for r in room if r >= length) if left else ():
                classes = room.pop(r)
                while classes and left:
                    first, n = classes.pop()
                    left = self._fill(room, length, left, r, first, n, capacity)
                if classes:
                    room.setdefault(r, []).extend(classes)
                if not left:
                    break
            if left:
                n = -(-left // (capacity // length))
                self._fill(room, length, left, capacity, self.sequences, n, capacity)
                self.sequences += n

    def _fill(self, room: dict, length: int, left: int, r: int, first: int, n: int, capacity: int) -> int:
        each = r // length
        whole = min(n, left // each)
        if whole:
            self._run(length, whole * each, first, each, capacity - r)
            room.setdefault(r - each * length, []).append((first, whole))
            left -= whole * each
        if whole < n and left:
            self._run(length, left, first + whole, left, capacity - r)
            room.setdefault(r - left * length, []).append((first + whole, 1))
            whole, left = whole + 1, 0
        if whole < n:
            room.setdefault(r, []).append((first + whole, n - whole))
        return left

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers among their length's."""
        at = np.searchsorted(self.key, (length << 44) + number, "right") - 1
        k = number - self.first[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


@lru_cache(2)
def _tools(path: str):
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    model = tokenizer.model

    def ids(word: str) -> bytes:
        found = [special[word]] if word in special else [t.id for t in model.tokenize("".join([letters[b] for b in word.encode()]))]
        return np.array(found, "<u4").tobytes()

    return WordSplitter(special), BoundedCache(ids)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: ``key``, piece, start, length, ids_crc32, and its partition and number there among its length's."""
    names = (key, "piece", "start", "length", "ids_crc32", "part", "number")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids = _tools(path)
        part, seen, mark = TaskContext.get().partitionId(), [0] * (capacity + 1), end.to_bytes(4, "little")
        for batch in batches:
            for rows in slices(batch, text):
                out: list[tuple] = []
                for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    blob = b"".join(map(ids.__getitem__, split(t or ""))) + mark
                    for p, at in enumerate(range(0, len(blob), 4 * capacity)):
                        one = blob[at : at + 4 * capacity]
                        n = len(one) // 4
                        out.append((k, p, at // 4, n, crc32(one), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return arrow_map(docs.select(key, text), run, ", ".join(f"`{n}` long" for n in names))


def packed(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null text counts as empty; an empty text is one piece, the end mark.  Repeated rows
    are packed each for itself, rows without a key too.  An empty table gives no pieces.
    """
    rows = cut(pieces(docs, path, capacity, end, key, text))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("ahead"))
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    names = (key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = shared.value.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    numbered = rows.join(ahead, ["part", "length"]).select(*names[:5], (F.col("number") + F.col("ahead")).alias("number"))
    return arrow_map(numbered, place, ", ".join(f"`{n}` long" for n in names))
