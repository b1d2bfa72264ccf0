"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A bag is the subwords of a word, or of a whole text (``whole``): each word itself and its
character n-grams (with end marks), hashed to rows of an embedding table.  The mean of the
bag's vectors goes through a linear softmax over two classes.  Table and softmax are trained
jointly from labels of whole texts: a text is toxic if any of its bags is, so its
probability is the noisy-or of its distinct bags', and with a bag a word one insult counts as
much in a long text as in a short one.  Misspellings and inflections never seen share
n-grams, and so vectors, with words that were.  A logistic curve fitted on texts that the
model did not see turns its log odds into scores.

Bounds, all parameters: ``most`` labelled rows of each class, ``2 ** bits`` rows of the
table.  Only the table is broadcast.  Every text is read whole; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import BoundedCache
from textloom.llm.common import arrow_map, in_worker, over_slices
from textloom.llm.labelled import held_out, logistic, sample

RUNS = re.compile(r"\w+").findall
LETTER = re.compile(r"[^\W\d_]").search
SHORTEST, LONGEST = 3, 6  # characters of an n-gram


def words(text: str | None) -> set[str]:
    """The distinct runs of word characters that hold a letter, in lower case."""
    return {w for w in set(RUNS((text or "").lower())) if w.isalpha() or LETTER(w)}


def subwords(word: str, bits: int) -> list[int]:
    """Rows of the table: the whole word's, then those of its n-grams."""
    marked, mask = f"<{word}>", (1 << bits) - 1
    found = [marked, *(marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1) if n < len(marked))]
    return [crc32(g.encode()) & mask for g in found]


def log_odds(hazard):
    return np.log(np.expm1(np.minimum(hazard, 30.0)) + 1e-9)


@dataclass
class Bags:
    """Bags of subwords and where they occur: ``size[i]`` of ``rows`` (of the table) in turn are bag i's; bag ``bag[k]`` is in text ``text[k]``."""

    rows: np.ndarray
    size: np.ndarray
    bag: np.ndarray
    text: np.ndarray
    texts: int

    def blocks(self, most: int = 400_000) -> Iterator[tuple[slice, slice]]:
        """Ranges of bags and of their rows, so that what is made of a range is small."""
        ends = np.cumsum(self.size)
        low = at = 0
        while low < len(ends):
            high = max(low + 1, int(np.searchsorted(ends, at + most, "right")))
            yield slice(low, high), slice(at, int(ends[high - 1]))
            low, at = high, int(ends[high - 1])

    def sums(self, bag: slice, values: np.ndarray) -> np.ndarray:
        """For each bag of a block the sum of its rows' values."""
        size = self.size[bag]
        out = np.zeros(len(size))
        full = np.flatnonzero(size)
        if len(full):
            out[full] = np.add.reduceat(values, (np.cumsum(size) - size)[full])
        return out

    def part(self, chosen: np.ndarray) -> Bags:
        """The texts of ``chosen`` (a mask) and their bags, both numbered anew."""
        keep = chosen[self.text]
        used = np.bincount(self.bag[keep], minlength=len(self.size)) > 0
        bag, text = (np.cumsum(m, dtype=np.int32) - 1 for m in (used, chosen))
        return Bags(self.rows[np.repeat(used, self.size)], self.size[used], bag[self.bag[keep]], text[self.text[keep]], int(chosen.sum()))


def bags_of(names: list[str], word: np.ndarray, text: np.ndarray, texts: int, bits: int, whole: bool = False) -> Bags:
    """``names``: distinct words; word ``word[k]`` is in text ``text[k]``, and ``text`` is in order."""
    size = np.fromiter((len(subwords(w, 0)) for w in names), np.int32, len(names))
    rows = np.fromiter((r for w in names for r in subwords(w, bits)), np.int32, int(size.sum()))
    if not whole:
        return Bags(rows, size, word.astype(np.int32), text.astype(np.int32), texts)
    start, n = np.cumsum(size) - size, size[word]
    at = np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    every = np.arange(texts, dtype=np.int32)
    return Bags(rows[at], np.bincount(text, n, texts).astype(np.int32), every, every, texts)


def loss_and_gradients(table, softmax, bias, bags: Bags, use, y, weight, accuses, noise: float):
    """The weighted log loss of the texts' labels and its gradients; ``use`` masks subwords, ``accuses`` occurrences."""
    u = softmax[:, 1] - softmax[:, 0]
    part = table @ u
    size, s = np.zeros(len(bags.size)), np.zeros(len(bags.size))
    for bag, row in bags.blocks():
        size[bag] = bags.sums(bag, use[row].astype(np.float32))
        s[bag] = bags.sums(bag, part[bags.rows[row]] * use[row])
    size = np.maximum(size, 1)
    s = s / size + (bias[1] - bias[0])
    total = np.bincount(bags.text, np.logaddexp(0, s)[bags.bag], bags.texts)
    left = np.exp(-np.minimum(total, 30))
    wrong = noise / (1 - noise)
    loss = float((weight * np.where(y > 0, -np.log(wrong + 1 - left + 1e-12), total)).sum())
    pull = weight * np.where(y > 0, -left / (wrong + 1 - left + 1e-12), 1.0)
    g = np.bincount(bags.bag, pull[bags.text] * accuses, len(size)) / (1 + np.exp(-s))
    by_row, share = np.zeros(len(table)), g / size
    for bag, row in bags.blocks():
        by_row += np.bincount(bags.rows[row], np.repeat(share[bag], bags.size[bag]) * use[row], len(table))
    by_row = by_row.astype(table.dtype)
    down = table.T @ by_row
    return loss, [by_row[:, None] * u[None, :], np.stack([-down, down], 1), np.array([-g.sum(), g.sum()], table.dtype)]


@dataclass
class Model:
    """``table``: (rows, dim); ``softmax``: (dim, 2); ``bias``: (2,).  ``slope`` and ``shift`` apply to log odds."""

    table: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    bits: int
    whole: bool = False
    slope: float = 1.0
    shift: float = 0.0
    _kept: BoundedCache | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_kept": None}

    def parts(self) -> BoundedCache:
        """Words to (sum, number) of their subwords' places on the line between the classes; with a bag a word, to -log(1 - probability)."""
        if self._kept is None:
            part = (self.table @ (self.softmax[:, 1] - self.softmax[:, 0])).tolist()
            base = float(self.bias[1] - self.bias[0])

            def both(word: str) -> tuple[float, int]:
                rows = subwords(word, self.bits)
                return sum(map(part.__getitem__, rows)), len(rows)

            def hazard(word: str) -> float:
                found, n = both(word)
                return float(np.logaddexp(0.0, base + found / n))

            self._kept = BoundedCache(both if self.whole else hazard)
        return self._kept

    def odds(self, text: str | None) -> float:
        found = map(self.parts().__getitem__, words(text))
        if not self.whole:
            return float(log_odds(sum(found)))
        every = list(found)
        mean = sum(s for s, _ in every) / max(1, sum(n for _, n in every))
        return float(log_odds(np.logaddexp(0.0, float(self.bias[1] - self.bias[0]) + mean)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.odds(text) + self.shift, -40, 40))))


def _descend(bags: Bags, y: np.ndarray, bits: int, dim: int, epochs: int, rate: float, decay: float, noise: float, whole: bool) -> Model:
    rng = np.random.default_rng(3)
    params = [rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.array([3.0, -3.0], np.float32)]
    toxic = y > 0
    accuses = np.ones(len(bags.bag), bool)
    if not whole:
        accuses = np.bincount(bags.bag, toxic[bags.text])[bags.bag] >= max(3, 0.01 * toxic.sum())
        accuses |= ~toxic[bags.text]
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        use = rng.integers(0, 256, len(bags.rows), np.uint8) < 171  # two thirds
        _, grads = loss_and_gradients(*params, bags, use, y, weight, accuses, noise)
        for k, (p, d) in enumerate(zip(params, grads)):
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.02 * (d * d - second[k])
            if k == 0:
                p *= 1 - decay
            p -= (rate if k == 0 else rate / 3) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.98**t)) + 1e-8)
    return Model(*params, bits, whole)


def _margins(model: Model, bags: Bags) -> np.ndarray:
    """Log odds of every text of ``bags``."""
    part, s = model.table @ (model.softmax[:, 1] - model.softmax[:, 0]), np.zeros(len(bags.size))
    for bag, row in bags.blocks():
        s[bag] = bags.sums(bag, part[bags.rows[row]])
    s = s / np.maximum(bags.size, 1) + (model.bias[1] - model.bias[0])
    return log_odds(np.bincount(bags.text, np.logaddexp(0, s)[bags.bag], bags.texts))


def fit(bags: Bags, y: np.ndarray, bits: int = 17, dim: int = 12, epochs: int = 120, rate: float = 0.15, decay: float = 0.02, noise: float = 0.2, whole: bool = False, share: float = 0.5) -> Model:
    """Full-batch Adam on the noisy-or's log loss, both classes weighted alike.

    Four guards against learning by heart: vectors decay; a third of the subwords is left
    out at random in each step, so that a word's parts learn to stand for it; a word
    accuses a text only if three toxic texts of the sample, and one in a hundred, have it;
    and a share ``noise`` of the toxic labels is taken to be wrong, so that a text that
    nothing explains is given up instead of being learned.

    The logistic curve is fitted on the odds that a model of one half gives the other half,
    with the toxic texts weighing ``share`` of all, which is their share among labelled rows.
    """
    toxic = y > 0
    if not len(y) or toxic.all() or not toxic.any():
        model = Model(np.zeros((1 << bits, dim), np.float32), np.zeros((dim, 2), np.float32), np.array([3.0, -3.0], np.float32), bits, whole)
        model.slope, model.shift = 0.0, 3.0 if len(y) and toxic.all() else -3.0
        return model
    settings = (bits, dim, epochs, rate, decay, noise, whole)
    model = _descend(bags, y, *settings)
    half = np.empty(len(y), bool)
    rng = np.random.default_rng(11)
    for label in (True, False):
        half[toxic == label] = rng.permutation((toxic == label).sum()) % 2 == 0
    if min(toxic[half].sum(), toxic[~half].sum(), (~toxic[half]).sum(), (~toxic[~half]).sum()) > 0:
        margin, seen = _margins(_descend(bags.part(half), y[half], *settings), bags.part(~half)), toxic[~half]
        model.slope, model.shift = logistic(margin, y[~half], np.where(seen, share / seen.mean(), (1 - share) / (~seen).mean()))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, rest: int = 2, most: int = 1000, key: str = "doc_id", text: str = "text", whole: bool = False, bits: int = 17) -> Model:
    """Fit on at most ``most`` rows of each label; only their distinct words are gathered, in one worker, and only the model reaches the driver."""
    schema = pa.schema([("label", pa.int32()), ("words", pa.list_(pa.string()))])

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [sorted(words(t)) for t in batch.column(1).to_pylist()]]

    rows = arrow_map(sample(docs, labels, label, parts, rest, most, key, text), over_slices(run, schema, text), "label int, words array<string>")
    ones = labels.filter(F.col(label).isin(0, 1) & ~held_out(key, parts, rest)).agg(F.avg(label)).first()[0]
    share = min(0.99, max(0.01, ones or 0.5))
    return in_worker(rows, lambda got: _learnt(got, bits, whole, share))


def _learnt(got: pa.Table, bits: int, whole: bool, share: float) -> Model:
    """The model of labelled rows (label, words)."""
    got = got.combine_chunks()
    y = got.column(0).to_numpy()
    found = got.column(1).combine_chunks()
    text_of, coded = pc.list_parent_indices(found).to_numpy(), pc.list_flatten(found).dictionary_encode()
    names = coded.dictionary.to_pylist()
    # The order of rows and words is that of the tasks; theirs by value makes the fit the same each time.
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    word_of = rank[coded.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
    cuts = np.split(word_of, np.searchsorted(text_of, np.arange(1, max(1, len(y)))))
    order = sorted(range(len(y)), key=lambda i: (y[i], cuts[i].tobytes()))
    word = np.concatenate([*(cuts[i] for i in order), np.empty(0, np.int64)])
    text_new = np.repeat(np.arange(len(y)), [len(cuts[i]) for i in order])
    return fit(bags_of(sorted(names), word, text_new, len(y), bits, whole), y[order], bits, whole=whole, share=share)


def with_scores(docs: DataFrame, model: Model, cutoff: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and predicted of every row.

    Null and empty texts get the score of a text without words.  Repeated rows stay
    repeated, an empty table gives an empty one, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batch: pa.RecordBatch) -> list:
        scores = [shared.value.score(t) for t in batch.column(1).to_pylist()]
        return [batch.column(0), scores, [int(s >= cutoff) for s in scores]]

    return arrow_map(docs.select(key, text), over_slices(run, schema, text), f"`{key}` long, score double, predicted int")


def kept(docs: DataFrame, model: Model, cutoff: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``cutoff``, with all their columns, whatever their names.

    Null and empty texts score as texts without words; repeated rows are kept or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < cutoff for t in b.column(text).to_pylist()], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
