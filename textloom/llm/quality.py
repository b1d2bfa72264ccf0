"""Quality classifier: a support vector machine over naive Bayes features.

A text becomes the set of its n-grams: words, pairs of words, and runs of up to three
*forms* (case of a word, digits, the marks themselves, "=" for a repeated token), so that
shapes of junk are known also where its words are new.  Each indicator is scaled by its
log-count ratio between the classes, and a linear hinge-loss model is fitted by dual
coordinate descent.  A logistic curve fitted on margins of folds not trained on turns
margins into scores.

Bounds, all parameters: ``most`` labelled rows of each class, ``width`` n-grams that
``least`` of these rows have.  The model is of bounded size and is all that is broadcast; scoring reads every text whole and
needs no shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import BoundedCache
from textloom.llm.common import arrow_map, cut, in_worker, over_slices
from textloom.llm.labelled import held_out, logistic, sample

TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall


def _form(token: str) -> str:
    if token[0].isalpha():
        return "A" if len(token) > 1 and token.isupper() else "T" if token[0].isupper() else "a"
    return "9" if token[0].isdigit() else token[:3]


FORMS = BoundedCache(_form)


def grams(text: str) -> tuple[set, set, set, set, set]:
    """The n-grams of a text, in five sets: words, word pairs, forms of one, two and three tokens."""
    tokens = TOKENS(text)
    forms = ["=" if a == b else f for a, b, f in zip(tokens, ["", *tokens], map(FORMS.__getitem__, tokens))]
    low = TOKENS(text.lower())
    return set(low), set(zip(low, low[1:])), set(forms), set(zip(forms, forms[1:])), set(zip(forms, forms[1:], forms[2:]))


def _named(found: tuple[set, ...]) -> list[str]:
    return [f"{k}\t" + (g if isinstance(g, str) else "\t".join(g)) for k, one in enumerate(found) for g in one]


@dataclass
class Model:
    weights: tuple[dict, ...]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str) -> float:
        found = grams(text)
        return self.bias + sum(sum(map(w.__getitem__, one & w.keys())) for one, w in zip(found, self.weights) if w)

    def score(self, text: str) -> float:
        z = self.slope * self.margin(text) + self.shift
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, epochs: int = 20) -> np.ndarray:
    """Weights of the linear hinge-loss model over scaled indicators; the last one is the bias.

    A row's indexes and values are made where it is visited: those of all rows at once are several times what the rows take.
    """
    w, alpha, last = np.zeros(len(scale) + 1), np.zeros(len(y)), len(scale)
    scale = np.append(scale, 1.0)
    square = np.array([v @ v for v in (scale[np.append(r, last)] for r in rows)])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            row = np.append(rows[i], last)
            values = scale[row]
            g = y[i] * (w[row] @ values) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w[row] += (new - alpha[i]) * y[i] * values
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w


def fit(rows: list[np.ndarray], y: np.ndarray, names: list[str], share: float, cost: float = 0.01) -> Model:
    """``rows``: indexes into ``names``; ``y``: 1 or -1; ``share``: of label 1 among all labelled rows."""
    empty = Model(({},) * 5, 0.0, 1.0, 0.0)
    if not len(y) or not names or abs(y.sum()) == len(y):
        empty.shift = 0.0 if not len(y) else float(math.log((len(y) + 1) * 1.0) * np.sign(y.sum()))
        return empty

    def ratio(part: np.ndarray) -> np.ndarray:
        counts = np.ones((2, len(names)))
        for i in part:
            counts[int(y[i] > 0), rows[i]] += 1
        p = counts / counts.sum(1, keepdims=True)
        return np.log(p[1] / p[0])

    def weigh(part: np.ndarray) -> tuple[np.ndarray, float]:
        r = ratio(part)
        w = dual_coordinate_descent([rows[i] for i in part], r, y[part], cost)
        return w[:-1] * r, w[-1]

    every, folds = np.arange(len(y)), np.random.default_rng(11).permutation(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):
        part = every[folds != k]
        if abs(y[part].sum()) == len(part):
            continue
        w, b = weigh(part)
        for i in every[folds == k]:
            margin[i] = w[rows[i]].sum() + b
    w, b = weigh(every)
    weight = np.where(y > 0, share / (y > 0).mean(), (1 - share) / (y <= 0).mean())
    slope, shift = logistic(margin, y, weight)
    weights: tuple[dict, ...] = ({}, {}, {}, {}, {})
    for name, value in zip(names, w.tolist()):
        k, *gram = name.split("\t")
        weights[int(k)][gram[0] if len(gram) == 1 else tuple(gram)] = value
    return Model(weights, float(b), slope, shift)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, rest: int = 1, most: int = 2500, width: int = 60_000, least: int = 3, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``most`` rows of each label; the n-grams' counts are summed in Spark, and the model is fitted in a worker."""
    schema = pa.schema([("label", pa.int32()), ("grams", pa.list_(pa.string()))])

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [_named(grams(t or "")) for t in batch.column(1).to_pylist()]]

    chosen = sample(docs, labels, label, parts, rest, most, key, text)
    rows = cut(arrow_map(chosen, over_slices(run, schema, text), "label int, grams array<string>"))
    counts = rows.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    # Above all n-grams whose counts in the classes differ most for chance.
    surprise = F.abs(F.col("n1") - F.col("n") * F.lit(total.n1 / max(1, total.n))) / F.sqrt("n")
    best = counts.filter(F.col("n") >= least).orderBy(surprise.desc(), "gram").limit(width).select("gram")
    names = sorted(best.toArrow().column(0).to_pylist())
    index = {g: i for i, g in enumerate(names)}
    known = docs.sparkSession.sparkContext.broadcast(index)
    schema2 = pa.schema([("label", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def place(batches):
        for b in batches:
            ids = [sorted(known.value[g] for g in one.as_py() if g in known.value) for one in b.column(1)]  # a row's n-grams at a time
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, schema2[1].type)], schema=schema2)

    ones = labels.filter(F.col(label).isin(0, 1) & ~held_out(key, parts, rest)).agg(F.avg(label)).first()[0]
    share = min(0.99, max(0.01, ones or 0.5))

    model = in_worker(arrow_map(rows, place, "label int, ids array<int>"), lambda got: _learnt(got, known.value, share))
    known.destroy()
    return model


def _learnt(got: pa.Table, index: dict[str, int], share: float) -> Model:
    """The model of labelled rows (label, ids), the ids in order and as ``index`` numbers the n-grams."""
    ids, marks = [r.values.to_numpy() for r in got.column(1)], got.column(0).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (marks[i], ids[i].astype(">i4").tobytes()))  # by value, whatever the tasks' order
    y = np.array([1 if marks[i] else -1 for i in order])
    return fit([ids[i] for i in order], y, sorted(index, key=index.__getitem__), share)


def with_scores(docs: DataFrame, model: Model, cutoff: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and predicted of every row.

    A null text counts as empty and is scored as such.  Repeated rows stay repeated, an
    empty table gives an empty one, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batch: pa.RecordBatch) -> list:
        score = shared.value.score
        scores = [score(t or "") for t in batch.column(1).to_pylist()]
        return [batch.column(0), scores, [int(s >= cutoff) for s in scores]]

    return arrow_map(docs.select(key, text), over_slices(run, schema, text), f"`{key}` long, score double, predicted int")


def kept(docs: DataFrame, model: Model, cutoff: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cutoff``, with all their columns, whatever their names.

    A null text counts as empty; repeated rows are kept or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            score = shared.value.score
            yield b.filter(pa.array([score(t or "") >= cutoff for t in b.column(text).to_pylist()], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
