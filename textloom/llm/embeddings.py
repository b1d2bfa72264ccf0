"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Vectors are compared only within their label.  Exact copies are folded first and counted
by multiplicity.  The first principal axis cuts each label into cells as wide as linked
vectors can lie apart, so only a cell and its neighbour are compared; a cell with many
vectors is cut into tiles of bounded size.  Two tiles are compared in PCA coordinates:
the leading dimensions first, the rest bounded by the product of suffix norms, and a pair
is dropped as soon as its cosine cannot reach the threshold.  What is left is verified
on the vectors themselves in double precision.  A comparison hands on sums of links and
a star for each group that it joins, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batches_of, cut
from textloom.llm.components import components

TILE = 4096
STEPS = (8, 16, 32)


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors' products, one row for each dimension count and entry."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        vectors = b.column(0)
        size = pc.list_value_length(vectors).to_numpy()
        for d in np.unique(size).tolist():
            x = vectors.filter(pa.array(size == d)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            x /= np.linalg.norm(x, axis=1)[:, None]
            total[d] = total.get(d, 0.0) + x.T @ x
    dims = [np.full(m.size, d) for d, m in total.items()]
    cat = lambda parts, kind: np.concatenate([*parts, np.empty(0)]).astype(kind)
    yield pa.RecordBatch.from_arrays([pa.array(cat(dims, np.int32)), pa.array(cat([np.arange(m.size) for m in total.values()], np.int32)), pa.array(cat([m.ravel() for m in total.values()], np.float64))], ["dim", "at", "value"])


def principal_axes(vectors: DataFrame, column: str) -> dict[int, np.ndarray]:
    """For each number of dimensions the principal axes (columns, leading first) of all unit vectors."""
    sums = arrow_map(vectors.select(column), _moments, "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.dim, np.zeros(r.dim * r.dim))[r.at] = r.value
    return {d: np.ascontiguousarray(np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]) for d, m in out.items()}


def linked(one: np.ndarray, two: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``one`` and ``two`` with at least this cosine; of one tile, each pair once."""
    unit = [x / np.linalg.norm(x, axis=1)[:, None] for x in (one, two)]
    a, b = (x @ axes for x in unit)
    d = a.shape[1]
    marks = [s for s in STEPS if s < d] + [d]
    rest = [[np.sqrt(np.maximum((x[:, m:] ** 2).sum(1), 0)) for m in marks] for x in (a, b)]
    least = threshold - 1e-9
    left, right = [], []
    for start in range(0, len(a), 512):
        rows = slice(start, start + 512)
        part = a[rows, : marks[0]] @ b[:, : marks[0]].T
        i, j = np.nonzero(part + rest[0][0][rows, None] * rest[1][0] >= least)
        done = part[i, j]
        i += start
        if same:
            up = i < j
            i, j, done = i[up], j[up], done[up]
        for k in range(1, len(marks)):
            if not len(i):
                break
            cols = slice(marks[k - 1], marks[k])
            done = done + np.concatenate([np.einsum("nd,nd->n", a[i[s : s + 65536], cols], b[j[s : s + 65536], cols]) for s in range(0, len(i), 65536)])
            keep = done + rest[0][k][i] * rest[1][k][j] >= least
            i, j, done = i[keep], j[keep], done[keep]
        if len(i):
            exact = np.concatenate([np.einsum("nd,nd->n", one[i[s : s + 65536]], two[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
            exact /= np.linalg.norm(one, axis=1)[i] * np.linalg.norm(two, axis=1)[j]
            keep = exact >= threshold
            left.append(i[keep])
            right.append(j[keep])
    return np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64)


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that it reaches over links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compare(axes, threshold: float):
    """mapInArrow over (same, rows of one tile, rows of another): sums of links (kind 0) and star edges (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def rows_of(cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = cell.values
        ids, n, v = (rows.field(f) for f in ("rep", "n", "v"))
        return ids.to_numpy(), n.to_numpy(), v.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column(0)[r].as_py()
                ids, n, x = rows_of(batch.column(1)[r])
                ids2, n2, y = (ids, n, x) if same else rows_of(batch.column(2)[r])
                i, j = linked(x, y, axes.value[x.shape[1]], threshold, same)
                every, weight = (ids, n) if same else (np.concatenate([ids, ids2]), np.concatenate([n, n2]))
                j = j if same else j + len(ids)
                count = np.bincount(i, weight[j], len(every)) + np.bincount(j, weight[i], len(every))
                star = _stars(len(every), i, j)
                has, off = np.flatnonzero(count), np.flatnonzero(star != np.arange(len(every)))
                kind = np.repeat([0, 1], [len(has), len(off)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([every[has], every[off]])), pa.array(np.concatenate([count[has].astype(np.int64), every[star[off]]]))], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """``key``, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite numbers, rows without
    a label or a key, and vectors of different lengths link with nothing.  Copies link
    with each other and are counted one by one.  Repeated rows stay repeated.  Different
    vectors under one key are told apart when they are compared, but as a key is one node of
    the graph, they are in one component and each has the links of all of them.  An empty
    table gives an empty one, other columns are not read.
    """
    x = F.col(vector)
    sound = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0)
    sound &= F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("l"), F.when(sound, x).alias("v"))
    rows = rows.select("id", "l", F.when(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")) > 0, F.col("v")).alias("v"))
    one = cut(rows.filter("v is not null").groupBy("l", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    found = principal_axes(one, "v")
    axes = vectors.sparkSession.sparkContext.broadcast(found)
    width = float(np.sqrt(2 * (1 - threshold))) + 1e-6
    size, at = F.size("v"), F.lit(0.0)
    for d, basis in found.items():
        lead = F.array(*(F.lit(float(e)) for e in basis[:, 0]))
        dot = F.aggregate(F.zip_with("v", lead, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, e: s + e)
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
        at = F.when(size == d, dot / length).otherwise(at)
    place = one.select("l", size.alias("d"), F.floor(at / width).cast("int").alias("cell"), "rep", "n", "v")
    cells = place.groupBy("l", "d", "cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    spread = place.join(cells, ["l", "d", "cell"]).withColumn("sub", F.pmod(F.xxhash64("rep", "v"), "parts").cast("int"))
    tiles = cut(spread.groupBy("l", "d", "cell", "sub").agg(F.collect_list(F.struct("rep", "n", "v")).alias("rows")))
    names = tiles.select("l", "d", "cell", "sub")
    other = names.select("l", "d", F.col("cell").alias("cell2"), F.col("sub").alias("sub2"))
    near = names.withColumn("cell2", F.explode(F.array("cell", F.col("cell") + 1))).join(other, ["l", "d", "cell2"]).filter("cell2 > cell or sub2 >= sub")
    second = tiles.select("l", "d", F.col("cell").alias("cell2"), F.col("sub").alias("sub2"), F.col("rows").alias("rows2"))
    same = (F.col("cell") == F.col("cell2")) & (F.col("sub") == F.col("sub2"))
    work = near.join(tiles, ["l", "d", "cell", "sub"]).join(second, ["l", "d", "cell2", "sub2"]).select(same.alias("same"), "rows", F.when(~same, F.col("rows2")).alias("rows2"))
    with batches_of(vectors.sparkSession, 8):  # a row here is two whole tiles
        said = cut(arrow_map(work, _compare(axes, threshold), "kind int, a long, b long"))
    degree = said.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    joined = components(said.filter("kind = 1").select("a", "b"))
    info = one.join(degree, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    info = info.select("l", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(info, ["l", "v"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def sql(threshold: float = 0.93) -> str:
    """The query over ``embeddings`` in DuckDB's SQL: every pair of a label, and recursion over the links."""
    return (
        "WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0), "
        f"l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}), "
        "r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y), "
        "c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x) "
        "SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"
    )
