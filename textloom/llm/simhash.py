"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is 64 majority bits of the XXH64 hashes (seed 42) of a text's four-word
shingles.  Two fingerprints at most ``radius`` bits apart meet in a variant that is at
most half of that away from both.  Emitting that ball for all 64 bits at once is 2,081
rows a fingerprint; so the bits are cut into two blocks first.  In one of them the pair
is at most ``radius // 2`` apart, and there every fingerprint emits all variants within
half of *that*: 33 rows a block.  Rows are shuffled on (block, variant), equal
fingerprints having been folded before, and colliding pairs are verified on all bits.

A variant with many fingerprints is cut into tiles by a hash before its rows are brought
together, and the tiles are compared pairwise, each pair by itself; from each comparison
only a spanning forest of the verified links is kept, so no group is ever gathered whole or
written out as all its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from textloom.llm.common import arrow_map, batches_of, cut, over_slices, unused
from textloom.llm.components import components
from textloom.llm.tiles import across, chosen, hot_keys, tiled

WORDS = re.compile("[^ \t-\r]+").findall
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
TILE = 2048


def fingerprint(text: str | None, size: int = 4) -> int:
    """The fingerprint as an unsigned number; zero for texts without words."""
    text = text or ""
    words = WORDS(text.lower() if text.isascii() else text.translate(LOWER))
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 65536):
        stop = min(n, start + 65536)
        part = words[start : stop + size - 1]
        shingles = map(" ".join, zip(*(part[k:] for k in range(size)))) if len(words) >= size else [" ".join(words)]
        h = np.fromiter((hashed(s, 42) for s in shingles), np.uint64, stop - start)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the fingerprint (``fp``, signed long) of every row."""
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> list:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return [batch.column(0), found.view(np.int64)]

    return arrow_map(docs.select(key, text), over_slices(run, schema, text), f"`{key}` long, fp long")


def _ball(value: Column, width: int, radius: int) -> Column:
    """All numbers of ``width`` (at most 32) bits within ``radius`` of ``value`` (radius at most 2)."""
    masks = [0]
    if radius > 0:
        masks += [1 << i for i in range(width)]
    if radius > 1:
        masks += [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: value.bitwiseXOR(m))


def _forest(left: np.ndarray, right: np.ndarray | None, names: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest, over ``names``, of the links within ``left`` or between it and ``right``."""
    other, shift = (left, 0) if right is None else (right, len(left))
    label = np.arange(len(names))
    for i, fp in enumerate(left):
        near = np.flatnonzero(np.bitwise_count(other ^ fp) <= radius) + shift
        found = label[near]
        apart = found != label[i]
        if apart.any():
            for one, at in zip(*np.unique(found[apart], return_index=True)):
                yield names[i], names[near[apart][at]]
                label[label == one] = label[i]


def _verified(radius: int):
    """mapInArrow: tiles, or pairs of tiles, to a spanning forest of their links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                tiles = [batch.column(c)[i].values for c in range(batch.num_columns)]
                fps = [t.field("fp").to_numpy().view(np.uint64) for t in tiles]
                reps = np.concatenate([t.field("rep").to_numpy() for t in tiles])
                edges += _forest(fps[0], fps[1] if len(fps) > 1 else None, reps, radius)
            a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def _variants(distinct: DataFrame, near: int) -> DataFrame:
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    keys = F.concat(_ball(low, 32, near), F.transform(_ball(high, 32, near), lambda v: v.bitwiseOR(F.lit(1 << 32))))
    return distinct.select("fp", "rep", F.explode(keys).alias("key"))


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between reps of ``distinct`` (fp, rep) that join all whose fingerprints are linked; ``radius`` is from 0 to 9."""
    if not 0 <= radius <= 9:  # beyond, a block's ball is over 5,489 variants
        raise ValueError("radius must be from 0 to 9")
    near = (radius // 2 + 1) // 2  # half of what one block can differ in, rounded up
    hot = hot_keys(_variants(distinct.filter(chosen(F.col("fp"))), near), "key", TILE)
    tiles = tiled(_variants(distinct, near), hot, "key", "fp").groupBy("key", "tile").agg(F.collect_list(F.struct("fp", "rep")).alias("rows"), F.max("parts").alias("parts"))
    tiles = cut(tiles.filter((F.size("rows") > 1) | F.col("parts").isNotNull()).select("key", "tile", "rows"))
    one, two = F.col("rows")[0], F.col("rows")[1]
    pairs = tiles.filter(F.size("rows") == 2).select(one["rep"].alias("a"), two["rep"].alias("b"), one["fp"].bitwiseXOR(two["fp"]).alias("x"))
    pairs = pairs.filter(F.bit_count("x") <= radius).select("a", "b")
    within = tiles.filter(F.size("rows") > 2).select(F.array_sort("rows").alias("rows")).distinct()
    out = "a long, b long"
    with batches_of(distinct.sparkSession, 64):  # a row here can be two whole tiles
        return cut(pairs.union(arrow_map(within, _verified(radius), out)).union(arrow_map(across(tiles, hot, "key"), _verified(radius), out)))


def near_duplicates(docs: DataFrame, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, fp (signed long) and component_id, the smallest ``key`` reachable through links.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows
    stay repeated.  Rows without a key take the component of their fingerprint (null if
    no row of it has a key).  Empty tables give empty results; other columns are not read.
    """
    fps = cut(fingerprints(docs, key, text))
    distinct = cut(fps.groupBy("fp").agg(F.min(key).alias("rep")).filter("rep is not null"))
    found = components(links(distinct, radius))
    named = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest key stays.

    Equal rows (same key and text) count as one, and of different texts with one key that
    are linked the one with the smallest fingerprint stays; rows without a key stay.  An
    empty table gives an empty one, and other columns stay, whatever their names.
    """
    fp, stays, again = (unused(docs, c) for c in ("_fp", "_stays", "_again"))
    found = near_duplicates(docs, radius, key, text).filter(F.col(key) == F.col("component_id"))
    stay = found.groupBy(F.col(key).alias(again)).agg(F.min("fp").alias(fp))
    # Which text of a key stays is known by its fingerprint, so that is made again for the keys that stay.
    rows = docs.join(stay, F.col(key) == F.col(again), "left")
    schema = StructType([*rows.schema.fields, StructField(stays, BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, wanted, keys = b.column(text).to_pylist(), b.column(fp).to_pylist(), b.column(key).to_pylist()
            good = [k is None or (w is not None and fingerprint(t) == w % (1 << 64)) for t, w, k in zip(texts, wanted, keys)]
            yield b.append_column(stays, pa.array(good, pa.bool_()))

    rows = arrow_map(rows, run, schema).filter(F.col(stays)).withColumn(again, F.xxhash64(text))
    nameless = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return rows.withColumn(stays, nameless).dropDuplicates([key, again, stays]).select(*docs.columns)
