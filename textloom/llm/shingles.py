"""Near-duplicates by exact Jaccard similarity of five-word shingles, without loss.

A text is the set of its hashed shingles; equal sets are folded first.  Operator 10 proposes
pairs by its fingerprints (``simhash``: ball hashing, all within ``radius`` bits); as 64 bits do
not reach all of similarity 0.8, the prefix filter proposes the rest, and all are verified.  Of
two sets with similarity 4/5 or more, in any one order of all shingles, the first fifth
of each (``n - ceil(4n/5) + 1`` shingles) holds the first shingle they share.  The order
is the rare ones first, as counted in a bounded sample: it decides how many candidates
meet, not which pairs are found.  Candidates whose places leave room for the overlap are
compared by sketches (each shingle turns one bit over; two sketches differ in no more bits
than their sets in shingles, so no pair is lost), and the rest verified on the whole sets.

A shingle with many texts is cut into tiles (``tiles``).  Texts of a tile of more than
``FEW`` are compared by their sketches where they are gathered, so that pairs far apart are
never written out.  Of such a tile each text first proposes one partner only, the one of
those near it that most others are near to; the pairs that the links found so far leave in
different components are proposed after that.  So a large group of real copies is linked
through its middle and is not written out as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import simhash
from textloom.llm.bpe import BoundedCache
from textloom.llm.common import arrow_map, batches_of, cut, over_slices, unused
from textloom.llm.components import components
from textloom.llm.simhash import WORDS
from textloom.llm.tiles import across, chosen, hot_keys, tiled

SIZE = 5
SAMPLE, OFTEN, LISTED = 20_000, 3, 200_000  # texts sampled; count from which a shingle is listed; most listed
TILE, FEW = 1024, 32
SENT = 200_000  # most rows of three longs that are broadcast
# Odd numbers that mix the words' hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


WORD_HASHES = BoundedCache(lambda w: xxhash.xxh64_intdigest(w, 42), 100_000)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashed shingles, sorted; a text of fewer words is one shingle, one without words has none.

    Words are lower-cased and parted by white space, as in ``fingerprints``.
    """
    words = WORDS((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    hashed = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(SIZE, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += hashed[k : k + n] * MIX[k]
    h ^= h >> np.uint64(32)
    h *= MIX[0]
    return np.unique((h ^ (h >> np.uint64(29))).view(np.int64))


def _sketch(found: np.ndarray) -> bytes:
    """A bit for each remainder of the shingles by a power of two: whether an odd number of them has it."""
    bits = 1 << max(10, len(found).bit_length())
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def _apart(one: bytes, two: bytes) -> int:
    """The bits in which two sketches differ; the longer is first folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(b, np.uint64) for b in (one, two)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _sets(docs: DataFrame, name: str, text: str) -> DataFrame:
    """``name`` (long) and the shingles (``set``) of every row."""
    schema = pa.schema([(name, pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [shingles(t) for t in batch.column(1).to_pylist()]]

    return arrow_map(docs.select(name, text), over_slices(run, schema, text), f"`{name}` long, set array<long>")


def _frequent(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts of a sample, sorted, and their counts."""
    share = SAMPLE / max(1, docs.count())
    part = docs if share >= 1 else docs.sample(share, seed=7)
    each = _sets(part, key, text).select(F.explode("set").alias("token"))
    found = each.groupBy("token").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(LISTED).toArrow()
    tokens, counts = (c.to_numpy() for c in found.columns)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefixes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, hash (of the text), node (of the set), n (its size), prefix (its rarest shingles), sketch and fingerprint (``fp``) of every row."""
    tokens, counts = _frequent(docs, key, text)
    schema = pa.schema([(key, pa.int64()), ("hash", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary()), ("fp", pa.int64())])

    def first(found: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(found), np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
            rank = np.where(tokens[at] == found, counts[at], 0)
        return found[np.lexsort((found, rank))][: len(found) - -(-4 * len(found) // 5) + 1]

    def run(batch: pa.RecordBatch) -> list:
        texts = batch.column(2).to_pylist()
        sets = [shingles(t) for t in texts]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
        fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return [batch.column(0), batch.column(1), nodes, [len(s) for s in sets], [first(s) for s in sets], [_sketch(s) for s in sets], fps]

    rows = docs.select(key, F.xxhash64(text).alias("hash"), text)
    return arrow_map(rows, over_slices(run, schema, text), f"`{key}` long, hash long, node long, n int, prefix array<long>, sketch binary, fp long")


def _alike(reps: DataFrame, radius: int) -> DataFrame:
    """The pairs (a, b) of nodes, a < b, that operator 10 proposes: equal fingerprints by a star, others by its ball hashing."""
    distinct = cut(reps.groupBy("fp").agg(F.min("node").alias("rep")))
    equal = reps.select("fp", "node").join(distinct, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = simhash.links(distinct, radius)
    return equal.union(near.select(F.least("a", "b"), F.greatest("a", "b"))).filter("a < b")


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0) for b in sketches])


class _Tile:
    """The texts of one tile: ``node``, size ``n``, ``room`` (shingles from the tile's on), ``label`` and sketches, if they have these."""

    def __init__(self, rows: pa.StructArray):
        names = [f.name for f in rows.type]
        self.node, self.n, self.room = (rows.field(f).to_numpy() for f in ("node", "n", "room"))
        self.label = rows.field("label").to_numpy() if "label" in names else self.node
        if "sketch" in names:
            sketches = rows.field("sketch").to_pylist()
            self.words = np.array([len(b) // 8 for b in sketches])
            self.folded = {w: (np.flatnonzero(self.words >= w), _folded([b for b in sketches if len(b) >= 8 * w], w)) for w in np.unique(self.words).tolist()}
            self.sketches = sketches

    def fits(self, i: int, other: _Tile) -> np.ndarray:
        """The texts of ``other`` whose places leave room for the overlap that text ``i`` needs."""
        return 9 * np.minimum(other.room, self.room[i]) >= 4 * (other.n + self.n[i])

    def near(self, i: int, other: _Tile) -> np.ndarray:
        """Those of them whose sketches do not rule it out either."""
        at = np.flatnonzero(self.fits(i, other))
        out = np.zeros(len(other.node), bool)
        for w in np.unique(np.minimum(other.words[at], self.words[i])).tolist():
            these = at[np.minimum(other.words[at], self.words[i]) == w]
            if w in other.folded:
                place, folded = other.folded[w]
                theirs = folded[np.searchsorted(place, these)]
            else:
                theirs = _folded([other.sketches[k] for k in these], w)
            mine = _folded([self.sketches[i]], w)[0]
            apart = np.bitwise_count(theirs ^ mine).sum(1)
            out[these[9 * apart <= other.n[these] + self.n[i]]] = True
        return out


def _every(one: _Tile, two: _Tile) -> tuple[list, list]:
    """All pairs of a small tile."""
    a, b = [], []
    for k in range(len(one.node)):
        found = one.node[:k][one.fits(k, one)[:k]]
        a.append(found)
        b.append(np.full(len(found), one.node[k]))
    return a, b


def _middles(one: _Tile, two: _Tile) -> tuple[list, list]:
    """For each text of a large tile the text near it that has most texts near."""
    near = np.stack([one.near(k, one) for k in range(len(one.node))])
    np.fill_diagonal(near, False)
    degree = near.sum(1)
    has = np.flatnonzero(degree)
    best = np.where(near[has], degree, -1).argmax(1)
    return [one.node[has]], [one.node[best]]


def _apart_yet(one: _Tile, two: _Tile) -> tuple[list, list]:
    """All pairs of near texts of one or two large tiles that have different labels."""
    a, b = [], []
    for k in range(len(one.node)):
        found = one.near(k, two) & (two.label != one.label[k])
        if one is two:
            found[k:] = False
        a.append(two.node[found])
        b.append(np.full(int(found.sum()), one.node[k]))
    return a, b


def _pairs(tiles: DataFrame, find) -> DataFrame:
    """The distinct pairs (a, b) of nodes, a < b, that ``find`` gives for rows of one tile or of two."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                both = [_Tile(batch.column(c)[i].values) for c in range(batch.num_columns)]
                a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in find(both[0], both[-1]))
                for at in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], pa.int64()) for x in (a, b)], schema=schema)

    with batches_of(tiles.sparkSession, 16):
        found = arrow_map(tiles, run, "a long, b long")
        return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())


def _close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose sketches do not rule similarity 4/5 out: their sets differ in at most 1/9 of both sizes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, one, two = (c.to_pylist() for c in batch.columns)
            near = [9 * _apart(x, y) <= k for k, x, y in zip(n, one, two)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, ok in zip(c, near) if ok], pa.int64()) for c in (a, b)], schema=schema)

    for c in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
    return arrow_map(pairs.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b"), run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs whose whole sets have similarity 4/5 or more."""
    pairs = cut(_close(pairs, reps))
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    wanted = reps.join(ends, "node").select("node", F.col("rep.key").alias("_key"), F.col("rep.hash").alias("_hash"))
    wanted = cut(wanted)
    if wanted.count() <= SENT:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, ["_key", "_hash"]).select("node", "_text").dropDuplicates(["node"])
    sets = cut(_sets(texts, "node", "_text"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    return both.filter(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b")


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the component of every node."""
    found = components(links).select(F.col("node").alias("_node"), "component")
    return nodes.join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("label"))


def _least(key: str) -> Column:
    return F.min(F.struct(F.col(key).alias("key"), "hash"))


def _labelled(docs: DataFrame, key: str, text: str, radius: int) -> DataFrame:
    """``key``, hash and label (component) of every row with a key."""
    docs = docs.filter(F.col(key).isNotNull())
    every = cut(_prefixes(docs, key, text))
    reps = cut(every.groupBy("node").agg(_least(key).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")))
    room = (F.col("n") - F.col("place")).alias("room")

    def rows_of(some: DataFrame) -> DataFrame:
        return some.select("node", "n", F.posexplode("prefix").alias("place", "token")).select("token", "node", "n", room)

    hot = hot_keys(rows_of(reps.filter(chosen(F.col("node")))), "token", TILE)
    tiles = tiled(rows_of(reps), hot, "token", "node").groupBy("token", "tile").agg(F.collect_list(F.struct("node", "n", "room")).alias("rows"), F.max("parts").alias("parts"))
    tiles = cut(tiles.filter((F.size("rows") > 1) | F.col("parts").isNotNull()))
    few = F.col("parts").isNull() & (F.size("rows") <= FEW)
    small, large = tiles.filter(few), tiles.filter(~few).select("token", "tile", F.explode("rows").alias("row"))
    large = large.select("token", "tile", "row.*").join(reps.select("node", "sketch"), "node")
    gathered = cut(large.groupBy("token", "tile").agg(F.collect_list(F.struct("node", "n", "room", "sketch")).alias("rows")))
    proposed = _alike(reps, radius).union(_pairs(small.select("rows"), _every)).union(_pairs(gathered.select("rows"), _middles)).distinct()
    found = cut(_verified(proposed, reps, docs, key, text))
    named = cut(_named(reps.select("node"), found))
    if not gathered.isEmpty():
        again = large.join(named, "node").groupBy("token", "tile").agg(F.collect_list(F.struct("node", "n", "room", "label", "sketch")).alias("rows"))
        again = cut(again)
        more = _pairs(again.select("rows"), _apart_yet).union(_pairs(across(again, hot, "token"), _apart_yet)).distinct()
        more = _verified(more, reps, docs, key, text)
        named = _named(reps.select("node"), found.union(more))
    return every.select(key, "hash", "node").join(named, "node").select(key, "hash", "label")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest key stays.

    ``radius`` is in how many bits the fingerprints of pairs that operator 10 proposes differ.  Texts with similarity 0.8 or more are linked.  Texts without words are alike.  Equal
    rows (same key and text) count as one; rows without a key stay.
    """
    stays, seen, again, alone = (unused(docs, c) for c in ("_stays", "_seen", "_again", "_alone"))
    stay = _labelled(docs, key, text, radius).groupBy("label").agg(_least(key).alias("rep"))
    stay = stay.select(F.col("rep.key").alias(stays), F.col("rep.hash").alias(again))
    rows = docs.withColumn(seen, F.xxhash64(text))
    rows = rows.join(stay, (F.col(key) == F.col(stays)) & (F.col(seen) == F.col(again)), "left")
    rows = rows.filter(F.col(stays).isNotNull() | F.col(key).isNull())
    rows = rows.withColumn(alone, F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    return rows.dropDuplicates([key, seen, alone]).select(*docs.columns)
