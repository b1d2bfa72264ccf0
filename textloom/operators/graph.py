"""Graph queries over facts; every table carries its fragment's key.

A fragment is one accepted reading of one artifact, keyed (artifact_id, ordinal).  No
query crosses fragments, so every join here is on that key and partitions by it.
``entities``, ``operations`` and ``relationships`` have the columns of ``schemas``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import regex, vocab
from textloom.plans.materialize import materialized
from textloom.shipping import ship

KEY = ["artifact_id", "ordinal"]


@dataclass(frozen=True)
class Facts:
    """The facts of many fragments; ``artifacts`` (artifact_id, source_name, text, decode_provenance) may be left out.

    ``whole`` is kept by ``made_of``: rows of whole fragments and the tables they hold the records of; ``lean`` makes
    the same rows with ``_entities``, ``_operations`` and ``_relationships``, of the fields and relations asked for alone.
    """

    entities: DataFrame
    operations: DataFrame
    relationships: DataFrame
    artifacts: DataFrame | None = None
    whole: tuple[DataFrame, ...] | None = field(default=None, compare=False)
    lean: Callable[[dict[str, list[str]], set[str] | None], DataFrame] | None = field(default=None, compare=False)

    def settled(self) -> Facts:
        """The same facts, written once; for rules that read them many times."""
        return replace(self, entities=materialized(self.entities), operations=materialized(self.operations), relationships=materialized(self.relationships))

    def made_of(self, fragments: DataFrame, lean=None) -> Facts:
        """The same facts with ``fragments`` (as of ``fragments()``) for the same records, so that none need be gathered."""
        return replace(self, whole=(fragments, self.entities, self.operations, self.relationships), lean=lean)

    def known(self) -> DataFrame | None:
        """The rows of ``made_of``, unless a table has been replaced since."""
        if self.whole and all(a is b for a, b in zip(self.whole[1:], (self.entities, self.operations, self.relationships))):
            return self.whole[0]
        return None

    def fragments(self) -> DataFrame:
        """(key, entities, operations, relationships): one row for each fragment with a record, its records as arrays."""
        if (known := self.known()) is not None:
            return known
        tables = {"entities": self.entities, "operations": self.operations, "relationships": self.relationships}
        record = {n: F.struct(*(c for c in df.columns if c not in KEY)) for n, df in tables.items()}
        kind = {n: df.select(record[n].alias("x")).schema["x"].dataType for n, df in tables.items()}
        each = [df.select(*KEY, *((record[n] if n == own else F.lit(None).cast(kind[n])).alias(n) for n in tables)) for own, df in tables.items()]
        return reduce(DataFrame.union, each).groupBy(*KEY).agg(*(F.collect_list(n).alias(n) for n in tables))

    def keys(self) -> DataFrame:
        if (known := self.known()) is not None:
            return known.select(*KEY)
        every = self.entities.select(*KEY).union(self.operations.select(*KEY)).union(self.relationships.select(*KEY))
        return every.distinct()


def pattern_matches(value: Column, pattern: str) -> Column:
    """Whether Python's ``re.search`` finds a pattern in a value; null for a null value.

    Patterns are translated to Java's dialect; one with a construct that Java lacks (a
    condition on a group) runs in Python, in Arrow batches.
    """
    translated = regex.java(pattern)
    if translated is not None:
        return value.rlike(translated)
    search = re.compile(pattern).search
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else search(v) is not None), "boolean")(value)


def entity_predicate(filters: dict) -> Column:
    out = F.lit(True)
    for name, want in filters.items():
        out &= pattern_matches(F.col("value"), want) if name == "value_pattern" else F.col(name).eqNullSafe(F.lit(want))
    return F.coalesce(out, F.lit(False))


def operation_predicate(filters: dict) -> Column:
    out = F.lit(True)
    for name, want in filters.items():
        out &= F.col("op" if name == "op" else f"modality.{name}") == want
    return F.coalesce(out, F.lit(False))


def select_entities(entities: DataFrame, **filters) -> DataFrame:
    """Entities that meet every filter: equality, or ``value_pattern``, which is searched for."""
    unknown = set(filters) - {"type", "subtype", "value", "value_pattern", "sensitivity", "trust", "underspecified"}
    if unknown:
        raise ValueError(f"unknown entity filters {sorted(unknown)}")
    return entities.filter(entity_predicate(filters))


def select_operations(operations: DataFrame, **filters) -> DataFrame:
    unknown = set(filters) - {"op", "polarity", *vocab.MODALITY_FLAGS}
    if unknown:
        raise ValueError(f"unknown operation filters {sorted(unknown)}")
    return operations.filter(operation_predicate(filters))


def direct_relationships(relationships: DataFrame, source: str | None = None, relation: str | None = None, target: str | None = None) -> DataFrame:
    out = relationships
    for name, want in (("source", source), ("relation", relation), ("target", target)):
        if want is not None:
            out = out.filter(F.col(name) == want)
    return out


def trust_boundaries(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships whose two ends are trusted differently (UNKNOWN is a value like any other)."""
    ends = entities.select(*KEY, "id", "trust")
    out = relationships.join(ends.withColumnRenamed("id", "source").withColumnRenamed("trust", "_one"), [*KEY, "source"])
    out = out.join(ends.withColumnRenamed("id", "target").withColumnRenamed("trust", "_two"), [*KEY, "target"])
    return out.filter(F.col("_one") != F.col("_two")).select(*relationships.columns)


def edges_of(relationships: DataFrame, kind: str = "relationship") -> DataFrame:
    """(key, source, target, edge) of all relationships, or of the derivations only."""
    chosen = relationships.filter("relation = 'DERIVED_FROM'") if kind == "derivation" else relationships
    return chosen.select(*KEY, "source", "target", F.col("id").alias("edge"))


def operation_edges(operations: DataFrame) -> DataFrame:
    """(key, source, target, edge) from each operation to those that take one of its outputs."""
    made = operations.select(*KEY, F.col("id").alias("source"), F.explode("outputs").alias("entity"))
    used = operations.select(*KEY, F.col("id").alias("target"), F.explode("inputs").alias("entity"))
    return made.join(used, [*KEY, "entity"]).select(*KEY, "source", "target", F.col("target").alias("edge")).distinct()


def _within(hop: DataFrame, frontier: DataFrame, max_depth: int) -> DataFrame:
    """As ``reachable``, with a bound: each round is one join with the nodes' neighbours, and stays are kept along."""
    near = hop.groupBy(*KEY, "target").agg(F.collect_set("_next").alias("_near"))
    none = F.array().cast("array<string>")
    for _ in range(max_depth):
        step = frontier.join(near, [*KEY, "target"], "left")
        frontier = step.select(*KEY, "source", F.explode(F.concat(F.array("target"), F.coalesce("_near", none))).alias("target")).distinct()
    return frontier


def _gathered(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, links, asked): one row for each fragment that is asked about, its edges (a, b, edge) and what is asked (a, b) as arrays."""
    links = edges.select(*KEY, F.struct(F.col("source").alias("a"), F.col("target").alias("b"), "edge").alias("x")).groupBy(*KEY).agg(F.collect_list("x").alias("links"))
    pairs = asked.select(*KEY, F.struct("a", "b").alias("x")).groupBy(*KEY).agg(F.collect_set("x").alias("asked"))
    return pairs.join(links, KEY, "left").select("artifact_id", F.col("ordinal").cast("int").alias("ordinal"), "links", "asked")


def _lists(column: pa.Array, names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of structs of each value of a list column; a null has none."""
    parts = column.flatten()
    rows = list(zip(*(parts.field(n).to_pylist() for n in names)))
    at = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield rows[at : at + n]
        at += n


def _walked(edges: DataFrame, asked: DataFrame, walk, kind: str, schema: pa.Schema) -> DataFrame:
    """Rows of ``walk`` (edges, asked) of each fragment, under its key.

    Each fragment's edges and questions are gathered as one row, so rows dealt out by the key
    stay where they are, and a worker holds one fragment, which is one document's reading.
    """
    whole = pa.schema([("artifact_id", pa.string()), ("ordinal", pa.int32()), *schema])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            links, questions = _lists(batch.column(2), ("a", "b", "edge")), _lists(batch.column(3), ("a", "b"))
            for artifact, ordinal, near, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), links, questions):
                for row in walk(near, pairs):
                    out.append((artifact, ordinal, *row))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), whole)], schema=whole)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), whole)], schema=whole)

    ship(edges.sparkSession)
    return _gathered(edges, asked).mapInArrow(run, f"artifact_id string, ordinal int, {kind}")


PATH = "source string, sink string, nodes array<string>, edges array<string>"
PATH_SCHEMA = pa.schema([("source", pa.string()), ("sink", pa.string()), ("nodes", pa.list_(pa.string())), ("edges", pa.list_(pa.string()))])


def reached(links: list[tuple], asked: list[tuple], max_depth: int | None = None) -> Iterator[tuple[str, set[str]]]:
    """Each asked node with the nodes within its reach, itself included."""
    near: dict[str, set[str]] = {}
    for a, b, _ in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
    for source, _ in asked:
        seen, front, left = {source}, [source], max_depth
        while front and (left is None or left > 0):
            front = [n for f in front for n in near.get(f, ()) if n not in seen and not seen.add(n)]
            left = None if left is None else left - 1
        yield source, seen


def reachable(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(key, source, target) for every node within reach of (key, source), itself included.

    Without a bound this is a breadth-first search within each fragment, in a worker: its work
    is bounded by the pairs found, whatever the number of paths, and nothing is written between rounds.
    """
    if max_depth is not None:
        hop = edges.select(*KEY, F.col("source").alias("target"), F.col("target").alias("_next")).distinct()
        frontier = sources.select(*KEY, "source", F.col("source").alias("target")).distinct()
        return _within(hop, frontier, max_depth)
    asked = sources.select(*KEY, F.col("source").alias("a"), F.lit(None).cast("string").alias("b"))

    def walk(links: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        return ((source, node) for source, seen in reached(links, asked) for node in seen)

    return _walked(edges.withColumn("edge", F.lit(None).cast("string")), asked, walk, "source string, target string", pa.schema([("source", pa.string()), ("target", pa.string())]))


def reach_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, source, n): how many nodes are within reach of (key, source), itself included; counted where they are walked."""

    def walk(links: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        return ((source, len(seen)) for source, seen in reached(links, asked))

    asked = sources.select(*KEY, F.col("source").alias("a"), F.lit(None).cast("string").alias("b"))
    return _walked(edges.withColumn("edge", F.lit(None).cast("string")), asked, walk, "source string, n long", pa.schema([("source", pa.string()), ("n", pa.int64())]))


def _simple(links: list[tuple], asked: list[tuple], max_depth: int | None) -> Iterator[tuple]:
    near: dict[str, list[tuple]] = {}
    back: dict[str, set[str]] = {}
    for a, b, edge in links:
        if a is not None and b is not None:
            near.setdefault(a, []).append((b, edge))
            back.setdefault(b, set()).add(a)
    for source, sink in asked:
        if source is None or sink is None:
            continue
        open_, front = {sink}, [sink]
        while front:
            front = [n for f in front for n in back.get(f, ()) if n not in open_ and not open_.add(n)]
        waiting = [((source,), ())] if source in open_ else []
        while waiting:
            nodes, walked = waiting.pop()
            if nodes[-1] == sink:
                yield source, sink, nodes, walked
            elif max_depth is None or len(walked) < max_depth:
                waiting += [((*nodes, b), (*walked, edge)) for b, edge in near.get(nodes[-1], ()) if b in open_ and b not in nodes]


def paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All simple paths (key, source, sink, nodes, edges) between the (key, source, sink) of ``pairs``.

    Only nodes that can still reach the sink are entered.  A path from a node to itself has no
    edges.  A worker walks one fragment at a time and hands out each path as it is found.
    """

    def walk(links: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        return ((source, sink, list(nodes), list(walked)) for source, sink, nodes, walked in _simple(links, asked, max_depth))

    asked = pairs.select(*KEY, F.col("source").alias("a"), F.col("sink").alias("b"))
    return _walked(edges, asked, walk, PATH, PATH_SCHEMA)


def path_counts(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(key, source, sink, n, longest): the number of ``paths`` of each pair that has some, and the most edges of one.

    A worker counts each path as it is found, so none is handed out.
    """

    def walk(links: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        for (source, sink), found in groupby(_simple(links, asked, max_depth), lambda way: way[:2]):
            n = longest = 0
            for *_, walked in found:
                n, longest = n + 1, max(longest, len(walked))
            yield source, sink, n, longest

    asked = pairs.select(*KEY, F.col("source").alias("a"), F.col("sink").alias("b"))
    schema = pa.schema([("source", pa.string()), ("sink", pa.string()), ("n", pa.int64()), ("longest", pa.int64())])
    return _walked(edges, asked, walk, "source string, sink string, n long, longest long", schema)


def neighbours(links: list[tuple]) -> dict[str, dict[str, str]]:
    """The neighbours of each node, each with its smallest edge."""
    near: dict[str, dict[str, str]] = {}
    for a, b, edge in links:
        if edge is not None and a is not None and b is not None:
            own = near.setdefault(a, {})
            own[b] = min(edge, own.get(b, edge))
    return near


def first_path(near: dict[str, dict[str, str]], source: str, sink: str, depth: int | None) -> tuple[list[str], list[str]] | None:
    """The simple path that comes first: at each node the smallest neighbour from which the rest can still be walked."""

    def open_(start: str, steps: int | None, shut: set[str]) -> bool:
        """Whether the sink is within so many steps without entering ``shut``."""
        seen, front = {start}, [start]
        while front and sink not in seen and (steps is None or steps > 0):
            front = [n for f in front for n in near.get(f, ()) if n not in seen and n not in shut and not seen.add(n)]
            steps = None if steps is None else steps - 1
        return sink in seen

    nodes, edges, walked = [source], [], {source}
    if not open_(source, depth, set()):
        return None
    while nodes[-1] != sink:
        left = None if depth is None else depth - len(edges) - 1
        node = next(n for n in sorted(near[nodes[-1]]) if n not in walked and open_(n, left, walked))
        edges.append(near[nodes[-1]][node])
        nodes.append(node)
        walked.add(node)
    return nodes, edges


def first_paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """For each pair (key, source, sink) the simple path that comes first by its nodes, then its edges.

    Listing all simple paths is exponential, and a join cannot look ahead, so this one walk
    is Python's.  A walk costs at most nodes x edges of a fragment, which is one document's
    reading and is held whole.
    """

    def walk(links: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        near = neighbours(links)
        for a, b in asked:
            if found := first_path(near, a, b, max_depth):
                yield a, b, *found

    asked = pairs.select(*KEY, F.col("source").alias("a"), F.col("sink").alias("b"))
    return _walked(edges, asked, walk, PATH, PATH_SCHEMA)
