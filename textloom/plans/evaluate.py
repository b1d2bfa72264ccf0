"""Evaluation of rules over facts: the first complete match of each fragment.

Each fragment's records are one row, and ``plans.match`` finds its first match there, in a
worker that gets only the records and fields that the rules read and gives back the ids of the records
that the match rests on.  Their evidence is taken from the same row, so nothing is dealt out,
sorted or written for a rule, and facts that are made as whole fragments are not even gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import KEY, Facts
from textloom.plans.match import SPAN, matcher, needs, relations, variants
from textloom.plans.materialize import materialized  # noqa: F401, a name that tests watch: evaluation writes nothing
from textloom.plans.rules import Rule
from textloom.shipping import ship

RESULT = (
    "rule_id string, artifact_id string, ordinal int, status string, matched_entity_ids array<string>, matched_operation_ids array<string>, "
    "matched_relationship_ids array<string>, evidence array<struct<record_id:string,record_type:string,spans:array<struct<artifact_id:string,start:int,end:int>>>>, explanation string"
)
KINDS = {"entities": "entity", "operations": "operation", "relationships": "relationship"}
AT_ONCE = 1_000  # fragments whose records a worker holds as Python objects
IDS = pa.struct([(k, pa.list_(pa.string())) for k in KINDS])


def first_span(evidence: Column) -> Column:
    return F.array_min(evidence)


def _field(table: str, x: Column, name: str) -> Column:
    if name in SPAN:
        return first_span(x["evidence"])[SPAN[name]]
    return x["modality"][name] if table == "operations" and name not in ("id", "op", "actor", "inputs", "outputs", "destination", "underspecified") else x[name]


def _seen(rules: list[Rule], table: str, x: Column) -> Column:
    """Whether any of the rules looks at a record."""
    out = F.lit(False)
    for rule in rules:
        if table == "relationships":
            names = relations(rule)
            ways = None if names is None else [x["relation"].isin(*names)] if names else []
        else:
            equal = variants(rule, KINDS[table])
            ways = None if equal is None else [reduce(Column.__and__, (_field(table, x, k).eqNullSafe(F.lit(w)) for k, w in v.items()), F.lit(True)) for v in equal]
        if ways is None:
            return F.lit(True)
        out = reduce(Column.__or__, ways, out)
    return F.coalesce(out, F.lit(False))


def _read(rules: list[Rule], table: str, fields: list[str]) -> Column:
    """The records of a fragment that the rules look at, with the fields that the rules read."""
    return F.transform(F.filter(table, lambda x: _seen(rules, table, x)), lambda x: F.struct(*(_field(table, x, n).alias(n) for n in fields)))


def _records(column: pa.Array, fields: list[str]) -> Iterator[list[dict]]:
    rows = column.flatten()
    rows = [dict(zip(fields, r)) for r in zip(*(rows.field(n).to_pylist() for n in fields))]
    at = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield rows[at : at + n]
        at += n


def _fields(rules: list[Rule]) -> dict[str, list[str]]:
    """The fields that any of the rules reads, by table."""
    read: dict[str, list[str]] = {k: [] for k in KINDS}
    for rule in rules:
        for k, v in needs(rule).items():
            read[k] = list(dict.fromkeys([*read[k], *v]))
    return {k: v for k, v in read.items() if v}


def first_matches(rules: list[Rule], read: dict[str, list[str]], columns: list[Column]) -> Column:
    """For each rule the ids (entities, operations, relationships) of the records that a fragment's first match rests on; null without one.

    ``columns`` are the records, with the fields ``read``; the worker gets each once for all the rules.
    """
    matches = [matcher(rule) for rule in rules]

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(columns[0]), AT_ONCE):
            parts = {k: _records(c.slice(at, AT_ONCE), f) for c, (k, f) in zip(columns, read.items())}
            size = len(columns[0].slice(at, AT_ONCE))
            for rows in zip(*(parts.get(k, [[]] * size) for k in KINDS)):
                found = (match(*rows) for match in matches)
                out.append([f and {k: list(dict.fromkeys(r[i]["id"] for i in places)) for k, r, places in zip(KINDS, rows, f)} for f in found])
        return pa.array(out, pa.list_(IDS))

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    kind = "array<struct<entities:array<string>,operations:array<string>,relationships:array<string>>>"
    return F.arrow_udf(run, kind)(*columns)


def evaluate(rule: Rule, facts: Facts, keys: DataFrame | None = None) -> DataFrame:
    """One row for each fragment of ``keys`` (all of them by default): HIT with its evidence, or NO_HIT."""
    return evaluate_all([rule], facts, keys)


def evaluate_all(rules: list[Rule], facts: Facts, keys: DataFrame | None = None) -> DataFrame:
    """The same for several rules, a row for each fragment and rule: each fragment is made and read once for all of them."""
    ship(facts.entities.sparkSession)
    read = _fields(rules)
    if facts.known() is not None and facts.lean:
        named = [relations(rule) for rule in rules]
        whole = facts.lean(read, None if None in named else set().union(*named))
        whole = whole.select(*KEY, *KINDS, *(f"_{k}" for k in read))
    else:
        whole = facts.fragments()
        whole = whole.select(*KEY, *KINDS, *(_read(rules, k, f).alias(f"_{k}") for k, f in read.items()))
    codecs = [[c.spec.get("codec") for c in rule.where if c.name == "decoded_from"] for rule in rules]
    good: dict[str | None, Column] = {}
    for codec in {c: None for one in codecs for c in one}:
        name, made = f"_good{len(good)}", F.col("decode_provenance.codec")
        some = facts.artifacts.filter(made.isNotNull() if codec is None else made == codec)
        whole = whole.join(some.select("artifact_id").distinct().withColumn(name, F.lit(True)), "artifact_id", "left")
        good[codec] = F.coalesce(F.col(name), F.lit(False))
    may = [reduce(Column.__and__, (good[c] for c in one), F.lit(True)) for one in codecs]
    if all(codecs):  # without records nothing matches
        some = reduce(Column.__or__, may)
        whole = whole.withColumns({f"_{k}": F.when(some, F.col(f"_{k}")) for k in read})
    found = whole.withColumn("_found", first_matches(rules, read, [F.col(f"_{k}") for k in read]))
    each = F.array(*(F.struct(F.lit(i).alias("_rule"), F.when(m, F.get("_found", F.lit(i))).alias("_at")) for i, m in enumerate(may)))
    if len(rules) == 1:
        found = found.select(*KEY, *KINDS, F.lit(0).alias("_rule"), F.when(may[0], F.get("_found", F.lit(0))).alias("_at"))
    else:
        found = found.select(*KEY, *KINDS, F.explode(each).alias("_x")).select(*KEY, *KINDS, "_x.*")

    # The records of the match, all those of its ids.
    one = lambda k: F.filter(k, lambda r: F.array_contains(F.col(f"_at.{k}"), r["id"]))
    ids = lambda k: F.array_sort(f"_at.{k}")

    def rests(k: str) -> Column:
        spans = lambda r: F.array_sort(r["evidence"])
        return F.transform(one(k), lambda r: F.struct(F.get(spans(r), F.lit(0)).alias("first"), r["id"].alias("record_id"), F.lit(KINDS[k]).alias("record_type"), spans(r).alias("spans")))

    evidence = F.transform(F.array_sort(F.concat(*(rests(k) for k in KINDS))), lambda r: F.struct(r["record_id"].alias("record_id"), r["record_type"].alias("record_type"), r["spans"].alias("spans")))
    columns = {f"matched_{kind}_ids": ids(k) for k, kind in KINDS.items()} | {"evidence": F.when(F.col("_at").isNotNull(), evidence)}
    out = found.select(*KEY, "_rule", F.col("_at").isNotNull().alias("_hit"), *(v.alias(k) for k, v in columns.items()))
    if keys is not None:
        every = keys.select(*KEY, F.lit(0).alias("_rule")) if len(rules) == 1 else keys.select(*KEY, F.explode(F.array(*map(F.lit, range(len(rules))))).alias("_rule"))
        out = every.join(out.filter("_hit"), [*KEY, "_rule"], "left")
    by_rule = lambda values: F.get(F.array(*map(F.lit, values)), F.col("_rule")) if len(rules) > 1 else F.lit(values[0])
    said = by_rule([f"{rule.id}: {', '.join(c.name for c in rule.where)}" for rule in rules])
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return out.select(
        by_rule([rule.id for rule in rules]).alias("rule_id"), *KEY, F.when(F.col("_hit"), "HIT").otherwise("NO_HIT").alias("status"),
        *(empty(f"matched_{kind}_ids", "array<string>") for kind in KINDS.values()),
        empty("evidence", "array<struct<record_id:string,record_type:string,spans:array<struct<artifact_id:string,start:int,end:int>>>>"),
        F.when(F.col("_hit"), said).alias("explanation"),
    )
