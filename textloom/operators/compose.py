"""Composition: static entities merged into readings, encoded values linked to their decoded children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.operators.canonical import canonical_entities, entity_conflicts, union_of
from textloom.operators.graph import KEY, Facts
from textloom.operators.indicators import entities as static_entities
from textloom.plans.materialize import materialized

COLUMNS = ["id", "type", "subtype", "value", "sensitivity", "trust", "evidence", "confidence", "underspecified"]


def merge_static(entities: DataFrame, static: DataFrame, keys: DataFrame) -> DataFrame:
    """``entities`` of the fragments in ``keys`` with each artifact's ``static`` entities (by artifact_id) merged in.

    Of one id the reading's properties stay and the evidence is united; an EXTERNAL network
    destination seen in the text is EXTERNAL in the reading too.
    """
    mine = entities.select(*KEY, *COLUMNS).join(keys.select(*KEY), KEY, "left_semi")
    theirs = static.select("artifact_id", *(F.col(c).alias(f"s_{c}") for c in COLUMNS)).join(keys.select(*KEY), "artifact_id").withColumnRenamed("s_id", "id")
    out = mine.join(theirs, [*KEY, "id"], "full_outer")
    merged = {c: F.when(F.col("type").isNull(), F.col(f"s_{c}")).otherwise(F.col(c)) for c in COLUMNS if c not in ("id", "evidence", "trust")}
    outside = (F.col("s_type") == "NETWORK_DESTINATION") & (F.col("s_trust") == "EXTERNAL")
    trust = F.when(F.col("type").isNull() | outside, F.col("s_trust")).otherwise(F.col("trust"))
    none = F.array().cast("array<struct<artifact_id:string,start:int,end:int>>")
    evidence = union_of(F.array(F.coalesce("evidence", none), F.coalesce("s_evidence", none)))
    return out.select(*KEY, "id", *(v.alias(c) for c, v in merged.items()), trust.alias("trust"), evidence.alias("evidence")).select(*KEY, *COLUMNS)


def enriched(facts: Facts, keys: DataFrame) -> Facts:
    """Facts with the static entities of every accepted fragment's artifact; a conflict among these leaves an artifact as it is."""
    raw = static_entities(facts.artifacts.select("artifact_id", "text").dropDuplicates(["artifact_id"])).withColumn("ordinal", F.lit(0))
    bad = entity_conflicts(raw).select("artifact_id").distinct()
    static, _ = canonical_entities(raw.join(bad, "artifact_id", "left_anti"))
    return Facts(merge_static(facts.entities, static.drop("ordinal"), keys), facts.operations, facts.relationships, facts.artifacts)


def _spans(facts: Facts, keys: DataFrame) -> DataFrame:
    """(artifact_id, child, child_ordinal, size, at, value): the text that each decoded child with an accepted reading was made from.

    ``at`` is the child's place among the artifacts; children act in this order.
    """
    first = keys.groupBy(F.col("artifact_id").alias("child")).agg(F.min("ordinal").alias("child_ordinal"))
    artifacts = facts.artifacts.dropDuplicates(["artifact_id"])
    place = F.col("position") if "position" in artifacts.columns else F.lit(0)
    children = artifacts.filter("decode_provenance is not null").select(F.col("artifact_id").alias("child"), F.col("decode_provenance.parent_span").alias("span"), F.length("text").alias("size"), place.alias("at"))
    parents = artifacts.select("artifact_id", "text")
    out = children.join(first, "child").join(parents, F.col("span.artifact_id") == F.col("artifact_id"))
    return out.select("artifact_id", "child", "child_ordinal", "size", "at", F.expr("substring(text, span.start + 1, span.end - span.start)").alias("value"))


def _linked(raw: DataFrame, spans: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, raw_id, raw_confidence, at, r): each raw entity with the one child entity that its value decodes to.

    An encoded blob is linked to the one child entity that stands for the whole decoded
    text, any other entity to the one child entity of its type; more or fewer than one is no
    link.  ``entities`` are those of before any linking.
    """
    named = raw.join(spans, ["artifact_id", "value"]).filter(F.col("at") > F.col("after"))
    theirs = entities.select(F.col("artifact_id").alias("child"), F.col("ordinal").alias("child_ordinal"), F.struct(*COLUMNS).alias("r"))
    full = F.array(F.struct(F.col("child").alias("artifact_id"), F.lit(0).alias("start"), F.col("size").alias("end")))
    fits = F.when(F.col("raw_type") == "ENCODED_DATA", F.col("r.evidence") == full).otherwise(F.col("r.type") == F.col("raw_type"))
    pairs = named.join(theirs, ["child", "child_ordinal"]).filter(fits)
    return pairs.groupBy(*KEY, "raw_id", "raw_confidence", "child", "at").agg(F.count("*").alias("n"), F.min("r").alias("r")).filter("n = 1").drop("n", "child")


def decoded_links(facts: Facts, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DECODES_TO relationships and the child entities to copy, for entities whose value is a decoded span.

    A child is read by its first accepted fragment, as it was before any linking.  An entity
    that was copied from one child can itself be decoded by a later one, so this goes on
    until nothing new is copied; where nothing is, that is one round.
    """
    spans = materialized(_spans(facts, keys))
    mine = facts.entities.join(keys.select(*KEY), KEY, "left_semi")
    raw = mine.select(*KEY, F.col("id").alias("raw_id"), F.col("type").alias("raw_type"), "value", F.col("confidence").alias("raw_confidence"), F.lit(-1).alias("after"))
    found = every = materialized(_linked(raw, spans, facts.entities))
    while not found.isEmpty():
        raw = found.select(*KEY, F.col("r.id").alias("raw_id"), F.col("r.type").alias("raw_type"), F.col("r.value").alias("value"), F.col("r.confidence").alias("raw_confidence"), F.col("at").alias("after"))
        found = materialized(_linked(raw.filter("value is not null"), spans, facts.entities))
        every = every.union(found)
    links = every.select(
        *KEY, ids.decodes_to_id(F.col("raw_id"), F.col("r.id")).alias("id"), F.col("raw_id").alias("source"), F.lit("DECODES_TO").alias("relation"), F.col("r.id").alias("target"),
        F.col("r.evidence").alias("evidence"), F.least("raw_confidence", "r.confidence").alias("confidence"), F.lit(False).alias("underspecified"), "at",
    )
    # Of one id the last child's stands.
    last = lambda df, names: df.groupBy(*KEY, "id").agg(*(F.max_by(c, "at").alias(c) for c in names))
    names = [c for c in links.columns if c not in (*KEY, "id", "at")]
    copied = every.select(*KEY, "at", "r.*")
    return last(links, names), last(copied, [c for c in COLUMNS if c != "id"]).select(*KEY, *COLUMNS)


def resolved(facts: Facts, keys: DataFrame) -> Facts:
    """Facts with the decoded links of ``decoded_links`` and the entities they point at."""
    links, copied = decoded_links(facts, keys)
    kept_entities = facts.entities.join(copied.select(*KEY, "id"), [*KEY, "id"], "left_anti")
    names = facts.relationships.columns
    kept = facts.relationships.join(links.select(*KEY, "id"), [*KEY, "id"], "left_anti")
    return Facts(kept_entities.select(*KEY, *COLUMNS).union(copied.select(*KEY, *COLUMNS)), facts.operations, kept.select(*names).union(links.select(*names)), facts.artifacts)
