"""Reports over results: detection by case and family, attempt states, graph elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import KEY, Facts
from textloom.plans.hunt import root_spans


def case_hits(results: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case (case_id, family, role, artifact_id) the sorted rules that hit any of its fragments."""
    hit = results.filter("status = 'HIT'").select("artifact_id", "rule_id").distinct()
    out = cases.join(hit, "artifact_id", "left")
    return out.groupBy("case_id", "family", "role").agg(F.sort_array(F.collect_set("rule_id")).alias("hits"))


def family_report(hits: DataFrame) -> DataFrame:
    """For each family: rules that hit its risky cases, and near misses that the same rules hit too."""
    risky = hits.filter("role = 'risky'").groupBy("family").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("risky_hits"))
    near = hits.filter("role = 'near_miss'").join(risky, "family").withColumn("shared", F.array_intersect("hits", "risky_hits"))
    worse = near.groupBy("family").agg(F.sum(F.size("shared")).cast("long").alias("regressions"), F.count(F.when(F.size("shared") > 0, 1)).alias("regressed_cases"))
    out = hits.select("family").distinct().join(risky, "family", "left").join(worse, "family", "left")
    none = F.array().cast("array<string>")
    return out.select("family", F.coalesce("risky_hits", none).alias("risky_hits"), F.coalesce("regressions", F.lit(0)).cast("long").alias("regressions"), F.coalesce("regressed_cases", F.lit(0)).cast("long").alias("regressed_cases"))


def summary(families: DataFrame) -> DataFrame:
    """Families that no rule covers, families with regressions, and the sum of regressions."""
    return families.agg(
        F.sort_array(F.collect_set(F.when(F.size("risky_hits") == 0, F.col("family")))).alias("zero_coverage"),
        F.sort_array(F.collect_set(F.when(F.col("regressions") > 0, F.col("family")))).alias("regressed"),
        F.coalesce(F.sum("regressions"), F.lit(0)).cast("long").alias("total_regressions"),
    )


def rule_status(results: DataFrame) -> DataFrame:
    """HIT for each rule and artifact that any reading hits."""
    hit = F.max((F.col("status") == "HIT").cast("int"))
    return results.groupBy("rule_id", "artifact_id").agg(F.when(hit == 1, "HIT").otherwise("NO_HIT").alias("status"), F.count("*").alias("fragments"))


def _node(id_: str) -> Column:
    """A record's name beyond its fragment."""
    return F.concat_ws(":", "artifact_id", F.col("ordinal").cast("string"), F.col(id_))


def graph_nodes(facts: Facts) -> DataFrame:
    """Nodes to draw: entities by their value or type, operations by their opcode."""
    none = F.lit(None).cast("string")
    entities = facts.entities.select(*KEY, "id", _node("id").alias("node_id"), F.coalesce("value", "type").alias("label"), F.lit("entity").alias("kind"), "type", "sensitivity", "trust")
    return entities.union(facts.operations.select(*KEY, "id", _node("id").alias("node_id"), F.col("op").alias("label"), F.lit("operation").alias("kind"), F.col("op").alias("type"), none.alias("sensitivity"), none.alias("trust")))


def graph_elements(facts: Facts) -> DataFrame:
    """Edges to draw: each operation's roles and each relationship, as (key, source, target, label)."""
    ops = facts.operations
    parts = [
        ops.select(*KEY, F.explode("inputs").alias("source"), F.col("id").alias("target"), F.lit("input").alias("label")),
        ops.select(*KEY, F.col("id").alias("source"), F.explode("outputs").alias("target"), F.lit("output").alias("label")),
        ops.filter("actor is not null").select(*KEY, F.col("actor").alias("source"), F.col("id").alias("target"), F.lit("actor").alias("label")),
        ops.filter("destination is not null").select(*KEY, F.col("id").alias("source"), F.col("destination").alias("target"), F.lit("destination").alias("label")),
        facts.relationships.select(*KEY, "source", "target", F.col("relation").alias("label")),
    ]
    return reduce(DataFrame.union, parts)


def by_root(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Results under the id of the source that their artifact belongs to."""
    roots = artifacts.select("artifact_id", "root_id").dropDuplicates(["artifact_id"])
    return results.join(roots, "artifact_id").withColumn("artifact_id", F.col("root_id")).drop("root_id")


def rule_matches(results: DataFrame, facts: Facts) -> DataFrame:
    """(rule_id, key, explanation, nodes, spans) of each hit: the matched records' names, and their places in the source's own text."""
    hit = results.filter("status = 'HIT'")
    nodes = F.transform(F.concat("matched_entity_ids", "matched_operation_ids", "matched_relationship_ids"), lambda i: F.concat_ws(":", "artifact_id", F.col("ordinal").cast("string"), i))
    roots = facts.artifacts.select("artifact_id", "root_id").dropDuplicates(["artifact_id"])
    rows = hit.select("rule_id", *KEY, F.posexplode("evidence").alias("k", "r")).select("rule_id", *KEY, "k", F.posexplode("r.spans").alias("j", "span"))
    at = root_spans(rows, facts.artifacts).join(roots, "artifact_id").filter("root.artifact_id = root_id")
    spans = at.groupBy("rule_id", *KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "j", F.struct("root.start", "root.end").alias("s")))), lambda x: x["s"]).alias("spans"))
    out = hit.select("rule_id", *KEY, "explanation", nodes.alias("nodes")).join(spans, ["rule_id", *KEY], "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))


def rule_summary(results: DataFrame) -> DataFrame:
    """HIT for each rule that any reading hits."""
    return results.groupBy("rule_id").agg(F.when(F.max((F.col("status") == "HIT").cast("int")) == 1, "HIT").otherwise("NO_HIT").alias("status"))


def text_tokens(facts: Facts) -> DataFrame:
    """(root_id, start, end, node_id, kind, type): where each record shows in its source's own text.

    Evidence in decoded texts is mapped to the input; what does not lead there is left out.
    """
    kinds = ((facts.entities, "entity", "type"), (facts.operations, "operation", "op"), (facts.relationships, "relationship", "relation"))
    rows = [df.select(*KEY, _node("id").alias("node_id"), F.lit(kind).alias("kind"), F.col(name).alias("type"), F.explode("evidence").alias("span")) for df, kind, name in kinds]
    roots = facts.artifacts.select("artifact_id", "root_id").dropDuplicates(["artifact_id"])
    found = root_spans(reduce(DataFrame.union, rows), facts.artifacts).join(roots, "artifact_id").filter("root.artifact_id = root_id")
    return found.select("root_id", "root.start", "root.end", "node_id", "kind", "type")


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """For each artifact how many readings ended in each stage."""
    return attempts.groupBy("artifact_id", "stage").agg(F.count("*").alias("attempts"))


def attempt_list(attempts: DataFrame) -> DataFrame:
    """(key, state, codes) of every attempt."""
    return attempts.select(*KEY, F.col("stage").alias("state"), F.transform("diagnostics", lambda d: d["code"]).alias("diagnostics"))


def lift_report(attempts: DataFrame, diagnostics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """For each artifact its attempts by ordinal (state and codes only) and the codes of its unpacking."""
    listed = attempt_list(attempts).groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "state", "diagnostics"))).alias("attempts"))
    unpacked = diagnostics.filter("code like 'unpack%'").groupBy("artifact_id").agg(F.sort_array(F.collect_list("code")).alias("unpack_diagnostics"))
    out = artifacts.select("artifact_id").distinct().join(listed, "artifact_id", "left").join(unpacked, "artifact_id", "left")
    none = F.array().cast("array<struct<ordinal:int,state:string,diagnostics:array<string>>>")
    return out.select("artifact_id", F.coalesce("attempts", none).alias("attempts"), F.coalesce("unpack_diagnostics", F.array().cast("array<string>")).alias("unpack_diagnostics"))


def reading_report(facts: Facts, accepted: DataFrame) -> DataFrame:
    """(key, fragment): each accepted reading's canonical facts as JSON, by id."""
    out = accepted.select(*KEY)
    for name in ("entities", "operations", "relationships"):
        df = getattr(facts, name)
        record = F.struct(*(c for c in sorted(df.columns) if c not in KEY))
        rows = df.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", record.alias("r")))), lambda x: x["r"]).alias(name))
        out = out.join(rows, KEY, "left")
    full = F.struct(F.col("artifact_id"), *(F.col(n) for n in ("entities", "operations", "relationships")), F.lit("1.0").alias("schema_version"))
    return out.select(*KEY, F.to_json(full, {"ignoreNullFields": "false"}).alias("fragment"))


def rule_test(hunted: DataFrame) -> DataFrame:
    """(key, rule_id, status, hints) of a hunt; hints are null where nothing was hit."""
    return hunted.select("rule_id", *KEY, "status", F.when(F.col("status") == "HIT", F.col("hints")).alias("hints"))


def incomplete(attempts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(root_id, incomplete): the attempts of each source that gave no facts, with their codes."""
    bad = attempt_list(attempts.filter("stage <> 'accepted'")).join(artifacts.select("artifact_id", "root_id", "position").dropDuplicates(["artifact_id"]), "artifact_id")
    return bad.groupBy("root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "ordinal", "diagnostics"))), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["diagnostics"].alias("diagnostics"))).alias("incomplete"))


def diagnostic_codes(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("code").distinct()


def scan_report(artifacts: DataFrame, annotations: DataFrame, children: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row an artifact: how much of each was seen."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("artifact_id")).agg(F.count("*").alias(name))
    out = artifacts.groupBy("artifact_id").agg(F.count("*").alias("occurrences"))
    for part in (count(annotations, "artifact_id", "annotations"), count(children, "root_id", "virtual_children"), count(diagnostics, "root_id", "decode_diagnostics")):
        out = out.join(part, "artifact_id", "left")
    return out.na.fill(0)
