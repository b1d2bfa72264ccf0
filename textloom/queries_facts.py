"""Registered queries over facts, graphs, rules and hunts, and the same in DuckDB's SQL.

The readings are those of ``plans.sample_facts``: built from the order tables for this
purpose, since no table holds any.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.operators import canonical, compose, graph, validate
from textloom.operators.graph import KEY, Facts
from textloom.operators.indicators import entities as static_entities
from textloom.plans import evaluate, hunt, lift, reports, rules
from textloom.plans.sample_facts import SQL, order_facts, table
from textloom.queries_scan import STATIC_SQL

W = f"WITH RECURSIVE {SQL}"


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


# Graph queries.


def direct_rel(spark, sf_dir):
    return graph.direct_relationships(order_facts(spark, sf_dir).relationships, relation="SENT_TO", source="order").select("artifact_id", "source", "target")


def entity_filter(spark, sf_dir):
    return graph.select_entities(order_facts(spark, sf_dir).entities, type="USER_DATA", trust="UNTRUSTED", subtype="BUILDING").select("artifact_id", "id", "value")


def value_pattern(spark, sf_dir):
    return graph.select_entities(order_facts(spark, sf_dir).entities, value_pattern=r"^part-\d*7\b").select("artifact_id", "id", "value")


def modality_filter(spark, sf_dir):
    return graph.select_operations(order_facts(spark, sf_dir).operations, polarity="positive", imperative=True, conditional=False).select("artifact_id", "id", "op")


def trust_boundary(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    return graph.trust_boundaries(facts.relationships, facts.entities).select("artifact_id", "id")


def _suppliers(facts: Facts) -> DataFrame:
    return facts.entities.filter("type = 'NETWORK_DESTINATION'").select(*KEY, F.col("id").alias("source"))


def path_exists(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    return graph.reach_counts(graph.edges_of(facts.relationships), _suppliers(facts)).select("artifact_id", "source", F.col("n").alias("within_reach"))


def first_path(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    found = graph.first_paths(graph.edges_of(facts.relationships), _suppliers(facts).withColumn("sink", F.lit("region")))
    return found.select("artifact_id", "source", _joined("nodes"), _joined("edges"))


def all_paths(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    return graph.path_counts(graph.edges_of(facts.relationships), _suppliers(facts).withColumn("sink", F.lit("region"))).select("artifact_id", "source", "n", "longest")


def derivation_path(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    found = graph.first_paths(graph.edges_of(facts.relationships, "derivation"), _suppliers(facts).withColumn("sink", F.lit("customer")))
    return found.select("artifact_id", "source", _joined("nodes"))


def distance_k(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    found = graph.reachable(graph.edges_of(facts.relationships), facts.entities.filter("id = 'region' or id = 'order'").select(*KEY, F.col("id").alias("source")), 2)
    return found.select("artifact_id", "source", "target")


def op_sequence(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    ops = facts.operations
    pairs = ops.filter("id = 'op.1'").select(*KEY, F.col("id").alias("source")).join(ops.select(*KEY, F.col("id").alias("sink")), KEY)
    found = graph.first_paths(graph.operation_edges(ops), pairs)
    return found.select("artifact_id", "sink", _joined("nodes"))


def graph_elements(spark, sf_dir):
    return reports.graph_elements(order_facts(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


REACH = "reach AS (SELECT artifact_id, id AS source, id AS node FROM ent WHERE type = 'NETWORK_DESTINATION' UNION SELECT r.artifact_id, r.source, e.target FROM reach r JOIN rel e ON e.artifact_id = r.artifact_id AND e.source = r.node)"
WAYS = (
    "ways AS (SELECT artifact_id, id AS source, id AS node, [id] AS nodes, []::VARCHAR[] AS edges FROM ent WHERE type = 'NETWORK_DESTINATION' "
    "UNION ALL SELECT w.artifact_id, w.source, e.target, list_append(w.nodes, e.target), list_append(w.edges, e.id) FROM ways w JOIN {edges} e ON e.artifact_id = w.artifact_id AND e.source = w.node "
    "WHERE w.node <> '{sink}' AND NOT list_contains(w.nodes, e.target))"
)
ALL_WAYS = WAYS.format(edges="rel", sink="region")
SEQUENCE = (
    "chain AS (SELECT artifact_id, id AS node, [id] AS nodes, outputs FROM ops WHERE id = 'op.1' UNION ALL SELECT c.artifact_id, p.id, list_append(c.nodes, p.id), p.outputs "
    "FROM chain c JOIN ops p ON p.artifact_id = c.artifact_id AND list_has_any(c.outputs, p.inputs) WHERE NOT list_contains(c.nodes, p.id))"
)

# Rules.

SEND_RULE = """
version: "1.0"
id: order-sent-outside
select:
  message: {entity: {type: MESSAGE}}
  place: {entity: {type: NETWORK_DESTINATION, trust: EXTERNAL}}
  send: {operation: {op: SEND}}
where:
  - direct: {from: message, to: place, relation: SENT_TO}
  - uses: {operation: send, entity: place, role: destination}
  - modality: {selector: send, polarity: negative, imperative: true}
"""
ANY_RULE = """
version: "1.0"
id: any-material
select:
  material:
    any:
      - entity: {type: FILE}
      - entity: {type: CODE}
  act: {operation: {imperative: true}}
where:
  - uses: {operation: act, entity: material, role: input}
"""
DECODES_RULE = """
version: "1.0"
id: reads-hidden-setting
select:
  setting: {entity: {type: CONFIGURATION, trust: EXTERNAL}}
  read: {operation: {op: READ}}
where:
  - uses: {operation: read, entity: setting, role: any}
"""
DECODED_RULE = """
version: "1.0"
id: decoded-delete
select:
  remove: {operation: {op: DELETE, polarity: negative}}
where:
  - decoded_from: {codec: base64}
  - modality: {selector: remove, imperative: true}
"""
FLOW_RULE = """
version: "1.0"
id: outside-to-region
select:
  place: {entity: {type: NETWORK_DESTINATION}}
  area: {entity: {value: ASIA}}
  owner: {entity: {type: USER_DATA, trust: UNTRUSTED}}
  home: {entity: {type: SYSTEM_DATA}}
where:
  - path: {from: place, to: area}
  - distance: {from: place, to: owner, max_depth: 3, kind: derivation}
  - trust_boundary: {from: owner, to: home}
"""
SEQUENCE_RULE = """
version: "1.0"
id: read-then-send
select:
  first: {operation: {op: READ, imperative: true}}
  last: {operation: {op: READ, imperative: false}}
where:
  - sequence: {from: first, to: last}
"""


def _result(df: DataFrame) -> DataFrame:
    spans = F.transform("evidence", lambda r: F.concat_ws(":", r["record_type"], r["record_id"], r["spans"][0]["start"].cast("string")))
    return df.select("artifact_id", "status", _joined("matched_entity_ids"), _joined("matched_operation_ids"), _joined("matched_relationship_ids"), F.array_join(spans, ",").alias("evidence"), "explanation")


def _artifacts(spark: SparkSession, sf_dir: str, facts: Facts) -> DataFrame:
    """Each order's text is a decoded child of its customer's text."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sha = lambda *c: F.sha2(F.concat(*c).cast("binary"), 256)
    start = (F.col("o_orderkey") % 50 * 5).cast("int")
    parent = sha(F.lit("customer:"), F.col("o_custkey").cast("string"))
    span = F.struct(parent.alias("artifact_id"), start.alias("start"), (start + 4).alias("end"))
    codec = F.when(F.col("o_orderkey") % 3 == 0, "base64").otherwise("hex")
    made = F.struct(parent.alias("parent_artifact_id"), span.alias("parent_span"), codec.alias("codec"))
    child = orders.select(sha(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("artifact_id"), F.concat(F.lit("virtual://"), "o_orderkey").alias("source_name"), F.repeat(F.lit("text\n"), F.lit(1004)).alias("text"), made.alias("decode_provenance"))
    root = orders.select("o_custkey").distinct().select(sha(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("artifact_id"), F.concat(F.lit("customer-"), "o_custkey").alias("source_name"), F.repeat(F.lit("abcd\n"), F.lit(60)).alias("text"))
    return child.unionByName(root, allowMissingColumns=True)


def rule_first_match(spark, sf_dir):
    return _result(evaluate.evaluate(rules.read_rule_text(SEND_RULE), order_facts(spark, sf_dir)))


def any_selector(spark, sf_dir):
    found = evaluate.evaluate(rules.read_rule_text(ANY_RULE), order_facts(spark, sf_dir))
    return found.select("artifact_id", "status", _joined("matched_entity_ids"), _joined("matched_operation_ids"))


def _with_decodings(facts: Facts) -> Facts:
    def hop(*evidence) -> list:
        return [F.lit("relationship.decodes").alias("id"), F.lit("flow.0").alias("source"), F.lit("DECODES_TO").alias("relation"), F.lit("region").alias("target"), *evidence, F.lit(0.5).alias("confidence"), F.lit(False).alias("underspecified")]

    more = facts.entities.filter("id = 'flow.0'").select(*KEY, *hop("evidence"))
    own = F.transform(F.filter("entities", lambda e: e["id"] == "flow.0"), lambda e: F.struct(*hop(e["evidence"].alias("evidence"))))
    whole = facts.fragments().withColumn("relationships", F.concat("relationships", own))
    return replace(facts, relationships=facts.relationships.unionByName(more)).made_of(whole)


def uses_decodes_to(spark, sf_dir):
    found = evaluate.evaluate(rules.read_rule_text(DECODES_RULE), _with_decodings(order_facts(spark, sf_dir)))
    return found.select("artifact_id", "status", _joined("matched_entity_ids"), _joined("matched_operation_ids"), _joined("matched_relationship_ids"))


def uses_role(spark, sf_dir):
    """The same rule for each role: how many fragments it hits."""
    text = 'version: "1.0"\nid: role-{role}\nselect:\n  e: {{entity: {{value_pattern: "^(customer|flow|s[0-9])"}}}}\n  o: {{operation: {{op: DELETE, imperative: true}}}}\nwhere:\n  - uses: {{operation: o, entity: e, role: {role}}}\n'
    every = [rules.read_rule_text(text.format(role=role)) for role in ("actor", "input", "output", "destination", "any")]
    return evaluate.evaluate_all(every, order_facts(spark, sf_dir)).select("rule_id", "artifact_id", "status", _joined("matched_entity_ids"))


def decoded_from(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    facts = replace(facts, artifacts=_artifacts(spark, sf_dir, facts))
    return evaluate.evaluate(rules.read_rule_text(DECODED_RULE), facts).select("artifact_id", "status", _joined("matched_operation_ids"))


def rule_paths(spark, sf_dir):
    found = evaluate.evaluate(rules.read_rule_text(FLOW_RULE), order_facts(spark, sf_dir))
    return found.select("artifact_id", "status", _joined("matched_entity_ids"), _joined("matched_relationship_ids"))


def rule_sequence(spark, sf_dir):
    found = evaluate.evaluate(rules.read_rule_text(SEQUENCE_RULE), order_facts(spark, sf_dir))
    return found.select("artifact_id", "status", _joined("matched_operation_ids"))


def hunt_status(spark, sf_dir):
    """Texts end at 5020, so no evidence lies beyond them and every hit maps to its customer's text."""
    facts = order_facts(spark, sf_dir)
    facts = replace(facts, artifacts=_artifacts(spark, sf_dir, facts))
    found = hunt.hunt(rules.read_rule_text(SEND_RULE), facts, facts.keys())
    one = F.transform("hints", lambda h: F.concat_ws(":", h["source_name"], h["start"].cast("string"), h["line"].cast("string"), h["column"].cast("string")))
    return found.select("artifact_id", "status", F.array_join(one, ",").alias("hints"))


def hunt_unsupported(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    cut = _artifacts(spark, sf_dir, facts).withColumn("text", F.substring("text", 1, 5003))
    return hunt.diagnostics(replace(facts, artifacts=cut)).select("artifact_id", "code")


def hint_root_map(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    artifacts = _artifacts(spark, sf_dir, facts)
    spans = facts.operations.select(*KEY, F.explode("evidence").alias("span"))
    found = hunt.root_spans(spans, artifacts)
    return found.groupBy(F.col("root.artifact_id").alias("root_id"), F.col("root.start").alias("start")).agg(F.count("*").alias("n"))


def _cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    facts = order_facts(spark, sf_dir)
    results = evaluate.evaluate_all([rules.read_rule_text(SEND_RULE), rules.read_rule_text(SEQUENCE_RULE)], facts)
    cases = facts.entities.filter("id = 'customer'").select("artifact_id", F.col("artifact_id").alias("case_id"), F.col("subtype").alias("family"), F.when(F.col("trust") == "TRUSTED", "risky").otherwise("near_miss").alias("role"))
    return results, cases


def family_regressions(spark, sf_dir):
    results, cases = _cases(spark, sf_dir)
    return reports.family_report(reports.case_hits(results, cases)).select("family", _joined("risky_hits"), "regressions", "regressed_cases")


def rule_status(spark, sf_dir):
    results, _ = _cases(spark, sf_dir)
    return reports.rule_status(results).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


SEND_FIRST = (
    "hits AS (SELECT d.artifact_id, d.id AS place, p.id AS send, d.s AS ds, p.s AS ps, row_number() OVER (PARTITION BY d.artifact_id ORDER BY d.id, p.id) AS k FROM ent d JOIN rel r ON r.artifact_id = d.artifact_id AND r.source = 'order' AND r.target = d.id AND r.relation = 'SENT_TO' "
    "JOIN ops p ON p.artifact_id = d.artifact_id AND p.destination = d.id WHERE d.type = 'NETWORK_DESTINATION' AND p.op = 'SEND' AND p.polarity = 'negative' AND p.imperative)"
)
SEND_SQL = (
    f"{W}, {SEND_FIRST} SELECT o.artifact_id, CASE WHEN h.k = 1 THEN 'HIT' ELSE 'NO_HIT' END AS status, CASE WHEN h.k = 1 THEN 'order,' || place ELSE '' END AS matched_entity_ids, coalesce(send, '') AS matched_operation_ids, "
    "CASE WHEN h.k = 1 THEN 'rel.SENT_TO.order.' || place ELSE '' END AS matched_relationship_ids, "
    "CASE WHEN h.k = 1 THEN 'entity:order:0,relationship:rel.SENT_TO.order.' || place || ':9,entity:' || place || ':' || ds || ',operation:' || send || ':' || ps ELSE '' END AS evidence, "
    "CASE WHEN h.k = 1 THEN 'order-sent-outside: direct, uses, modality' END AS explanation FROM o LEFT JOIN hits h ON h.artifact_id = o.artifact_id AND h.k = 1"
)
ANY_SQL = (
    f"{W}, hits AS (SELECT e.artifact_id, e.id AS material, p.id AS act, row_number() OVER (PARTITION BY e.artifact_id ORDER BY p.id, e.s, e.id) AS k FROM ent e JOIN ops p ON p.artifact_id = e.artifact_id AND list_contains(p.inputs, e.id) WHERE e.type IN ('FILE', 'CODE') AND p.imperative) "
    "SELECT o.artifact_id, CASE WHEN h.k = 1 THEN 'HIT' ELSE 'NO_HIT' END AS status, coalesce(material, '') AS matched_entity_ids, coalesce(act, '') AS matched_operation_ids FROM o LEFT JOIN hits h ON h.artifact_id = o.artifact_id AND h.k = 1"
)
DECODES_SQL = (
    f"{W}, hits AS (SELECT e.artifact_id, min(p.id) AS act FROM ent e JOIN ops p ON p.artifact_id = e.artifact_id AND list_contains(p.inputs, 'flow.0') WHERE e.id = 'region' AND e.trust = 'EXTERNAL' AND p.op = 'READ' GROUP BY e.artifact_id) "
    "SELECT o.artifact_id, CASE WHEN act IS NULL THEN 'NO_HIT' ELSE 'HIT' END AS status, CASE WHEN act IS NULL THEN '' ELSE 'region' END AS matched_entity_ids, coalesce(act, '') AS matched_operation_ids, CASE WHEN act IS NULL THEN '' ELSE 'relationship.decodes' END AS matched_relationship_ids FROM o LEFT JOIN hits USING (artifact_id)"
)
ROLE_SQL = (
    f"{W}, r(role) AS (VALUES ('actor'), ('input'), ('output'), ('destination'), ('any')), "
    "e AS (SELECT * FROM ent WHERE regexp_matches(value, '^(customer|flow|s[0-9])')), p AS (SELECT *, CASE role WHEN 'actor' THEN [actor] WHEN 'input' THEN inputs WHEN 'output' THEN outputs WHEN 'destination' THEN [destination] ELSE list_concat([actor], inputs, outputs, [destination]) END AS refs FROM ops, r WHERE op = 'DELETE' AND imperative), "
    "h AS (SELECT p.role, e.artifact_id, min(e.id) AS e FROM e JOIN p ON p.artifact_id = e.artifact_id AND list_contains(refs, e.id) GROUP BY ALL) "
    "SELECT 'role-' || role AS rule_id, o.artifact_id, CASE WHEN e IS NULL THEN 'NO_HIT' ELSE 'HIT' END AS status, coalesce(e, '') AS matched_entity_ids FROM o CROSS JOIN r LEFT JOIN h USING (artifact_id, role)"
)
DECODED_SQL = (
    f"{W}, h AS (SELECT artifact_id, min(id) AS act FROM ops WHERE op = 'DELETE' AND polarity = 'negative' AND imperative GROUP BY 1) "
    "SELECT o.artifact_id, CASE WHEN o_orderkey % 3 = 0 AND act IS NOT NULL THEN 'HIT' ELSE 'NO_HIT' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(act, '') ELSE '' END AS matched_operation_ids FROM o LEFT JOIN h USING (artifact_id)"
)
PATHS_SQL = (
    f"{W}, {ALL_WAYS}, way AS (SELECT artifact_id, source, min((nodes, edges)) AS w FROM ways WHERE node = 'region' GROUP BY ALL), "
    f"der AS (SELECT * FROM rel WHERE relation = 'DERIVED_FROM'), {WAYS.format(edges='der', sink='customer').replace('ways AS', 'down AS').replace('FROM ways w', 'FROM down w')}, "
    "near AS (SELECT artifact_id, source, min((nodes, edges)) AS w FROM down WHERE node = 'customer' AND len(edges) <= 3 GROUP BY ALL), "
    "hit AS (SELECT a.artifact_id, min(a.source) AS place FROM way a JOIN near USING (artifact_id, source) JOIN o USING (artifact_id) WHERE r_name = 'ASIA' AND c_acctbal < 0 GROUP BY ALL), "
    "full_ AS (SELECT h.artifact_id, place, list_sort(list_distinct(list_concat(way.w[2], near.w[2], ['rel.CONTAINED_BY.customer.nation']))) AS edges FROM hit h JOIN way ON way.artifact_id = h.artifact_id AND way.source = place JOIN near ON near.artifact_id = h.artifact_id AND near.source = place) "
    "SELECT o.artifact_id, CASE WHEN place IS NULL THEN 'NO_HIT' ELSE 'HIT' END AS status, CASE WHEN place IS NULL THEN '' ELSE 'customer,nation,region,' || place END AS matched_entity_ids, coalesce(array_to_string(edges, ','), '') AS matched_relationship_ids FROM o LEFT JOIN full_ USING (artifact_id)"
)
SEQUENCE_HITS = (
    "seq AS (SELECT artifact_id, id AS a, id AS node, [id] AS nodes, outputs FROM ops WHERE op = 'READ' AND imperative UNION ALL SELECT c.artifact_id, c.a, p.id, list_append(c.nodes, p.id), p.outputs "
    "FROM seq c JOIN ops p ON p.artifact_id = c.artifact_id AND list_has_any(c.outputs, p.inputs) WHERE NOT list_contains(c.nodes, p.id)), "
    "sh AS (SELECT s.artifact_id, s.nodes, row_number() OVER (PARTITION BY s.artifact_id ORDER BY s.a, s.node, s.nodes) AS k FROM seq s JOIN ops p ON p.artifact_id = s.artifact_id AND p.id = s.node WHERE p.op = 'READ' AND NOT p.imperative)"
)
FAMILY = (
    f"{W}, {SEND_FIRST}, {SEQUENCE_HITS}, hit AS (SELECT DISTINCT artifact_id, 'order-sent-outside' AS rule FROM hits UNION SELECT DISTINCT artifact_id, 'read-then-send' FROM sh), "
    "c AS (SELECT o.artifact_id, c_mktsegment AS family, CASE WHEN c_acctbal >= 0 THEN 'risky' ELSE 'near_miss' END AS role, rule FROM o LEFT JOIN hit USING (artifact_id)), "
    "risky AS (SELECT DISTINCT family, rule FROM c WHERE role = 'risky' AND rule IS NOT NULL), near AS (SELECT c.family, c.artifact_id FROM c JOIN risky USING (family, rule) WHERE role = 'near_miss') "
    "SELECT f.family, coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM risky r WHERE r.family = f.family), '') AS risky_hits, (SELECT count(*) FROM near n WHERE n.family = f.family) AS regressions, (SELECT count(DISTINCT artifact_id) FROM near n WHERE n.family = f.family) AS regressed_cases FROM (SELECT DISTINCT family FROM c) f"
)

# Validation and canonicalization.


def _faulty(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The order facts with repeated ids, undeclared references and evidence beyond the text."""
    facts = order_facts(spark, sf_dir)
    ops = facts.operations.withColumn("id", F.when(F.col("id") == "op.4", "order").otherwise(F.col("id")))
    ops = ops.withColumn("destination", F.when(F.col("modality.conditional"), "ghost").otherwise(F.col("destination")))
    return facts.entities, ops, facts.relationships


def dup_ids(spark, sf_dir):
    entities, ops, _ = _faulty(spark, sf_dir)
    return validate.duplicate_ids(entities, ops).select("artifact_id", "id", "code")


def dangling_refs(spark, sf_dir):
    entities, ops, rel = _faulty(spark, sf_dir)
    return validate.dangling(entities, ops, rel).select("artifact_id", "owner", "reference", "message")


def evidence_bounds(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    cut = _artifacts(spark, sf_dir, facts).withColumn("text", F.substring("text", 1, 5002))
    return validate.evidence_errors(facts.entities, facts.operations, facts.relationships, cut).groupBy("artifact_id", "message").agg(F.count("*").alias("n"))


def _nations(spark, sf_dir) -> DataFrame:
    """One reading a nation: each customer is an entity named by its segment, or unnamed where the key ends in 3."""
    c = table(spark, sf_dir, "customer").withColumn("artifact_id", F.sha2(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).cast("binary"), 256))
    at = (F.col("c_custkey") % 100).cast("int")
    value = F.when(F.col("c_custkey") % 10 != 3, F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 7).cast("string")))
    trust = F.when(F.col("c_acctbal") >= -500, "TRUSTED").otherwise("UNTRUSTED")
    return c.select(
        "artifact_id", F.lit(0).alias("ordinal"), F.concat(F.lit("c."), "c_custkey").alias("id"), F.lit("USER_DATA").alias("type"), F.lit(None).cast("string").alias("subtype"), value.alias("value"),
        F.lit("INTERNAL").alias("sensitivity"), trust.alias("trust"), F.array(F.struct("artifact_id", at.alias("start"), (at + 1).alias("end"))).alias("evidence"), F.lit(0.5).alias("confidence"), F.lit(False).alias("underspecified"),
    )


NATIONS = (
    "n AS (SELECT sha256('nation:' || c_nationkey) AS artifact_id, 'c.' || c_custkey AS id, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment || '-' || (c_custkey % 7) END AS value, "
    "CASE WHEN c_acctbal >= -500 THEN 'TRUSTED' ELSE 'UNTRUSTED' END AS trust, (c_custkey % 100)::INT AS s FROM customer), "
    "m AS (SELECT *, 'entity.user_data.' || CASE WHEN value IS NULL THEN '' ELSE trim(regexp_replace(lower(value), '[^a-z0-9]+', '_', 'g'), '_') || '.' END || substr(sha256("
    "'{\"artifact_id\":\"' || artifact_id || CASE WHEN value IS NULL THEN '\",\"source_instance\":\"' || id || '\",\"type\":\"USER_DATA\",\"value\":null}' ELSE '\",\"type\":\"USER_DATA\",\"value\":\"' || value || '\"}' END), 1, 12) AS cid FROM n)"
)


def entity_conflicts(spark, sf_dir):
    found = canonical.entity_conflicts(_nations(spark, sf_dir))
    return found.select("artifact_id", "type", "value", F.col("span.start").alias("start"))


def canon_entities(spark, sf_dir):
    entities, _ = canonical.canonical_entities(_nations(spark, sf_dir))
    return entities.select("artifact_id", "id", "value", F.array_join(F.transform("evidence", lambda s: s["start"].cast("string")), ",").alias("evidence"))


def canon_ids(spark, sf_dir):
    _, mapping = canonical.canonical_entities(_nations(spark, sf_dir))
    return mapping.select("artifact_id", "source_id", "canonical_id")


def id_remap(spark, sf_dir):
    """Every customer refers to itself and to the next key; references keep their order."""
    raw = _nations(spark, sf_dir)
    _, mapping = canonical.canonical_entities(raw)
    rows = raw.select(*KEY, "id", F.array("id", "id").alias("refs"), F.col("id").alias("actor"))
    out = canonical.remap(canonical.remap_array(rows, mapping, ["refs"]), mapping, "actor")
    return out.select("artifact_id", "id", _joined("refs"), "actor")


def evidence_union(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    every = facts.entities.select(*KEY, "evidence").union(facts.operations.select(*KEY, "evidence")).union(facts.relationships.select(*KEY, "evidence"))
    out = every.groupBy(*KEY).agg(canonical.union_of(F.collect_list("evidence")).alias("evidence"))
    return out.select("artifact_id", F.array_join(F.transform("evidence", lambda s: s["start"].cast("string")), ",").alias("starts"))


def canon_relationships(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    _, mapping = canonical.canonical_entities(facts.entities)
    out, conflicts = canonical.canonical_relationships(facts.relationships, mapping)
    return out.join(conflicts, KEY, "left_anti").select("artifact_id", "id", "source", "relation", "target")


def canon_operations(spark, sf_dir):
    facts = order_facts(spark, sf_dir)
    _, mapping = canonical.canonical_entities(facts.entities)
    out, _, conflicts = canonical.canonical_operations(facts.operations, mapping)
    return out.join(conflicts, KEY, "left_anti").groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("fragments"))


def merge_static(spark, sf_dir):
    """The static entities of documents merged into readings that know every second one of them already."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(ids.content_id(F.col("text")).alias("artifact_id"), "text").dropDuplicates(["artifact_id"])
    found = static_entities(docs).withColumn("ordinal", F.lit(0))
    named, _ = canonical.canonical_entities(found)
    known = named.filter("substring(id, -1) < '8'").withColumns({"trust": F.lit("UNKNOWN"), "confidence": F.lit(0.5)})
    keys = docs.select("artifact_id", F.lit(0).alias("ordinal"))
    return compose.merge_static(known, named.drop("ordinal"), keys).select("artifact_id", "id", "trust", "confidence", F.size("evidence").alias("n_evidence"))


CANON = (
    "slugged AS (SELECT *, substr(trim(regexp_replace(lower(value), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) AS slug FROM ent), "
    "cent AS (SELECT artifact_id, id, 'entity.' || lower(type) || '.' || slug || '.' || substr(sha256('{\"artifact_id\":\"' || artifact_id || '\",\"type\":\"' || type || '\",\"value\":\"' || value || '\"}'), 1, 12) AS cid FROM slugged)"
)
CANON_RELATIONSHIPS_SQL = (
    f"{W}, {CANON}, m AS (SELECT r.artifact_id, a.cid AS source, r.relation, b.cid AS target FROM rel r JOIN cent a ON a.artifact_id = r.artifact_id AND a.id = r.source JOIN cent b ON b.artifact_id = r.artifact_id AND b.id = r.target) "
    "SELECT artifact_id, 'relationship.' || lower(relation) || '.' || substr(sha256('{\"artifact_id\":\"' || artifact_id || '\",\"confidence\":0.8,\"relation\":\"' || relation || '\",\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"underspecified\":false}'), 1, 12) AS id, source, relation, target FROM m"
)


STATIC_CANON = (
    f"x AS (SELECT * FROM ({STATIC_SQL})), d AS (SELECT sha256(text) AS artifact_id, min(doc_id) AS doc_id FROM documents GROUP BY 1), "
    "v AS (SELECT artifact_id, value, min(trust) AS seen, count(DISTINCT (start, \"end\")) AS n_evidence FROM x JOIN d USING (doc_id) GROUP BY ALL), "
    "m AS (SELECT *, 'entity.network_destination.' || substr(trim(regexp_replace(lower(value), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) || '.' || substr(sha256('{\"artifact_id\":\"' || artifact_id || '\",\"type\":\"NETWORK_DESTINATION\",\"value\":\"' || value || '\"}'), 1, 12) AS id FROM v)"
)


def enrich_static(spark, sf_dir):
    """Documents read as holding nothing: what static enrichment adds to each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(ids.content_id(F.col("text")).alias("artifact_id"), "text").dropDuplicates(["artifact_id"])
    none = order_facts(spark, sf_dir)
    facts = Facts(none.entities.limit(0), none.operations.limit(0), none.relationships.limit(0), docs)
    found = compose.enriched(facts, docs.select("artifact_id", F.lit(0).alias("ordinal"))).entities
    return found.select("artifact_id", "id", "value", F.size("evidence").alias("n_evidence"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts of their customer's source, each with the largest order of that customer beside it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sha = lambda *c: F.sha2(F.concat(*c).cast("binary"), 256)
    top = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    rows = orders.join(top, "o_custkey")
    return rows.select(
        "o_orderkey", sha(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("artifact_id"), sha(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("root_id"),
        sha(F.lit("order:"), F.col("top").cast("string")).alias("beside"), F.lit("ten chars.").alias("text"),
    )


def attempt_states(spark, sf_dir):
    """Readings that end in every way: the state of each, its codes, and where the first is shown."""
    rows = _letters(spark, sf_dir)
    kind = F.col("o_orderkey") % 8

    def entity(name: str, artifact, start: str, end: str, trust: str = "TRUSTED"):
        return F.concat(F.lit(f'{{"id":"{name}","type":"TOOL","value":"v","sensitivity":"NONE","trust":"{trust}","evidence":[{{"artifact_id":"'), artifact, F.lit(f'","start":{start},"end":{end}}}],"confidence":1,"underspecified":false}}'))

    own, beside = F.col("artifact_id"), F.col("beside")
    wrap = lambda e, more="": F.concat(F.lit('{"schema_version":"1.0","entities":['), e, F.lit("]" + more + "}"))
    ghost = F.concat(F.lit(',"relationships":[{"source":"e","relation":"TARGETS","target":"ghost","evidence":[{"artifact_id":"'), own, F.lit('","start":3,"end":4}],"confidence":1,"underspecified":false}]'))
    good = entity("e", own, "0", "2")
    payload = (
        F.when(kind == 1, wrap(entity("e", own, "0", "99")))
        .when(kind == 2, wrap(F.concat(good, F.lit(","), entity("e", own, "5", "6"))))
        .when(kind == 3, F.concat(F.lit('{"schema_version":"1.0","entities":['), good, F.lit("]"), ghost, F.lit("}")))
        .when(kind == 4, wrap(entity("e", beside, "1", "2")))
        .when(kind == 5, wrap(F.concat(good, F.lit(","), entity("f", own, "7", "8", "UNTRUSTED"))))
        .when(kind == 6, F.lit("not json"))
        .when(kind == 7, F.lit(None).cast("string"))
        .otherwise(wrap(good))
    )
    attempts = rows.select("artifact_id", F.lit(0).alias("ordinal"), F.when(kind == 7, "refused").otherwise("fragment").alias("outcome"), payload.alias("payload"))
    states, _, _ = lift.facts_of(rows.select("root_id", "artifact_id", "text"), attempts)
    first = F.get("diagnostics", F.lit(0))
    return states.select("artifact_id", "stage", F.array_join(F.transform("diagnostics", lambda d: d["code"]), ",").alias("codes"), F.coalesce(first["span"]["start"], F.lit(-1)).alias("start"))


STATES_SQL = (
    "WITH l AS (SELECT o_orderkey % 8 AS k, sha256('order:' || o_orderkey) AS artifact_id, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS top FROM orders) "
    "SELECT artifact_id, CASE WHEN k IN (1, 2, 3, 6) THEN 'validation_rejected' WHEN k = 7 THEN 'lifecycle_rejected' WHEN k = 5 OR k = 4 AND NOT top THEN 'canonicalization_rejected' ELSE 'accepted' END AS stage, "
    "CASE k WHEN 1 THEN 'invalid_evidence_span' WHEN 2 THEN 'duplicate_semantic_id' WHEN 3 THEN 'dangling_semantic_reference' WHEN 4 THEN CASE WHEN top THEN '' ELSE 'cross_artifact_evidence' END WHEN 5 THEN 'entity_reconciliation_conflict' WHEN 6 THEN 'invalid_ir_shape' WHEN 7 THEN 'refused' ELSE '' END AS codes, "
    "(CASE k WHEN 1 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN 3 WHEN 4 THEN CASE WHEN top THEN -1 ELSE 1 END WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE -1 END)::INT AS start FROM l"
)


def resolved_links(spark, sf_dir):
    """Customers whose text holds a token that was decoded to a host: which tokens are linked to what their child says."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    sha = lambda word: F.sha2(F.concat(F.lit(word), F.col("k").cast("string")).cast("binary"), 256)
    token, host = F.concat(F.lit("token-"), "k"), F.concat(F.lit("host"), "k", F.lit(".example.com"))
    span = lambda artifact, start, end: F.struct(artifact.alias("artifact_id"), F.lit(start).cast("int").alias("start"), end.cast("int").alias("end"))
    at = span(sha("up:"), 4, F.length(token) + 4)
    made = F.struct(sha("up:").alias("parent_artifact_id"), at.alias("parent_span"), F.lit("hex").alias("codec"))
    up = c.select(sha("up:").alias("artifact_id"), F.concat(F.lit("see "), token, F.lit(" here")).alias("text"))
    down = c.select(sha("down:").alias("artifact_id"), host.alias("text"), made.alias("decode_provenance"))
    artifacts = up.unionByName(down, allowMissingColumns=True)

    def entity(df, artifact, name, kind, value, evidence, confidence):
        return df.select(artifact.alias("artifact_id"), F.lit(0).alias("ordinal"), F.lit(name).alias("id"), kind.alias("type"), F.lit(None).cast("string").alias("subtype"), value.alias("value"), F.lit("UNKNOWN").alias("sensitivity"), F.lit("UNKNOWN").alias("trust"), F.array(evidence).alias("evidence"), F.lit(confidence).alias("confidence"), F.lit(False).alias("underspecified"))

    net = F.lit("NETWORK_DESTINATION")
    raw = entity(c, sha("up:"), "raw", F.when(F.col("k") % 2 == 0, "ENCODED_DATA").otherwise(net), token, at, 0.9)
    whole = entity(c, sha("down:"), "host", net, host, span(sha("down:"), 0, F.when(F.col("k") % 3 == 0, 4).otherwise(F.length(host))), 0.4)
    second = entity(c.filter("k % 5 = 0"), sha("down:"), "second", net, F.lit("second"), span(sha("down:"), 1, F.lit(3)), 0.4)
    none = order_facts(spark, sf_dir)
    facts = Facts(raw.union(whole).union(second), none.operations.limit(0), none.relationships.limit(0), artifacts)
    found = compose.resolved(facts, facts.keys())
    return found.relationships.select("artifact_id", "id", "source", "target", "confidence")


LINKS_SQL = (
    "SELECT sha256('up:' || c_custkey) AS artifact_id, 'relationship.decodes_to.' || substr(sha256('raw' || chr(0) || 'host'), 1, 16) AS id, 'raw' AS source, 'host' AS target, 0.4::DOUBLE AS confidence "
    "FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 <> 0 ELSE c_custkey % 5 <> 0 END"
)


def parse_readings(spark, sf_dir):
    """Readings as JSON, some of them broken: how many are rejected, and why."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.sha2(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).cast("binary"), 256)
    span = F.concat(F.lit('{"artifact_id":"'), key, F.lit('","start":0,"end":'), F.when(F.col("o_orderkey") % 5 == 1, "0").otherwise("3"), F.lit("}"))
    extra = F.when(F.col("o_orderkey") % 5 == 0, ',"note":1').otherwise("")
    kind = F.when(F.col("o_orderkey") % 5 == 2, "THING").otherwise("MESSAGE")
    payload = F.concat(F.lit('{"schema_version":"1.0","entities":[{"id":"e","type":"'), kind, F.lit('","sensitivity":"NONE","trust":"TRUSTED","evidence":['), span, F.lit('],"confidence":1,"underspecified":false'), extra, F.lit("}]}"))
    parsed = validate.parse(orders.select(key.alias("artifact_id"), F.lit(0).alias("ordinal"), payload.alias("payload")))
    return parsed.groupBy(F.coalesce("code", F.lit("accepted")).alias("code")).agg(F.count("*").alias("n"), F.count("fragment").alias("fragments"))


QUERIES = {
    f.__name__: f
    for f in (
        direct_rel, entity_filter, value_pattern, modality_filter, trust_boundary, path_exists, first_path, all_paths, derivation_path, distance_k, op_sequence, graph_elements,
        rule_first_match, any_selector, uses_decodes_to, uses_role, decoded_from, rule_paths, rule_sequence, hunt_status, hunt_unsupported, hint_root_map, family_regressions, rule_status,
        dup_ids, dangling_refs, evidence_bounds, entity_conflicts, canon_entities, canon_ids, id_remap, evidence_union, canon_relationships, canon_operations, merge_static, enrich_static, attempt_states, resolved_links, parse_readings,
    )
}

ORACLES = {
    "direct_rel": f"{W} SELECT artifact_id, source, target FROM rel WHERE relation = 'SENT_TO' AND source = 'order'",
    "entity_filter": f"{W} SELECT artifact_id, id, value FROM ent WHERE type = 'USER_DATA' AND trust = 'UNTRUSTED' AND subtype = 'BUILDING'",
    "value_pattern": f"{W} SELECT artifact_id, id, value FROM ent WHERE regexp_matches(value, '^part-[0-9]*7$')",
    "modality_filter": f"{W} SELECT artifact_id, id, op FROM ops WHERE polarity = 'positive' AND imperative AND NOT conditional",
    "trust_boundary": f"{W} SELECT r.artifact_id, r.id FROM rel r JOIN ent a ON a.artifact_id = r.artifact_id AND a.id = r.source JOIN ent b ON b.artifact_id = r.artifact_id AND b.id = r.target WHERE a.trust <> b.trust",
    "path_exists": f"{W}, {REACH} SELECT artifact_id, source, count(*) AS within_reach FROM reach GROUP BY ALL",
    "first_path": f"{W}, {ALL_WAYS}, best AS (SELECT artifact_id, source, min((nodes, edges)) AS w FROM ways WHERE node = 'region' GROUP BY ALL) SELECT artifact_id, source, array_to_string(w[1], ',') AS nodes, array_to_string(w[2], ',') AS edges FROM best",
    "all_paths": f"{W}, {ALL_WAYS} SELECT artifact_id, source, count(*) AS n, max(len(edges)) AS longest FROM ways WHERE node = 'region' GROUP BY ALL",
    "derivation_path": f"{W}, der AS (SELECT * FROM rel WHERE relation = 'DERIVED_FROM'), {WAYS.format(edges='der', sink='customer')}, best AS (SELECT artifact_id, source, min(nodes) AS nodes FROM ways WHERE node = 'customer' GROUP BY ALL) SELECT artifact_id, source, array_to_string(nodes, ',') AS nodes FROM best",
    "distance_k": f"{W}, b AS (SELECT artifact_id, id AS source FROM ent WHERE id IN ('region', 'order')), h1 AS (SELECT b.artifact_id, b.source, r.target FROM b JOIN rel r USING (artifact_id, source)), h2 AS (SELECT h.artifact_id, h.source, r.target FROM h1 h JOIN rel r ON r.artifact_id = h.artifact_id AND r.source = h.target) SELECT artifact_id, source, source AS target FROM b UNION SELECT * FROM h1 UNION SELECT * FROM h2",
    "op_sequence": f"{W}, {SEQUENCE}, best AS (SELECT artifact_id, node AS sink, min(nodes) AS nodes FROM chain GROUP BY ALL) SELECT artifact_id, sink, array_to_string(nodes, ',') AS nodes FROM best",
    "graph_elements": f"{W} SELECT 'input' AS label, sum(len(inputs))::BIGINT AS n FROM ops UNION ALL SELECT 'output', sum(len(outputs))::BIGINT FROM ops UNION ALL SELECT 'actor', count(*) FROM ops UNION ALL SELECT 'destination', count(*) FROM ops UNION ALL SELECT relation, count(*) FROM rel GROUP BY relation",
    "rule_first_match": SEND_SQL,
    "any_selector": ANY_SQL,
    "uses_decodes_to": DECODES_SQL,
    "uses_role": ROLE_SQL,
    "decoded_from": DECODED_SQL,
    "rule_paths": PATHS_SQL,
    "rule_sequence": f"{W}, {SEQUENCE_HITS} SELECT o.artifact_id, CASE WHEN sh.k = 1 THEN 'HIT' ELSE 'NO_HIT' END AS status, coalesce(array_to_string(list_sort(nodes), ','), '') AS matched_operation_ids FROM o LEFT JOIN sh ON sh.artifact_id = o.artifact_id AND sh.k = 1",
    "hunt_status": f"{W}, {SEND_FIRST} SELECT o.artifact_id, CASE WHEN h.k = 1 THEN 'HIT' ELSE 'NO_HIT' END AS status, CASE WHEN h.k = 1 THEN 'customer-' || o_custkey || ':' || (o_orderkey % 50 * 5) || ':' || (o_orderkey % 50 + 1) || ':1' ELSE '' END AS hints FROM o LEFT JOIN hits h ON h.artifact_id = o.artifact_id AND h.k = 1",
    "hunt_unsupported": f"{W} SELECT DISTINCT artifact_id, 'invalid_canonical_evidence' AS code FROM ops WHERE s + 1 > 5003",
    "hint_root_map": f"{W} SELECT sha256('customer:' || o_custkey) AS root_id, (o_orderkey % 50 * 5)::INT AS start, count(*) AS n FROM ops JOIN o USING (artifact_id) GROUP BY ALL",
    "family_regressions": FAMILY,
    "rule_status": f"{W}, {SEND_FIRST}, {SEQUENCE_HITS}, x AS (SELECT 'order-sent-outside' AS rule_id, artifact_id IN (SELECT artifact_id FROM hits) AS hit FROM o UNION ALL SELECT 'read-then-send', artifact_id IN (SELECT artifact_id FROM sh) FROM o) SELECT rule_id, CASE WHEN hit THEN 'HIT' ELSE 'NO_HIT' END AS status, count(*) AS n FROM x GROUP BY ALL",
    "dup_ids": f"{W} SELECT artifact_id, 'order' AS id, 'duplicate_semantic_id' AS code FROM ops WHERE id = 'op.4'",
    "dangling_refs": f"{W} SELECT artifact_id, CASE WHEN id = 'op.4' THEN 'order' ELSE id END AS owner, 'ghost' AS reference, 'operation ''' || CASE WHEN id = 'op.4' THEN 'order' ELSE id END || ''' mentions ''ghost'', which is no declared entity' AS message FROM ops WHERE conditional",
    "evidence_bounds": f"{W} SELECT artifact_id, 'evidence ends beyond the text that it names' AS message, count(*) AS n FROM ops WHERE s + 1 > 5002 GROUP BY ALL",
    "entity_conflicts": f"WITH {NATIONS} SELECT artifact_id, 'USER_DATA' AS type, value, min(s) AS start FROM n WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT trust) > 1",
    "canon_entities": f"WITH {NATIONS} SELECT artifact_id, cid AS id, value, array_to_string(list_sort(list(DISTINCT s)), ',') AS evidence FROM m GROUP BY ALL",
    "canon_ids": f"WITH {NATIONS} SELECT artifact_id, id AS source_id, cid AS canonical_id FROM m",
    "id_remap": f"WITH {NATIONS} SELECT artifact_id, id, cid || ',' || cid AS refs, cid AS actor FROM m",
    "evidence_union": f"{W}, x AS (SELECT artifact_id, s::INT AS s FROM ent UNION SELECT artifact_id, s::INT FROM ops UNION SELECT artifact_id, 9 FROM rel) SELECT artifact_id, array_to_string(list_sort(list(s)), ',') AS starts FROM x GROUP BY ALL",
    "canon_relationships": CANON_RELATIONSHIPS_SQL,
    "canon_operations": f"{W} SELECT op, count(*) AS n, count(DISTINCT artifact_id) AS fragments FROM ops GROUP BY op",
    "merge_static": f"WITH {STATIC_CANON} SELECT artifact_id, id, seen AS trust, CASE WHEN right(id, 1) < '8' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, n_evidence::INT AS n_evidence FROM m",
    "enrich_static": f"WITH {STATIC_CANON} SELECT artifact_id, id, value, n_evidence::INT AS n_evidence FROM m",
    "attempt_states": STATES_SQL,
    "resolved_links": LINKS_SQL,
    "parse_readings": "SELECT CASE o_orderkey % 5 WHEN 1 THEN 'invalid_evidence_span' WHEN 0 THEN 'invalid_ir_shape' WHEN 2 THEN 'invalid_ir_shape' ELSE 'accepted' END AS code, count(*) AS n, count(CASE WHEN o_orderkey % 5 > 2 THEN 1 END) AS fragments FROM orders GROUP BY 1",
}
