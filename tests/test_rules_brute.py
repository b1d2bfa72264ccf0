"""Rules of every construct on random graphs, against a plain product of candidates."""

import itertools
import random
import re

import pytest

from textloom import schemas
from textloom.operators.graph import Facts
from textloom.plans import evaluate
from textloom.plans.rules import read_rule_text

FRAGMENTS = 80
TYPES, TRUST, OPS, RELATIONS = ("FILE", "SECRET", "NETWORK_DESTINATION"), ("TRUSTED", "EXTERNAL"), ("READ", "SEND", "ENCODE"), ("DERIVED_FROM", "SENT_TO", "DECODES_TO")

RULES = {
    "direct": ("a: {entity: {type: FILE}}\n  b: {entity: {trust: EXTERNAL}}", ["direct: {from: a, to: b, relation: SENT_TO}"]),
    "boundary-and-uses": ("a: {entity: {type: SECRET}}\n  b: {entity: {trust: TRUSTED}}\n  s: {operation: {op: SEND}}", ["trust_boundary: {from: a, to: b}", "uses: {operation: s, entity: b}"]),
    "path": ("z: {entity: {type: SECRET}}\n  a: {entity: {trust: EXTERNAL}}", ["path: {from: z, to: a}"]),
    "derivation": ("a: {entity: {type: FILE}}\n  b: {entity: {type: SECRET}}", ["path: {from: a, to: b, kind: derivation}"]),
    "distance": ("a: {entity: {type: FILE}}\n  b: {entity: {type: NETWORK_DESTINATION}}", ["distance: {from: a, to: b, max_depth: 2}"]),
    "sequence": ("a: {operation: {op: READ}}\n  b: {operation: {op: SEND}}", ["sequence: {from: a, to: b}", "modality: {selector: b, imperative: true}"]),
    "any-order": ("b: {any: [{entity: {type: FILE}}, {entity: {type: SECRET}}]}\n  a: {any: [{operation: {op: SEND}}, {operation: {imperative: false}}]}", ["uses: {operation: a, entity: b, role: input}"]),
    "independent": ("a: {entity: {value_pattern: \"^v[0-3]$\"}}\n  b: {entity: {trust: EXTERNAL}}\n  c: {operation: {op: ENCODE}}\n  d: {operation: {polarity: negative}}", ["modality: {selector: d, imperative: false}", "uses: {operation: c, entity: b, role: output}"]),
    "same-record": ("a: {entity: {type: FILE}}\n  b: {entity: {type: FILE}}", ["path: {from: a, to: b}"]),
    "to-itself": ("a: {entity: {type: SECRET}}", ["distance: {from: a, to: a, max_depth: 1}"]),
    "triangle": ("a: {entity: {type: FILE}}\n  b: {entity: {type: SECRET}}\n  c: {entity: {type: NETWORK_DESTINATION}}", ["path: {from: a, to: b}", "path: {from: b, to: c}", "distance: {from: a, to: c, max_depth: 3}"]),
    "decoded": ("a: {operation: {op: READ}}", ["decoded_from: {codec: hex}", "modality: {selector: a, polarity: positive}"]),
}


def graphs():
    rng = random.Random(12)
    for k in range(FRAGMENTS):
        key = f"{k:064x}"
        span = lambda: [(key, s, s + 1) for s in rng.sample(range(50), rng.choice([1, 1, 2]))]
        ents = [dict(id=f"e{i}", type=rng.choice(TYPES), value=rng.choice([None, f"v{i}"]), trust=rng.choice(TRUST), evidence=span()) for i in rng.sample(range(9), rng.randrange(2, 7))]
        ids = [e["id"] for e in ents]
        some = lambda n: [rng.choice(ids) for _ in range(rng.randrange(n))]
        ops = [dict(id=f"o{i}", op=rng.choice(OPS), actor=rng.choice([None, *ids]), inputs=some(3), outputs=some(3), destination=rng.choice([None, *ids]), polarity=rng.choice(["positive", "negative"]), imperative=rng.random() < 0.5, evidence=span()) for i in rng.sample(range(9), rng.randrange(1, 6))]
        rels = [dict(id=f"r{i}", source=rng.choice(ids), relation=rng.choice(RELATIONS), target=rng.choice(ids), evidence=span()) for i in rng.sample(range(20), rng.randrange(1, 9))]
        yield key, ents, ops, rels, rng.choice([None, "hex", "base64"])


@pytest.fixture(scope="module")
def facts(spark):
    every = list(graphs())
    flags = lambda o: (o["polarity"], o["imperative"], False, False, False, False, False)
    ents = [(k, 0, e["id"], e["type"], None, e["value"], "NONE", e["trust"], e["evidence"], 0.5, False) for k, es, *_ in every for e in es]
    ops = [(k, 0, o["id"], o["op"], o["actor"], o["inputs"], o["outputs"], o["destination"], flags(o), o["evidence"], 0.5, False) for k, _, os, *_ in every for o in os]
    rels = [(k, 0, r["id"], r["source"], r["relation"], r["target"], r["evidence"], 0.5, False) for k, _, _, rs, _ in every for r in rs]
    made = [(k, "n", "x" * 60, codec and ("p" * 64, ("p" * 64, 0, 1), codec, 1, [], None, None, None, None)) for k, *_, codec in every]
    tables = [spark.createDataFrame(rows, kind) for rows, kind in ((ents, schemas.ENTITIES), (ops, schemas.OPERATIONS), (rels, schemas.RELATIONSHIPS), (made, f"artifact_id string, source_name string, text string, decode_provenance {schemas.PROVENANCE}"))]
    return Facts(*tables).settled()


def walks(edges, source, sink, most):
    """All simple paths as (nodes, edges)."""
    stack = [([source], [])]
    while stack:
        nodes, names = stack.pop()
        if nodes[-1] == sink:
            yield nodes, names
        elif most is None or len(names) < most:
            stack += [([*nodes, t], [*names, n]) for s, t, n in edges if s == nodes[-1] and t not in nodes]


def met(c, bound, ents, ops, rels, codec):
    """The records that a condition rests on, or None."""
    s = c.spec
    if c.name == "decoded_from":
        return [] if codec and s.get("codec") in (None, codec) else None
    if c.name == "modality":
        o = bound[s["selector"]]
        return [] if all(o[k] == v for k, v in s.items() if k != "selector" and v is not None) else None
    if c.name == "uses":
        o, e = bound[s["operation"]], bound[s["entity"]]
        roles = {"actor": [o["actor"]], "input": o["inputs"], "output": o["outputs"], "destination": [o["destination"]]}
        refs = sum(roles.values(), []) if s["role"] == "any" else roles[s["role"]]
        hops = [r["id"] for r in rels if r["relation"] == "DECODES_TO" and r["source"] in refs and r["target"] == e["id"]]
        return [] if e["id"] in refs else hops or None
    a, b = bound[s["from"]], bound[s["to"]]
    if c.name in ("direct", "trust_boundary"):
        trust = {e["id"]: e["trust"] for e in ents}
        good = lambda r: r["relation"] == s["relation"] if c.name == "direct" else trust[r["source"]] != trust[r["target"]]
        return [r["id"] for r in rels if (r["source"], r["target"]) == (a["id"], b["id"]) and good(r)] or None
    if c.name == "sequence":
        edges = [(x["id"], y["id"], y["id"]) for x in ops for y in ops if set(x["outputs"]) & set(y["inputs"])]
    else:
        edges = [(r["source"], r["target"], r["id"]) for r in rels if s["kind"] == "relationship" or r["relation"] == "DERIVED_FROM"]
    ways = sorted(walks(edges, a["id"], b["id"], s.get("max_depth")))
    return None if not ways else ways[0][0] if c.name == "sequence" else ways[0][1]


def fits(record, filters):
    return all(bool(record["value"] and re.search(want, record["value"])) if k == "value_pattern" else record.get(k) == want for k, want in filters.items())


def plain(rule, ents, ops, rels, codec):
    """(ids of entities, operations and relationships) of the first match, or None."""
    kinds = {"entity": ents, "operation": ops}
    names = sorted(rule.select)
    candidates = []
    for n in names:
        sel = rule.select[n]
        found = [r for r in kinds[sel.kind] if any(fits(r, v) for v in sel.variants)]
        candidates.append(sorted(found, key=lambda r: (min(r["evidence"]), r["id"]) if sel.by_evidence else r["id"]))
    for combination in itertools.product(*candidates):
        bound = dict(zip(names, combination))
        parts = [met(c, bound, ents, ops, rels, codec) for c in rule.where]
        if all(p is not None for p in parts):
            every = {r["id"] for r in combination} | {x for p in parts for x in p}
            return tuple(sorted(x for x in every if x[0] == letter) for letter in "eor")


@pytest.mark.parametrize("name", RULES)
def test_rules_equal_the_product(facts, name):
    select, where = RULES[name]
    rule = read_rule_text(f'version: "1.0"\nid: {name}\nselect:\n  {select}\nwhere:\n' + "".join(f"  - {w}\n" for w in where))
    got = {r.artifact_id: (r.status, r.matched_entity_ids, r.matched_operation_ids, r.matched_relationship_ids) for r in evaluate.evaluate(rule, facts).collect()}
    hits = 0
    for key, ents, ops, rels, codec in graphs():
        want = plain(rule, ents, ops, rels, codec)
        hits += want is not None
        assert got[key] == (("HIT", *want) if want else ("NO_HIT", [], [], [])), key
    assert 0 < hits < FRAGMENTS or name in ("to-itself", "same-record")
