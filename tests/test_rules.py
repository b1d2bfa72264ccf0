"""Rule language and evaluation: one small graph, each condition with a hit and a miss."""

import pytest

from textloom import schemas
from textloom.operators import graph
from textloom.operators.graph import Facts
from textloom.plans import evaluate, hunt
from textloom.plans.rules import RuleError, describe, read_rule_dir, read_rule_text

A = "a" * 64


def span(s):
    return [(A, s, s + 1)]


def modality(**kw):
    flags = dict(imperative=True, hypothetical=False, conditional=False, quoted=False, example=False, descriptive=False) | kw
    return {"polarity": flags.pop("polarity", "positive"), **flags}


@pytest.fixture(scope="module")
def facts(spark):
    entity = lambda id, type, at, value=None, trust="TRUSTED": (A, 0, id, type, None, value, "UNKNOWN", trust, span(at), 0.9, False)
    entities = spark.createDataFrame(
        [entity("e.secret", "SECRET", 5, "key"), entity("e.mid", "FILE", 4, "/var/log/x"), entity("e.out", "NETWORK_DESTINATION", 3, "h", "EXTERNAL"), entity("e.alone", "TOOL", 2), entity("e.raw", "ENCODED_DATA", 1, "blob")],
        schemas.ENTITIES,
    )
    op = lambda id, op, at, ins, outs, dest=None, **kw: (A, 0, id, op, "e.alone", ins, outs, dest, modality(**kw), span(at), 0.9, False)
    operations = spark.createDataFrame(
        [op("o.read", "READ", 10, ["e.secret"], ["e.mid"]), op("o.pack", "ENCODE", 11, ["e.mid", "e.raw"], ["e.raw"], imperative=False), op("o.send", "SEND", 12, ["e.raw"], [], "e.out")],
        schemas.OPERATIONS,
    )
    rel = lambda id, s, r, t, at: (A, 0, id, s, r, t, span(at), 0.9, False)
    relationships = spark.createDataFrame(
        [rel("r.1", "e.mid", "DERIVED_FROM", "e.secret", 20), rel("r.2", "e.mid", "SENT_TO", "e.out", 21), rel("r.3", "e.secret", "REFERENCES", "e.mid", 22), rel("r.4", "e.secret", "TARGETS", "e.mid", 23), rel("r.5", "e.raw", "DECODES_TO", "e.secret", 24)],
        schemas.RELATIONSHIPS,
    )
    artifacts = spark.createDataFrame([(A, "in.md", "line\n" * 20, None)], f"artifact_id string, source_name string, text string, decode_provenance {schemas.PROVENANCE}")
    return Facts(entities, operations, relationships, artifacts)


def rule(select, where, id="r"):
    lines = ['version: "1.0"', f"id: {id}", "select:", *(f"  {k}: {v}" for k, v in select.items()), "where:", *(f"  - {w}" for w in where)]
    return read_rule_text("\n".join(lines))


SECRET, OUT, MID = "{entity: {type: SECRET}}", "{entity: {trust: EXTERNAL}}", "{entity: {value_pattern: /var/log}}"


@pytest.mark.parametrize(
    "select,where,hit,relationships,operations",
    [
        ({"a": MID, "b": OUT}, ["direct: {from: a, to: b, relation: SENT_TO}"], True, ["r.2"], []),
        ({"a": SECRET, "b": OUT}, ["direct: {from: a, to: b, relation: SENT_TO}"], False, [], []),
        ({"a": MID, "b": OUT}, ["trust_boundary: {from: a, to: b}"], True, ["r.2"], []),
        ({"a": SECRET, "b": MID}, ["trust_boundary: {from: a, to: b}"], False, [], []),
        ({"a": SECRET, "b": OUT}, ["path: {from: a, to: b}"], True, ["r.2", "r.3"], []),
        ({"a": OUT, "b": SECRET}, ["path: {from: a, to: b}"], False, [], []),
        ({"a": SECRET}, ["path: {from: a, to: a}"], True, [], []),
        ({"a": MID, "b": SECRET}, ["path: {from: a, to: b, kind: derivation}"], True, ["r.1"], []),
        ({"a": SECRET, "b": OUT}, ["path: {from: a, to: b, kind: derivation}"], False, [], []),
        ({"a": SECRET, "b": OUT}, ["distance: {from: a, to: b, max_depth: 2}"], True, ["r.2", "r.3"], []),
        ({"a": SECRET, "b": OUT}, ["distance: {from: a, to: b, max_depth: 1}"], False, [], []),
        ({"f": "{operation: {op: READ}}", "l": "{operation: {op: SEND}}"}, ["sequence: {from: f, to: l}"], True, [], ["o.pack", "o.read", "o.send"]),
        ({"f": "{operation: {op: SEND}}", "l": "{operation: {op: READ}}"}, ["sequence: {from: f, to: l}"], False, [], []),
        ({"o": "{operation: {op: READ}}"}, ["modality: {selector: o, imperative: true}"], True, [], ["o.read"]),
        ({"o": "{operation: {op: ENCODE}}"}, ["modality: {selector: o, imperative: true}"], False, [], []),
        ({"o": "{operation: {op: READ}}", "e": SECRET}, ["uses: {operation: o, entity: e, role: input}"], True, [], ["o.read"]),
        ({"o": "{operation: {op: READ}}", "e": SECRET}, ["uses: {operation: o, entity: e, role: output}"], False, [], []),
        ({"o": "{operation: {op: SEND}}", "e": SECRET}, ["uses: {operation: o, entity: e, role: any}"], True, ["r.5"], ["o.send"]),
        ({"o": "{operation: {op: READ}}"}, ["decoded_from: {}"], False, [], []),
        ({"o": "{operation: {op: READ}}", "x": "{entity: {type: PROCESS}}"}, ["modality: {selector: o, imperative: true}"], False, [], []),
    ],
)
def test_conditions(facts, select, where, hit, relationships, operations):
    got = evaluate.evaluate(rule(select, where), facts).first()
    assert got.status == ("HIT" if hit else "NO_HIT")
    assert got.matched_relationship_ids == relationships
    if operations:
        assert got.matched_operation_ids == operations
    assert (got.explanation is None) == (not hit) and bool(got.evidence) == hit


def test_plain_selectors_go_by_id_and_any_by_evidence(facts):
    plain = rule({"e": "{entity: {underspecified: false}}", "o": "{operation: {op: READ}}"}, ["modality: {selector: o, imperative: true}"])
    assert evaluate.evaluate(plain, facts).first().matched_entity_ids == ["e.alone"]
    either = rule({"e": "{any: [{entity: {type: SECRET}}, {entity: {type: ENCODED_DATA}}]}", "o": "{operation: {op: READ}}"}, ["modality: {selector: o, imperative: true}"])
    got = evaluate.evaluate(either, facts).first()
    assert got.matched_entity_ids == ["e.raw"] and [r.record_id for r in got.evidence] == ["e.raw", "o.read"]


def test_multi_edges_and_cycles_give_all_simple_paths(spark, facts):
    pairs = spark.createDataFrame([(A, 0, "e.secret", "e.out")], "artifact_id string, ordinal int, source string, sink string")
    got = graph.paths(graph.edges_of(facts.relationships), pairs).collect()
    assert sorted(tuple(r.edges) for r in got) == [("r.3", "r.2"), ("r.4", "r.2")]


def test_hunt_gives_places(facts):
    got = hunt.hunt(rule({"a": MID, "b": OUT}, ["direct: {from: a, to: b, relation: SENT_TO}"]), facts, facts.keys(), rounds=1).first()
    assert [(h.source_name, h.start, h.line, h.column) for h in got.hints] == [("in.md", 3, 1, 4), ("in.md", 4, 1, 5), ("in.md", 21, 5, 2)]


@pytest.mark.parametrize(
    "text,code",
    [
        ("", "empty_rule"), ("[1]", "invalid_rule_root"), ("a: 1\na: 2", "duplicate_yaml_key"), ("a: &x 1", "yaml_alias_not_allowed"), ("a: !!str 1", "yaml_tag_not_allowed"),
        ("a: 1\n---\nb: 2", "multiple_yaml_documents"), ("a: [", "malformed_yaml"), ("a: " + "[" * 70 + "]" * 70, "yaml_nesting_limit"), ("x" * 70000, "oversized_rule"), ("a: 1", "invalid_rule_shape"),
    ],
)
def test_rejected_rules(text, code):
    with pytest.raises(RuleError) as e:
        read_rule_text(text)
    assert e.value.code == code


@pytest.mark.parametrize(
    "select,where",
    [
        ({"a": SECRET}, ["direct: {from: a, to: b, relation: SENT_TO}"]),
        ({"a": SECRET, "b": OUT}, ["direct: {from: a, to: b, relation: NOPE}"]),
        ({"a": SECRET, "b": OUT}, ["distance: {from: a, to: b, max_depth: 5}"]),
        ({"a": SECRET}, ["modality: {selector: a, imperative: true}"]),
        ({"a": "{entity: {}}"}, ["decoded_from: {}"]),
        ({"a": "{any: [{entity: {type: SECRET}}, {operation: {op: READ}}]}"}, ["decoded_from: {}"]),
        ({"A": SECRET}, ["decoded_from: {}"]),
        ({"a": SECRET}, ["decoded_from: {codec: rot13}"]),
        ({"a": "{entity: {type: SECRET, colour: red}}"}, ["decoded_from: {}"]),
    ],
)
def test_rejected_shapes(select, where):
    with pytest.raises(RuleError) as e:
        rule(select, where)
    assert e.value.code == "invalid_rule_shape"


def test_rule_folder(tmp_path):
    good = 'version: "1.0"\nid: {}\nselect:\n  o: {{operation: {{op: READ}}}}\nwhere:\n  - decoded_from: {{}}\n'
    (tmp_path / "b.yaml").write_text(good.format("two"))
    (tmp_path / "a.yaml").write_text(good.format("one"))
    assert [r.id for r in read_rule_dir(tmp_path)] == ["one", "two"]
    (tmp_path / "c.yaml").write_text("nope")
    with pytest.raises(RuleError):
        read_rule_dir(tmp_path)
    assert len(read_rule_dir(tmp_path, skip_bad=True)) == 2


def test_describe(tmp_path):
    (tmp_path / "a.yaml").write_text('version: "1.0"\nid: one\ndescription: d\nmetadata: {description: more, author: me, references: ["https://a.example/x"]}\nselect: {e: {entity: {type: FILE}}}\nwhere: [{path: {from: e, to: e}}]\n')
    (tmp_path / "b.yaml").write_text("broken")
    (tmp_path / "c.yaml").write_text('version: "1.0"\nid: two\ndescription: d\nselect: {e: {entity: {type: FILE}}}\nwhere: [{path: {from: e, to: e}}]\n')
    got = describe(tmp_path)
    assert [(r["id"], r["description"], r["author"], r["references"]) for r in got] == [("one", "more", "me", ["https://a.example/x"]), ("two", "d", None, [])] and got[1]["text"].startswith("version")
