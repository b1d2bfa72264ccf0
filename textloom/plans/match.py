"""A rule within one fragment: its first complete match, in plain Python, for a worker.

A fragment is one document's reading and is held whole.  Each condition between two selectors
becomes the pairs of ids that meet it; ids that no pair leads to are dropped until nothing
changes, and records are then chosen in selector order, with the same pruning after each
choice, so that where conditions form a tree no choice is ever taken back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from textloom.operators.graph import first_path, neighbours, reached
from textloom.plans.rules import Condition, Rule

ENDS = {"uses": ("operation", "entity")}
SPAN = {"at_artifact": "artifact_id", "at_start": "start", "at_end": "end"}
REFERENCES = ("actor", "inputs", "outputs", "destination")
SEARCHES = ("path", "distance", "sequence")


def ends(c: Condition) -> tuple[str, str]:
    return tuple(c.spec[k] for k in ENDS.get(c.name, ("from", "to")))


def needs(rule: Rule) -> dict[str, list[str]]:
    """The fields that ``matcher`` reads of each table, none of a table that it leaves alone."""
    out = {"entities": [], "operations": [], "relationships": []}
    names = {c.name for c in rule.where}
    for s in rule.select.values():
        mine = out["entities" if s.kind == "entity" else "operations"]
        mine += ["id", *("value" if f == "value_pattern" else f for v in s.variants for f in v), *(SPAN if s.by_evidence else ())]
    for c in rule.where:
        if c.name == "modality":
            out["operations"] += [k for k, v in c.spec.items() if k != "selector" and v is not None]
    if any(s.kind == "operation" for s in rule.select.values()) and names & {"uses", "sequence"}:
        out["operations"] += REFERENCES
    if names & {"direct", "trust_boundary", "path", "distance", "uses"}:
        out["relationships"] = ["id", "source", "relation", "target"]
    if "trust_boundary" in names:
        out["entities"] += ["id", "trust"]
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def relations(rule: Rule) -> set[str] | None:
    """The relations of the relationships that ``matcher`` looks at, or None for all of them."""
    out = set()
    for c in rule.where:
        if c.name == "trust_boundary" or (c.name in ("path", "distance") and c.spec["kind"] != "derivation"):
            return None
        out |= {"direct": {c.spec.get("relation")}, "uses": {"DECODES_TO"}}.get(c.name, {"DERIVED_FROM"} if c.name in ("path", "distance") else set())
    return out


def variants(rule: Rule, kind: str) -> list[dict] | None:
    """What records of a kind (entity, operation) must equal in one of these ways for ``matcher`` to look at them, or None for all of them."""
    if any(c.name == ("trust_boundary" if kind == "entity" else "sequence") for c in rule.where):
        return None
    return [{k: w for k, w in v.items() if k != "value_pattern"} for s in rule.select.values() if s.kind == kind for v in s.variants]


def _order(values) -> tuple:
    """A sort key as Spark compares: nulls first."""
    return tuple((v is not None, tuple((x is not None, x) for x in v) if isinstance(v, list) else v) for v in values)


def _tests(rule: Rule, name: str) -> Callable[[dict], bool]:
    """Whether a record meets a selector and the modality asked of it."""
    s = rule.select[name]
    asked = [(k, v) for c in rule.where if c.name == "modality" and c.spec["selector"] == name for k, v in c.spec.items() if k != "selector" and v is not None]
    variants = [([(k, w) for k, w in v.items() if k != "value_pattern"], [re.compile(w).search for k, w in v.items() if k == "value_pattern"]) for v in s.variants]

    def test(r: dict) -> bool:
        if not all(r[k] == w for k, w in asked):
            return False
        return any(all(r[k] == w for k, w in plain) and all(r["value"] is not None and search(r["value"]) is not None for search in searches) for plain, searches in variants)

    return test


def _references(r: dict, role: str) -> list[str]:
    parts = {"actor": [r["actor"]], "input": r["inputs"] or [], "output": r["outputs"] or [], "destination": [r["destination"]]}
    if role == "any" and (r["inputs"] is None or r["outputs"] is None):
        return []
    return [x for x in (sum(parts.values(), []) if role == "any" else parts[role]) if x is not None]


def _groups(names: list[str], conditions: list[Condition]) -> list[list[str]]:
    """Selectors that conditions connect, directly or through others."""
    of = {n: {n} for n in names}
    for c in conditions:
        left, right = ends(c)
        joined = of[left] | of[right]
        for n in joined:
            of[n] = joined
    return sorted({tuple(sorted(g)) for g in of.values()})


def _narrow(ids: dict[str, set], links: list[tuple[str, str, dict[str, set]]]) -> bool:
    """Drop the ids that some condition leads to no other from; whether each selector has one left."""
    changed = True
    while changed:
        changed = False
        for left, right, near in links:
            if left == right:
                kept = both = {x for x in ids[left] if x in near.get(x, ())}
            else:
                kept = {x for x in ids[left] if not ids[right].isdisjoint(near.get(x, ()))}
                both = ids[right].intersection(set().union(*(near[x] for x in kept)))
            for n, now in ((left, kept), (right, both)):
                if len(now) < len(ids[n]):
                    ids[n], changed = now, True
                if not now:
                    return False
    return True


def _choose(names: tuple[str, ...], found: dict[str, list[dict]], ids: dict[str, set], links: list) -> dict[str, dict] | None:
    if not names:
        return {}
    for r in found[names[0]]:
        if r["id"] in ids[names[0]]:
            trial = {**ids, names[0]: {r["id"]}}
            if _narrow(trial, links) and (rest := _choose(names[1:], found, trial, links)) is not None:
                return {names[0]: r, **rest}
    return None


class _Fragment:
    """The relationships and chains of one fragment, worked out when first asked for."""

    def __init__(self, entities: list[dict], operations: list[dict], relationships: list[dict]):
        self.entities, self.operations, self.relationships = entities, operations, relationships
        self.known: dict = {}

    def relations(self, c: Condition) -> list[dict]:
        if c.name == "direct":
            return [r for r in self.relationships if r["relation"] == c.spec["relation"]]
        trust: dict[str, set] = {}
        for e in self.entities:
            if e["trust"] is not None:
                trust.setdefault(e["id"], set()).add(e["trust"])
        return [r for r in self.relationships if any(a != b for a in trust.get(r["source"], ()) for b in trust.get(r["target"], ()))]

    def edges(self, c: Condition) -> list[tuple]:
        kind = "sequence" if c.name == "sequence" else c.spec["kind"]
        if kind not in self.known:
            if kind == "sequence":
                users: dict[str, list[str]] = {}
                for o in self.operations:
                    for x in set(o["inputs"] or ()) - {None}:
                        users.setdefault(x, []).append(o["id"])
                self.known[kind] = [(o["id"], t, t) for o in self.operations for x in set(o["outputs"] or ()) - {None} for t in users.get(x, ())]
            else:
                self.known[kind] = [(r["source"], r["target"], r["id"]) for r in self.relationships if kind != "derivation" or r["relation"] == "DERIVED_FROM"]
        return self.known[kind]

    def hops(self) -> list[dict]:
        return [r for r in self.relationships if r["relation"] == "DECODES_TO"]

    def near(self, c: Condition, found: dict[str, list[dict]], ids: dict[str, set]) -> dict[str, set]:
        """Ids by the ids that a condition leads to them from, of those that are left."""
        left, right = ends(c)
        out: dict[str, set] = {}
        if c.name in ("direct", "trust_boundary"):
            for r in self.relations(c):
                out.setdefault(r["source"], set()).add(r["target"])
        elif c.name == "uses":
            hop: dict[str, set] = {}
            for r in self.hops():
                hop.setdefault(r["source"], set()).add(r["target"])
            for r in found[left]:
                for x in _references(r, c.spec["role"]):
                    out.setdefault(r["id"], set()).update((x,), hop.get(x, ()))
        elif len(ids[right]) < len(ids[left]):  # walk back from the end that is known better
            back = [(b, a, None) for a, b, _ in self.edges(c)]
            for source, seen in reached(back, [(x, None) for x in ids[right]], c.spec.get("max_depth")):
                for x in seen & ids[left]:
                    out.setdefault(x, set()).add(source)
        else:
            out = dict(reached(self.edges(c), [(x, None) for x in ids[left]], c.spec.get("max_depth")))
        return {a: out[a] & ids[right] for a in ids[left] if a in out}


def matcher(rule: Rule) -> Callable[[list[dict], list[dict], list[dict]], tuple[list[int], list[int], list[int]] | None]:
    """A function of a fragment's records (of the fields that ``needs`` names): the places of those that the first match rests on, or None."""
    tests = {n: _tests(rule, n) for n in rule.select}
    waiting = [c for c in rule.where if c.name not in ("modality", "decoded_from")]
    waiting.sort(key=lambda c: c.name in SEARCHES)  # what needs no search comes first
    groups = [(g, [c for c in waiting if set(ends(c)) <= set(g)]) for g in _groups(sorted(rule.select), waiting)]

    def rank(s, r: dict) -> tuple:
        own = _order([*(r[k] for k in SPAN), r["id"]] if s.by_evidence else [r["id"]])
        return own, _order(r[k] for k in REFERENCES if k in r)

    def match(entities: list[dict], operations: list[dict], relationships: list[dict]):
        found, ids = {}, {}
        for n, s in sorted(rule.select.items(), key=lambda x: len(entities if x[1].kind == "entity" else operations)):  # the fewest first
            found[n] = [r for r in (entities if s.kind == "entity" else operations) if tests[n](r)]
            ids[n] = {r["id"] for r in found[n]} - {None}
            if not found[n]:
                return None
        here = _Fragment(entities, operations, relationships)
        chosen: dict[str, dict] = {}
        for group, conditions in groups:
            links: list[tuple] = []
            for c in conditions:
                links.append((*ends(c), here.near(c, found, ids)))
                if not _narrow(ids, links):
                    return None
            for n in group:
                found[n].sort(key=lambda r, s=rule.select[n]: rank(s, r))
            own = _choose(group, found, {n: ids[n] for n in group}, links)
            if own is None:
                return None
            chosen |= own
        return _rests_on(rule, here, chosen)

    return match


def _rests_on(rule: Rule, here: _Fragment, chosen: dict[str, dict]) -> tuple[list[int], list[int], list[int]]:
    """The places of all records that a match rests on."""
    entities = {chosen[n]["id"] for n, s in rule.select.items() if s.kind == "entity"}
    operations = {chosen[n]["id"] for n, s in rule.select.items() if s.kind == "operation"}
    relationships = set()
    for c in rule.where:
        if c.name in ("modality", "decoded_from"):
            continue
        one, two = (chosen[n]["id"] for n in ends(c))
        if c.name in ("direct", "trust_boundary"):
            relationships |= {r["id"] for r in here.relations(c) if r["source"] == one and r["target"] == two}
        elif c.name == "uses":
            refers = _references(chosen[ends(c)[0]], c.spec["role"])
            if two not in refers:
                relationships |= {r["id"] for r in here.hops() if r["target"] == two and r["source"] in refers}
        elif way := first_path(neighbours(here.edges(c)), one, two, c.spec.get("max_depth")):
            operations |= set(way[0]) if c.name == "sequence" else set()
            relationships |= set(way[1]) if c.name != "sequence" else set()
    tables = ((here.entities, entities), (here.operations, operations), (here.relationships, relationships))
    return tuple([k for k, r in enumerate(rows) if r["id"] is not None and r["id"] in ids] for rows, ids in tables)
