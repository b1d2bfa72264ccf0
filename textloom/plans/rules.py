"""The rule language: strict YAML in, one immutable rule out.

Rules are plan input, like SQL text: they are read and checked on the driver, and nothing
of them but literals reaches a plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from textloom.functions import vocab

NAME = re.compile(r"[a-z][a-z0-9_]{0,63}")
RULE_ID = re.compile(r"[a-z][a-z0-9-]{0,79}")
MODALITY = ("polarity", *vocab.MODALITY_FLAGS)


class RuleError(ValueError):
    """A rule that cannot be used: ``code`` says why."""

    def __init__(self, code: str, message: str = "", path: str = ""):
        super().__init__(f"[{code}] {path}: {message}" if path else f"[{code}] {message}")
        self.code, self.path = code, path


@dataclass(frozen=True)
class Selector:
    """``kind``: entity or operation.  ``variants``: filters, any of which may match; ``by_evidence``: written with ``any``."""

    kind: str
    variants: tuple[dict, ...]
    by_evidence: bool = False


@dataclass(frozen=True)
class Condition:
    name: str
    spec: dict


@dataclass(frozen=True)
class Rule:
    id: str
    select: dict[str, Selector]
    where: tuple[Condition, ...]
    description: str | None = None
    metadata: dict | None = field(default=None, compare=False)


def _fail(message: str):
    raise RuleError("invalid_rule_shape", message)


def _mapping(value, allowed: dict[str, bool], what: str) -> dict:
    """``value`` as a mapping whose keys are all allowed; True marks a key that must be there."""
    if not isinstance(value, dict):
        _fail(f"{what} must be a mapping")
    if extra := [k for k in value if k not in allowed]:
        _fail(f"{what} has unknown keys {extra}")
    if missing := [k for k, must in allowed.items() if must and k not in value]:
        _fail(f"{what} lacks {missing}")
    return value


def _text(value, most: int, what: str, pattern: re.Pattern | None = None) -> str:
    if not isinstance(value, str) or not 1 <= len(value) <= most or (pattern and not pattern.fullmatch(value)):
        _fail(f"{what} is not valid")
    return value


def _one_of(value, allowed, what: str) -> str:
    if not isinstance(value, str) or value not in allowed:
        _fail(f"{what} must be one of {list(allowed)}")
    return value


def _flag(value, what: str) -> bool:
    if not isinstance(value, bool):
        _fail(f"{what} must be true or false")
    return value


def _entity(spec) -> dict:
    keys = dict.fromkeys(("type", "subtype", "value", "value_pattern", "sensitivity", "trust", "underspecified"), False)
    out = {k: v for k, v in _mapping(spec, keys, "entity").items() if v is not None}
    if not out:
        _fail("an entity selector must declare a predicate")
    for name, allowed in (("type", vocab.ENTITY_TYPES), ("sensitivity", vocab.SENSITIVITIES), ("trust", vocab.TRUST_LEVELS)):
        if name in out:
            _one_of(out[name], allowed, name)
    for name in ("subtype", "value"):
        if name in out:
            _text(out[name], 256, name, re.compile(r"\S+"))
    if "underspecified" in out:
        _flag(out["underspecified"], "underspecified")
    if "value_pattern" in out:
        _text(out["value_pattern"], 1024, "value_pattern")
        try:
            re.compile(out["value_pattern"])
        except re.error:
            _fail("value_pattern is not a regular expression")
    return out


def _modality(spec: dict) -> dict:
    out = {k: v for k, v in spec.items() if k in MODALITY and v is not None}
    for name, value in out.items():
        _one_of(value, vocab.POLARITIES, name) if name == "polarity" else _flag(value, name)
    return out


def _operation(spec) -> dict:
    _mapping(spec, dict.fromkeys(("op", *MODALITY), False), "operation")
    out = _modality(spec)
    if spec.get("op") is not None:
        out["op"] = _one_of(spec["op"], vocab.OPCODES, "op")
    if not out:
        _fail("an operation selector must declare a predicate")
    return out


def _selector(spec, what: str) -> Selector:
    if not isinstance(spec, dict) or len(spec) != 1:
        _fail(f"{what} must have exactly one of entity, operation, any")
    (kind, body), *_ = spec.items()
    if kind == "any":
        if not isinstance(body, list) or not body:
            _fail("any must be a list with entries")
        parts = [_selector(x, what) for x in body]
        if any(p.by_evidence for p in parts) or len({p.kind for p in parts}) != 1:
            _fail("any cannot mix or nest kinds")
        return Selector(parts[0].kind, tuple(p.variants[0] for p in parts), True)
    if kind not in ("entity", "operation"):
        _fail(f"{what} has unknown kind {kind!r}")
    return Selector(kind, (_entity(body) if kind == "entity" else _operation(body),))


#: For each condition: its keys (True: must be there) and the selector kinds its names refer to.
CONDITIONS = {
    "direct": ({"from": True, "to": True, "relation": True}, {"from": "entity", "to": "entity"}),
    "trust_boundary": ({"from": True, "to": True}, {"from": "entity", "to": "entity"}),
    "path": ({"from": True, "to": True, "kind": False}, {"from": "entity", "to": "entity"}),
    "distance": ({"from": True, "to": True, "max_depth": True, "kind": False}, {"from": "entity", "to": "entity"}),
    "sequence": ({"from": True, "to": True}, {"from": "operation", "to": "operation"}),
    "modality": ({"selector": True, **dict.fromkeys(MODALITY, False)}, {"selector": "operation"}),
    "uses": ({"operation": True, "entity": True, "role": False}, {"operation": "operation", "entity": "entity"}),
    "decoded_from": ({"codec": False}, {}),
}


def _condition(spec, select: dict[str, Selector]) -> Condition:
    if not isinstance(spec, dict) or len(spec) != 1 or next(iter(spec)) not in CONDITIONS:
        _fail("each condition must be one known condition")
    (name, body), *_ = spec.items()
    keys, refers = CONDITIONS[name]
    body = dict(_mapping(body, keys, name))
    for key, kind in refers.items():
        _text(body[key], 64, key, NAME)
        if body[key] not in select or select[body[key]].kind != kind:
            _fail(f"{name} refers to undeclared {kind} selector {body[key]!r}")
    if name == "direct":
        _one_of(body["relation"], vocab.RELATIONS, "relation")
    if name in ("path", "distance"):
        body["kind"] = _one_of(body.get("kind", "relationship"), ("relationship", "derivation"), "kind")
    if name == "distance" and (type(body["max_depth"]) is not int or not 1 <= body["max_depth"] <= 4):
        _fail("max_depth must be from 1 to 4")
    if name == "modality" and not _modality(body):
        _fail("a modality condition must declare a predicate")
    if name == "uses":
        body["role"] = _one_of(body.get("role", "any"), ("actor", "input", "output", "destination", "any"), "role")
    if name == "decoded_from" and body.get("codec") is not None:
        _one_of(body["codec"], vocab.CODECS, "codec")
    return Condition(name, body)


def rule_of(spec) -> Rule:
    """A rule from its parsed form."""
    _mapping(spec, {"version": True, "id": True, "description": False, "metadata": False, "select": True, "where": True}, "a rule")
    if spec["version"] != "1.0":
        _fail("version must be the string 1.0")
    _text(spec["id"], 80, "id", RULE_ID)
    if spec.get("description") is not None:
        _text(spec["description"], 512, "description")
    if (about := spec.get("metadata")) is not None:
        _mapping(about, {"description": True, "author": True, "references": False}, "metadata")
        for name, most in (("description", 512), ("author", 160)):
            _text(about[name], most, name, re.compile(r"[^\r\n\t]+"))
        for link in about.get("references") or []:
            _text(link, 2048, "a reference", re.compile(r"https://\S+"))
            if len(link) < 12:
                _fail("a reference is too short")
    if not isinstance(spec["select"], dict) or not spec["select"]:
        _fail("select must name selectors")
    select = {_text(name, 64, "a selector's name", NAME): _selector(body, str(name)) for name, body in spec["select"].items()}
    if not isinstance(spec["where"], list) or not spec["where"]:
        _fail("where must list conditions")
    return Rule(spec["id"], select, tuple(_condition(c, select) for c in spec["where"]), spec.get("description"), about)


def _check_tokens(text: str) -> None:
    depth = 0
    for token in yaml.scan(text):
        if isinstance(token, (yaml.FlowMappingStartToken, yaml.FlowSequenceStartToken)):
            depth += 1
            if depth > vocab.MAX_RULE_NESTING:
                raise RuleError("yaml_nesting_limit", "flow collections nest too deeply")
        elif isinstance(token, (yaml.FlowMappingEndToken, yaml.FlowSequenceEndToken)):
            depth -= 1
        elif isinstance(token, (yaml.AliasToken, yaml.AnchorToken)):
            raise RuleError("yaml_alias_not_allowed", "anchors and aliases are not allowed")
        elif isinstance(token, yaml.TagToken):
            raise RuleError("yaml_tag_not_allowed", "tags are not allowed")


def _unique_keys(node: yaml.Node | None) -> bool:
    if isinstance(node, yaml.SequenceNode):
        return all(map(_unique_keys, node.value))
    if isinstance(node, yaml.MappingNode):
        names = [(k.tag, k.value if isinstance(k, yaml.ScalarNode) else id(k)) for k, _ in node.value]
        return len(set(names)) == len(names) and all(_unique_keys(k) and _unique_keys(v) for k, v in node.value)
    return True


def read_rule_text(text: str) -> Rule:
    if len(text.encode()) > vocab.MAX_RULE_BYTES:
        raise RuleError("oversized_rule", "the rule is too large")
    if not text.strip():
        raise RuleError("empty_rule", "the rule is empty")
    try:
        _check_tokens(text)
        documents = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise RuleError("malformed_yaml", "the rule is not YAML") from e
    if len(documents) > 1:
        raise RuleError("multiple_yaml_documents", "a rule is one document")
    if not documents or documents[0] is None:
        raise RuleError("empty_rule", "the rule is empty")
    if not isinstance(documents[0], yaml.MappingNode):
        raise RuleError("invalid_rule_root", "a rule is a mapping")
    if not _unique_keys(documents[0]):
        raise RuleError("duplicate_yaml_key", "a key occurs twice")
    try:
        spec = yaml.safe_load(text)
    except (yaml.YAMLError, ValueError) as e:
        raise RuleError("malformed_yaml", "the rule is not YAML") from e
    return rule_of(spec)


def read_rule(path: str | Path) -> Rule:
    try:
        data = Path(path).read_bytes()
    except OSError as e:
        raise RuleError("unreadable_rule", "the file cannot be read", str(path)) from e
    if len(data) > vocab.MAX_RULE_BYTES:
        raise RuleError("oversized_rule", "the rule is too large", str(path))
    try:
        return read_rule_text(data.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise RuleError("invalid_rule_encoding", "the rule is not UTF-8", str(path)) from e


def read_rule_dir(path: str | Path, skip_bad: bool = False) -> list[Rule]:
    """All ``*.yaml`` rules of a folder by file name; the first bad one raises unless it is to be skipped."""
    out = []
    for p in sorted(Path(path).glob("*.yaml")):
        try:
            out.append(read_rule(p))
        except RuleError:
            if not skip_bad:
                raise
    return out


def describe(path: str | Path) -> list[dict]:
    """What a folder's sound rules say of themselves, by file name: id, description, author, references and their text."""
    out = []
    for p in sorted(Path(path).glob("*.yaml")):
        try:
            rule = read_rule(p)
        except RuleError:
            continue
        about = rule.metadata or {}
        out.append({"id": rule.id, "description": about.get("description", rule.description), "author": about.get("author"), "references": list(about.get("references") or []), "text": p.read_text(encoding="utf-8")})
    return out
