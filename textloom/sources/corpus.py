"""Corpora of cases with known outcomes."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.functions.patterns import WS

CASES = "case_id string, fixture_path string, family string, role string, location string, language string, modality string, paired_with string, evidence_anchors array<struct<name:string,literal:string>>, " + ", ".join(f"{k} array<struct<name:string,anchors:array<string>>>" for k in ("expected_facts", "forbidden_facts", "expected_rules", "forbidden_rules"))


class CorpusError(ValueError):
    pass


# The names of the four anchors of every case, and markers that a fixture must not hold (in Java's dialect).
ANCHORS = ("source", "action", "sink", "modality")
UNSAFE = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?<![\p{L}\p{N}_])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}_])", r"(?md)^#!", r"(?<![\p{L}\p{N}_])rm\s+-rf(?![\p{L}\p{N}_])")
REQUIRED = {"case_id", "fixture_path", "family", "role", "location", "language", "modality", "paired_with", "evidence_anchors", "expected_facts", "forbidden_facts"}
NAME = re.compile(r"[a-z][a-z0-9-]{2,80}")
FACT = re.compile(r"[a-z][a-z0-9_:-]{2,80}")


def _check(case: dict) -> None:
    """Raises ``CorpusError`` unless a case is sound by itself."""

    def need(good: bool, what: str) -> None:
        if not good:
            raise CorpusError(f"{case.get('case_id')}: {what}")

    need(REQUIRED <= set(case) <= REQUIRED | {"expected_rules", "forbidden_rules"}, "keys are missing or unknown")
    need(isinstance(case["case_id"], str) and bool(NAME.fullmatch(case["case_id"])), "the id is not a name")
    raw = case["fixture_path"]
    place = PurePosixPath(raw)
    need(bool(raw) and len(raw) <= 512 and "\\" not in raw and not place.is_absolute() and not {".", ".."} & set(raw.split("/")), "the path leaves the corpus")
    need(case["role"] in ("risky", "near_miss"), "the role is unknown")
    anchors = case["evidence_anchors"]
    need(len(anchors) == 4 and {a["name"] for a in anchors} == set(ANCHORS), "each of the four anchors is named once")
    need(all(set(a) == {"name", "literal"} and 1 <= len(a["literal"]) <= 256 for a in anchors) and len({a["literal"] for a in anchors}) == 4, "anchors are different texts")
    for kind, name, shape in (("expected_facts", "fact", FACT), ("forbidden_facts", "fact", FACT), ("expected_rules", "rule_id", NAME), ("forbidden_rules", "rule_id", NAME)):
        said = case.get(kind, [])
        need(bool(said) or "rules" in kind, f"{kind} are missing")
        need(all(set(x) == {name, "anchors"} and shape.fullmatch(x[name]) and x["anchors"] and set(x["anchors"]) <= set(ANCHORS) for x in said), f"{kind} are not sound")
    if case["role"] == "risky":
        need(case["paired_with"] is None and case["modality"] == "imperative", "a risky case is imperative and has no pair")
    else:
        need(case["paired_with"] is not None and case["modality"] != "imperative", "a near miss has a pair and is not imperative")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a manifest; anything unsound in it raises ``CorpusError``."""
    try:
        spec = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        if not isinstance(spec, dict) or set(spec) != {"corpus_version", "cases"} or spec["corpus_version"] != "1.0" or not spec["cases"]:
            raise CorpusError("a manifest has the version 1.0 and cases")
        cases = spec["cases"]
        for c in cases:
            _check(c)
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise e if isinstance(e, CorpusError) else CorpusError("the manifest is not of the form of one") from e
    by_id = {c["case_id"]: c for c in cases}
    if len(by_id) != len(cases):
        raise CorpusError("a case occurs twice")
    for c in cases:
        pair = by_id.get(c["paired_with"])
        if c["role"] == "near_miss" and (pair is None or pair["role"] != "risky" or pair["family"] != c["family"]):
            raise CorpusError(f"{c['case_id']}: the pair is not a risky case of its family")
    said = lambda c, kind, name: [(x[name], x["anchors"]) for x in c.get(kind, [])]
    rows = [
        (
            *(c[k] for k in ("case_id", "fixture_path", "family", "role", "location", "language", "modality", "paired_with")), [(a["name"], a["literal"]) for a in c["evidence_anchors"]],
            said(c, "expected_facts", "fact"), said(c, "forbidden_facts", "fact"), said(c, "expected_rules", "rule_id"), said(c, "forbidden_rules", "rule_id"),
        )
        for c in cases
    ]
    return spark.createDataFrame(rows, CASES)


def with_text(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """Cases joined with (fixture_path, text)."""
    return cases.join(texts, "fixture_path").withColumn("artifact_id", ids.content_id(F.col("text")))


def load(spark: SparkSession, cases: DataFrame, folder: str) -> DataFrame:
    """Cases with the texts of their fixtures below ``folder``; raises where one is missing or unsafe, or an anchor is not there exactly once."""
    paths = [r.fixture_path for r in cases.select("fixture_path").distinct().collect()]  # as many as the manifest, which the driver has read
    bodies = spark.read.format("binaryFile").load([f"{folder}/{p}" for p in paths]).select("path", F.col("content").cast("string").alias("text"))
    names = spark.createDataFrame([(p,) for p in paths], "fixture_path string")
    texts = names.join(bodies, F.col("path").endswith(F.concat(F.lit("/fixtures/"), "fixture_path"))).select("fixture_path", "text")
    loaded = with_text(cases, texts)
    for found, what in ((cases.join(texts.filter(F.is_valid_utf8("text")), "fixture_path", "left_anti"), "has no readable text"), (unsafe(loaded), "is not safe"), (anchors(loaded).filter("start is null"), "lacks an anchor, or has it twice")):
        bad = found.select("case_id").orderBy("case_id").first()
        if bad:
            raise CorpusError(f"{bad.case_id}: the fixture {what}")
    return loaded


def anchors(loaded: DataFrame) -> DataFrame:
    """(case_id, name, start, end) of every anchor; start is null for a literal that does not occur exactly once."""
    rows = loaded.select("case_id", "text", F.explode("evidence_anchors").alias("a")).select("case_id", "text", "a.name", "a.literal")
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.col("literal"), F.lit("")))) / F.length("literal")
    at = F.when(n == 1, F.expr("locate(literal, text) - 1"))
    return rows.select("case_id", "name", at.alias("start"), (at + F.length("literal")).alias("end"))


def unsafe(loaded: DataFrame, markers: tuple[str, ...] = UNSAFE) -> DataFrame:
    """Cases whose text has a marker (a pattern) or a url host that does not end in ``.invalid``."""
    hosts = F.regexp_extract_all("text", F.lit(f"(?i)https?://([^/{WS}]+)"), F.lit(1))
    host = lambda h: F.lower(F.substring_index(F.substring_index(h, "@", -1), ":", 1))
    bad = F.exists(hosts, lambda h: ~host(h).endswith(".invalid"))
    for m in markers:
        bad |= F.col("text").rlike(m)
    return loaded.filter(bad)
