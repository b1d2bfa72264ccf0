import json
import os

import pytest

from textloom.plans import reports
from textloom.sources import corpus, files, readings
from textloom.streaming import scan


def test_scan_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_bytes("﻿line\r\né".encode())
    (tmp_path / "sub" / "a.TXT").write_text("same")
    (tmp_path / "c.txt").write_text("same")
    (tmp_path / "d.exe").write_text("x")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "f.txt").write_bytes(b"a" * (1 << 20) + b"a")
    os.symlink(tmp_path / "c.txt", tmp_path / "g.txt")
    rows = {os.path.basename(r.path): r for r in files.scan(spark, str(tmp_path)).collect()}
    assert {k: r.code for k, r in rows.items()} == {"b.md": None, "a.TXT": None, "c.txt": None, "d.exe": "unsupported_suffix", "e.txt": "invalid_utf8", "f.txt": "oversized_file", "g.txt": "skipped_symlink"}
    assert rows["b.md"].text == "﻿line\r\né" and rows["a.TXT"].artifact_id == rows["c.txt"].artifact_id
    assert files.accepted(files.scan(spark, str(tmp_path))).count() == 3


def test_catalog_and_function(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"version": "1", "fixtures": {"a": [{"outcome": "fragment", "payload": {}}, {"outcome": "refused"}]}}))
    stored = readings.read_catalog(spark, str(path))
    docs = spark.createDataFrame([("a", "t"), ("b", "u")], "artifact_id string, text string")
    got = sorted((r.artifact_id, r.ordinal, r.outcome, r.payload) for r in readings.catalog(docs, stored).collect())
    assert got == [("a", 0, "fragment", "{}"), ("a", 1, "refused", None), ("b", 0, "unsupported", None)]

    def lift(key, text):
        if key == "b":
            raise OSError
        return [("fragment", "{}")]

    assert sorted((r.artifact_id, r.outcome) for r in readings.from_function(docs, lift).collect()) == [("a", "fragment"), ("b", "incomplete")]
    path.write_text('{"version": "1", "fixtures": {"a": []}}')
    with pytest.raises(readings.CatalogError):
        readings.read_catalog(spark, str(path))


CASE = {
    "case_id": "risky-one", "fixture_path": "x.md", "family": "f", "role": "risky", "location": "skill", "language": "en", "modality": "imperative", "paired_with": None,
    "evidence_anchors": [{"name": n, "literal": f"{n} here"} for n in corpus.ANCHORS], "expected_facts": [{"fact": "send-data", "anchors": ["sink"]}], "forbidden_facts": [{"fact": "no-data", "anchors": ["source", "sink"]}],
}
MISS = CASE | {"case_id": "near-one", "fixture_path": "sub/y.md", "role": "near_miss", "modality": "quoted", "paired_with": "risky-one"}
GOOD = "source here, action here, sink here, modality here http://a.invalid/ http://u@b.invalid:80"


def manifest(tmp_path, *cases, version="1.0"):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"corpus_version": version, "cases": list(cases)}))
    return str(path)


def test_corpus(spark, tmp_path):
    (tmp_path / "fixtures" / "sub").mkdir(parents=True)
    (tmp_path / "fixtures" / "x.md").write_text(GOOD)
    (tmp_path / "fixtures" / "sub" / "y.md").write_text("é" + GOOD)
    cases = corpus.read_manifest(spark, manifest(tmp_path, CASE, MISS))
    loaded = corpus.load(spark, cases, str(tmp_path / "fixtures"))
    found = {(r.case_id, r.name): (r.start, r.end) for r in corpus.anchors(loaded).collect()}
    assert found["risky-one", "source"] == (0, 11) and found["near-one", "sink"] == (GOOD.index("sink") + 1, GOOD.index("sink") + 10) and len(found) == 8
    for text in ("twice: sink here " + GOOD, GOOD.replace("sink", ""), GOOD + " http://b.example/", GOOD + "\n#!/bin", GOOD + " AKIA" + "A" * 16, GOOD + " rm  -rf", GOOD + " -----BEGIN RSA PRIVATE KEY-----"):
        (tmp_path / "fixtures" / "x.md").write_text(text)
        with pytest.raises(corpus.CorpusError):
            corpus.load(spark, cases, str(tmp_path / "fixtures"))


@pytest.mark.parametrize(
    "cases",
    [
        [], [CASE, CASE], [CASE | {"fixture_path": "../x"}], [CASE | {"fixture_path": "/x"}], [CASE | {"fixture_path": "a\\b"}], [CASE | {"fixture_path": "./x"}], [CASE | {"role": "other"}], [CASE | {"modality": "quoted"}], [CASE | {"extra": 1}],
        [{k: v for k, v in CASE.items() if k != "expected_facts"}], [CASE | {"expected_facts": []}], [CASE | {"expected_facts": [{"fact": "send-data", "anchors": ["other"]}]}], [CASE | {"evidence_anchors": CASE["evidence_anchors"][:3]}],
        [CASE | {"evidence_anchors": [a | {"literal": "same"} for a in CASE["evidence_anchors"]]}], [MISS], [CASE, MISS | {"family": "g"}], [CASE, MISS | {"modality": "imperative"}], [CASE, MISS | {"paired_with": "near-one"}], [CASE | {"case_id": "X"}],
    ],
)
def test_unsound_manifests(spark, tmp_path, cases):
    with pytest.raises(corpus.CorpusError):
        corpus.read_manifest(spark, manifest(tmp_path, *cases))


def test_manifest_version(spark, tmp_path):
    with pytest.raises(corpus.CorpusError):
        corpus.read_manifest(spark, manifest(tmp_path, CASE, version="2"))


def test_family_report(spark):
    hits = spark.createDataFrame([("1", "f", "risky", ["a", "b"]), ("2", "f", "near_miss", ["b"]), ("3", "g", "risky", [])], "case_id string, family string, role string, hits array<string>")
    got = {r.family: (r.risky_hits, r.regressions) for r in reports.family_report(hits).collect()}
    assert got == {"f": (["a", "b"], 1), "g": ([], 0)}
    total = reports.summary(reports.family_report(hits)).first()
    assert (total.zero_coverage, total.regressed, total.total_regressions) == (["g"], ["f"], 1)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([("a", "go 8.8.8.8"), ("b", "none")], "artifact_id string, text string").write.parquet(str(folder))
    stream = spark.readStream.schema("artifact_id string, text string").parquet(str(folder))
    query = scan.indicators(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        assert [(r.artifact_id, r.value) for r in spark.table("seen").collect()] == [("a", "8.8.8.8")]
    finally:
        query.stop()
