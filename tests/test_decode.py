"""Expansion of encoded payloads: codecs, nesting, identity, budgets."""

import base64
import hashlib
import json

import pytest

from textloom import queries_scan
from textloom.operators import decode
from textloom.operators.decode import DecodeLimits


def b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


def run(spark, text, **limits):
    df = spark.createDataFrame([("r", text)], "artifact_id string, text string")
    rows = decode.expand(df, DecodeLimits(**limits)).orderBy("ordinal").collect()
    return [r for r in rows if r.why is None], [(r.why.code, r.why.message) for r in rows if r.why is not None]


@pytest.mark.parametrize("payload,codec", [(b64("echo hello world"), "base64"), ("48656c6c6f20776f726c64", "hex"), ("%48%65%6c%6c%6f", "url")])
def test_codecs(spark, payload, codec):
    children, wrong = run(spark, f"x {payload} y")
    assert [(c.codec, c.parent_span.start, c.parent_span.end) for c in children][0] == (codec, 2, 2 + len(payload))


def test_nested_chain_and_identity(spark):
    inner = "run the inner text"
    outer = b64("0000 " + b64(inner))
    children, _ = run(spark, outer)
    assert [c.depth for c in children] == [1, 2] and children[1].text == inner
    first, second = children
    span = {"artifact_id": "r", "end": len(outer), "start": 0}
    step = {"codec": "base64", "parent_artifact_id": "r", "parent_span": span}

    def digest(text, chain, depth, parent, at):
        provenance = {"chain": chain, "codec": "base64", "depth": depth, "parent_artifact_id": parent, "parent_span": at}
        body = {"text_id": hashlib.sha256(text.encode()).hexdigest(), "decode_provenance": provenance}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    assert first.artifact_id == digest(first.text, [], 1, "r", span)
    at = {"artifact_id": first.artifact_id, "end": second.parent_span.end, "start": second.parent_span.start}
    assert second.artifact_id == digest(inner, [step], 2, first.artifact_id, at)


def test_same_text_twice_has_two_ids(spark):
    token = b64("Hello world")
    children, _ = run(spark, f"{token} {token}")
    assert len(children) == 2 and len({c.artifact_id for c in children}) == 2


@pytest.mark.parametrize("text,code", [("/" * 32, "decode_non_text"), ("%ff%fe%41%41", "decode_non_text"), ("abcdefghi", "decode_invalid"), ("QUJD" * 8000, "decode_limit")])
def test_rejections(spark, text, code):
    children, wrong = run(spark, text)
    assert not children and [c for c, _ in wrong] == [code]


def test_budgets_are_greedy(spark):
    a, b, c = b64("A a a a a"), b64("B b b b b " * 3), b64("C c c c c")
    text = f"{a} {b} {c}"
    assert [x.text[0] for x in run(spark, text, max_children=2, max_aggregate_bytes=64, max_child_bytes=64)[0]] == ["A", "B"]
    children, wrong = run(spark, text, max_child_bytes=20, max_aggregate_bytes=20)
    assert [x.text[0] for x in children] == ["A", "C"]
    assert wrong == [("decode_limit", "base64 that may decode to too many bytes")]
    children, wrong = run(spark, text, max_child_bytes=30, max_aggregate_bytes=30)
    assert [x.text[0] for x in children] == ["A", "C"]
    assert wrong == [("decode_limit", "too many bytes in all children")]


def test_what_is_below_a_rejected_child_vanishes(spark):
    nested = b64("zz " + b64("inner text here"))
    children, wrong = run(spark, f"{b64('A a a a a a')} {nested}", max_children=1)
    assert len(children) == 1 and wrong == [("decode_limit", "too many children")]


def test_depth_limit(spark):
    text = b64("a " + b64("b " + b64("c " + b64("deep"))))
    children, wrong = run(spark, text)
    assert [c.depth for c in children] == [1, 2] and ("decode_limit", "nested too deeply") in wrong


def test_nulls_and_bad_limits(spark):
    assert run(spark, None) == ([], [])
    with pytest.raises(ValueError):
        DecodeLimits(max_aggregate_bytes=1)


def test_depth_one_has_every_payload_of_a_document(spark, tmp_path):
    text = " ".join(base64.b64encode(f"hidden {k:05}".encode()).decode() for k in range(300))
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_scan.decode_depth_one(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.text for r in got] == [f"hidden {k:05}" for k in range(300)]
    assert all(r.doc_id == 1 and base64.b64decode(text[r.start : r.end]).decode() == r.text for r in got)
