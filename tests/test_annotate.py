"""Spans of the annotators against Python's own matcher."""

import itertools
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.operators.annotate import annotate, annotations
from textloom.operators.spans import match_spans, running

# The same shapes in Python's dialect, for the kinds whose dialects differ least.
SHAPES = {
    "ip_address": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "domain": r"(?<![A-Za-z0-9_-])(?:[A-Za-z0-9-]+\.)+[A-Za-z][A-Za-z0-9-]*(?![A-Za-z0-9_-])",
    "base64_candidate": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{8,}={0,2}(?![A-Za-z0-9+/=_-])",
    "hex_candidate": r"(?<![A-Fa-f0-9])(?:[A-Fa-f0-9]{2}){4,}(?![A-Fa-f0-9])",
    "url_encoded_candidate": r"(?<!%)(?:%[0-9A-Fa-f]{2}){4,}",
    "shell_command": r"(?m)^\s*(?:[$#]\s*)?(?:curl|wget|python3?|node|bash|sh|zsh|pwsh|powershell|rm|cp|mv|cat|grep|sed|awk|chmod|chown|git)\b[^\r\n]*",
    "environment_variable": r"\$(?:\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z_][A-Za-z0-9_]*)",
}
PIECES = [
    "a.b.1.c", "a.b_c", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "SGVsbG8gd29ybGQ=", "deadbeef", "deadbeef0", "%41%42%43%44", "%%41%42%43%44",
    "_b.", "x.y", "1.", "-a.", "${AB}", "$x1", " ", "\n", "\r\n", " ", "\xa0", "é", "😀", ".", "-", "_", "=", "curl x", "\n\n git", " \n", "$ rm", "# sh\r\n", "\n",
]


def _texts():
    rnd = random.Random(5)
    return ["".join(rnd.choice(PIECES) + rnd.choice(["", " "]) for _ in range(rnd.randrange(25))) for _ in range(400)] + ["", None, "a." * 5000, "a." * 200 + "b", "1." * 300 + "_1.2.c.d", "_." * 99 + "a.b", "1" * 20000]


def test_spans_equal_pythons(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "artifact_id long, text string")
    got = {}
    for r in annotate(df, kinds=tuple(SHAPES)).collect():
        got.setdefault((r.artifact_id, r.kind), []).append((r.start, r.end))
    for i, t in enumerate(texts):
        for kind, shape in SHAPES.items():
            want = [m.span() for m in re.finditer(shape, t or "") if kind != "ip_address" or all(int(p) <= 255 for p in m[0].split("."))]
            assert sorted(got.get((i, kind), [])) == want, (kind, t)


def test_order_values_and_overlaps(spark):
    text = "see HTTPS://A.example.com/x?y, $HOME and include: f.md\n```sh\ncurl x\n```\n  git pull"
    rows = annotate(spark.createDataFrame([("a", text)], "artifact_id string, text string")).collect()
    found = [(r.kind, r.value, tuple(r.normalized_values)) for r in rows]
    assert ("url", "HTTPS://A.example.com/x?y,", ("https", "a.example.com")) in found
    assert ("domain", "A.example.com", ("a.example.com",)) in found
    assert ("environment_variable", "$HOME", ("HOME",)) in found
    assert ("explicit_file_reference", "f.md", ("f.md",)) in found and ("explicit_file_reference", "f.md", ()) in found
    assert any(k == "code_fence" for k, *_ in found) and ("shell_command", "  git pull", ()) in [(k, v.lstrip("\n"), n) for k, v, n in found]
    ordered = spark.createDataFrame([(text,)], "t string").select(annotations(F.col("t")).alias("a")).first().a
    keys = [(r.start, r.end, r.kind) for r in ordered]
    assert keys == sorted((r.start, r.end, r.kind) for r in rows)


def test_label_does_not_cross_a_line(spark):
    df = spark.createDataFrame([("a", "include:\n```x\n```")], "artifact_id string, text string")
    assert annotate(df, kinds=("explicit_file_reference",)).count() == 0


@pytest.mark.parametrize("token,kept", [("0" * 40, False), ("AbCdEf0123456789zyxwvutsrqponmlkjihg", True)])
def test_entropy(spark, token, kept):
    bits = -sum(c / len(token) * math.log2(c / len(token)) for c in Counter(token).values())
    assert (bits >= 3.5) == kept
    df = spark.createDataFrame([("a", token)], "artifact_id string, text string")
    assert annotate(df, kinds=("high_entropy_candidate",)).count() == int(kept)


def test_line_and_column(spark):
    text = "a😀\nbc\r\nd"
    row = spark.createDataFrame([(text,)], "t string").select(
        *(F.struct(ids.line_of(F.col("t"), F.lit(i)).alias("l"), ids.column_of(F.col("t"), F.lit(i)).alias("c")).alias(f"p{i}") for i in range(len(text)))
    ).first()
    for i in range(len(text)):
        assert tuple(row[i]) == (text.count("\n", 0, i) + 1, i - text.rfind("\n", 0, i))


def test_part_of_a_match(spark):
    meant = lambda m, at: F.regexp_replace(m, "^k: ?", "")
    row = spark.createDataFrame([("k: aa k:b",)], "t string").select(match_spans(F.col("t"), r"k: ?(\w+)", meant).alias("s")).first()
    assert [tuple(x) for x in row.s] == [(3, 5, "aa"), (8, 9, "b")]


def test_running(spark):
    every = {n: [(7 * i * i) % 101 for i in range(n)] for n in (0, 1, 127, 128, 129, 256, 5000, 40_000)}
    df = spark.createDataFrame(list(every.items()), "n int, v array<int>")
    for r in df.select("n", running(F.col("v")).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect():
        values = every[r.n]
        assert r.s == [0, *itertools.accumulate(values)] and r.m == [0, *itertools.accumulate(values, max)]


@pytest.mark.parametrize("piece,kind", [("longword ", "base64_candidate"), ("1.", "domain"), ("a.b ", "domain"), ("\n", "shell_command"), ("x\n", "shell_command")])
def test_time_grows_with_the_text(spark, piece, kind):
    """Four times the text takes well under the sixteen times of a quadratic plan."""
    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([("a", piece * n)], "artifact_id string, text string").cache()
        df.count()
        start = time.perf_counter()
        annotate(df, kinds=(kind,)).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 1, took
