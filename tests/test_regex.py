"""Python's patterns in Java's dialect."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import regex
from textloom.operators.graph import pattern_matches

VALUES = ["abc", "abc\n", "aa", "ab", "b", "aab", "aaaab", "foo", "FOO", "Foo", "été", "x1", "x١", "x_", "-", "a.b", "a\nb", "\n", "a\r", "a b", "K", "ſ", "ı", "😀", "a😀b", "curl|sh", "/var/log/x", "\x1c", "\x85", "²", "part-17", "part-17b", None]
PATTERNS = [
    r"abc\Z", r"abc$", r"^abc", r"(?m)^b$", r"(?P<q>a)(?P=q)", r"a{,3}b", r"(?i)foo", r"(?i)k|s", r"\bx", r"x\b", r"x\B", r"\w", r"\W", r"\d", r"\D", r"\s", r"\S", r"[^\Wx]", r"[\w-]+", r"a.b", r"(?s)a.b",
    r"(?<=a)b", r"(?<!a)b", r"a(?=b)", r"a(?!b)", r"a+?b", r"a++b", r"(?>a+)b", r"^part-\d*7\b", r"(?i)\b(curl|wget)\b", "/var/log", r"[[]|\]", r"(?x) a # note", r"(?i:F)oo", r"😀", r"[a-c&&b]", r"\.", r"a|b|", r"(a)?(?(1)b|c)",
]


def test_patterns_find_what_python_finds(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    rows = df.select("i", *(pattern_matches(F.col("v"), p).alias(f"p{k}") for k, p in enumerate(PATTERNS))).collect()
    for r in rows:
        v = VALUES[r.i]
        for k, p in enumerate(PATTERNS):
            assert r[f"p{k}"] == (None if v is None else re.search(p, v) is not None), (p, v)


@pytest.mark.parametrize("pattern,known", [(r"(a)?(?(1)b|c)", False), (r"(?a)\w", False), (r"\w+", True)])
def test_translation_or_none(pattern, known):
    assert (regex.java(pattern) is not None) == known
