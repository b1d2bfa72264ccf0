"""All matches of a pattern with their places, as one array expression.

Splitting by a pattern gives the text between the very matches that extracting gives, so
running sums of both lengths are the places, in code points.  It all stays within a row.

A fold that appends to an array copies it at each step, so ``running`` folds blocks of
``BLOCK`` values and then the blocks' results: the work of n values is that of n * BLOCK +
(n / BLOCK)^2 copied references, which for ten million in one row is still a second or two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,match:string>>"
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(one: Column, two: Column) -> Column:
    return one + two


def running(values: Column, join: Callable[[Column, Column], Column] = _sum) -> Column:
    """For n integers the n + 1 results of ``join`` over the first 0, 1, ..., n of them; none of them is below 0.

    ``join`` is associative, and 0 changes nothing: a sum, or the greatest.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(join(F.element_at(s, -1), x))))

    def joined(parts: Column) -> Column:
        before = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(F.slice(p, F.lit(2), F.lit(BLOCK)), lambda x: join(x, b)))
        return F.concat(F.array(F.lit(0)), F.flatten(moved))

    def either(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        parts = F.transform(starts, lambda i: fold(F.slice(v, i, F.lit(BLOCK))))
        return F.when(F.size(v) <= BLOCK, fold(v)).otherwise(let(parts, joined))

    return let(values, either)


def ends(gaps: Column, matches: Column) -> Column:
    """Where each match ends, for the texts between matches and the matches themselves."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    return F.slice(running(lengths), F.lit(2), F.size(matches))


def match_spans(text: Column, pattern: str, meant: Callable[[Column, Column], Column] | None = None) -> Column:
    """Array of (start, end, match), by start; ``meant``: of a match and its start, the part of it (up to its end) that is meant."""

    def span(m: Column, end: Column) -> Column:
        part = meant(m, end - F.length(m)) if meant else m
        return F.struct((end - F.length(part)).alias("start"), end.alias("end"), part.alias("match"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(found, lambda m: F.zip_with(m, ends(F.split(text, pattern, -1), m), span))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))
