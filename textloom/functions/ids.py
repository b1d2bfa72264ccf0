"""Identity expressions: digests of canonical JSON and readable slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """SHA-256 of the UTF-8 text."""
    return F.sha2(text.cast("binary"), 256)


def slug(value: Column) -> Column:
    """Lower case, runs of other characters as one ``_``, at most 48 characters, ``value`` if nothing is left."""
    body = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")
    return F.substring(F.coalesce(F.nullif(F.regexp_replace(body, "^_|_$", ""), F.lit("")), F.lit("value")), 1, 48)


def json_of(*fields: Column, keep_nulls: bool = True) -> Column:
    """Compact JSON of the fields, which the caller gives in the alphabetical order of their names."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": str(not keep_nulls).lower()})


def canonical_id(prefix: str, kind: Column, value: Column | None, identity: Column) -> Column:
    """``prefix.slug(kind)[.slug(value)].digest``; a null value is left out."""
    tail = F.substring(F.sha2(identity.cast("binary"), 256), 1, 12)
    head = [F.lit(prefix), slug(kind)]
    if value is not None:
        head.append(F.when(value.isNotNull(), slug(value)))
    return F.concat_ws(".", *head, tail)


def static_entity_id(kind: Column, value: Column, start: Column, end: Column) -> Column:
    raw = F.concat_ws("\0", kind, value, start.cast("string"), end.cast("string"))
    return F.concat(F.lit("static."), F.lower(kind), F.lit("."), F.substring(F.sha2(raw.cast("binary"), 256), 1, 12))


def decodes_to_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("relationship.decodes_to."), F.substring(F.sha2(F.concat_ws("\0", source, target).cast("binary"), 256), 1, 16))


def line_of(text: Column, offset: Column) -> Column:
    """One-based line of a code-point offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """One-based column of a code-point offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1
