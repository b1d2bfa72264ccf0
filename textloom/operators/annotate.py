"""The thirteen annotators: what a text shows on its surface, with exact spans.

Input is any DataFrame with an id and a text column; nothing is shuffled.  Matches of one
annotator do not overlap, matches of different ones may.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import patterns as P
from textloom.operators.spans import match_spans

ANNOTATION = "struct<kind:string,start:int,end:int,value:string,normalized_values:array<string>>"


def _none(m: Column) -> Column:
    return F.array().cast("array<string>")


def _whole(m: Column) -> Column:
    return F.array(m)


def _url_parts(m: Column) -> Column:
    at = F.instr(m, "://")
    rest = F.substring(m, at + 3, F.length(m))
    return F.array(F.lower(F.substring(m, F.lit(1), at - 1)), F.lower(F.substring_index(rest, "/", 1)))


def _variable(m: Column) -> Column:
    return F.array(F.regexp_replace(m, r"[${}]", ""))


def _octets_fit(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255)


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters, in bits."""
    n = F.length(token)
    chars = F.array_distinct(F.split(token, ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def _disordered(m: Column) -> Column:
    return entropy(m) >= P.MIN_ENTROPY - 1e-9


def _without(lead: str) -> Callable[[Column, Column], Column]:
    return lambda m, at: F.regexp_replace(m, f"^(?:{lead})", "")


def _lines(m: Column, at: Column) -> Column:
    """The end of the line before is no part of a command; a text's start has no line before."""
    return F.when(at > 0, _without(P.SHELL_LEAD)(m, at)).otherwise(m)


@dataclass(frozen=True)
class Annotator:
    kind: str
    pattern: str
    values: Callable[[Column], Column] = _none
    keep: Callable[[Column], Column] | None = None
    meant: Callable[[Column, Column], Column] | None = None


ANNOTATORS = (
    Annotator("url", P.URL, _url_parts),
    Annotator("domain", P.DOMAIN, lambda m: F.array(F.lower(m)), None, _without(P.DOMAIN_LEAD)),
    Annotator("ip_address", P.IP_ADDRESS, _whole, _octets_fit),
    Annotator("filesystem_path", P.FILESYSTEM_PATH),
    Annotator("environment_variable", P.ENVIRONMENT_VARIABLE, _variable),
    Annotator("code_fence", P.CODE_FENCE),
    Annotator("shell_command", P.SHELL_COMMAND, _none, None, _lines),
    Annotator("base64_candidate", P.BASE64_CANDIDATE),
    Annotator("hex_candidate", P.HEX_CANDIDATE),
    Annotator("url_encoded_candidate", P.URL_ENCODED_CANDIDATE),
    Annotator("high_entropy_candidate", P.LONG_TOKEN, _none, _disordered),
    Annotator("explicit_file_reference", P.LABELLED_FILE, _whole, None, _without(f"(?iu){P.LABEL}")),
    Annotator("explicit_file_reference", P.FILE_NAME),
)


def _parts(text: Column, kinds: tuple[str, ...] | None) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    parts = []
    for a in ANNOTATORS:
        if not kinds or a.kind in kinds:
            found = match_spans(whole, a.pattern, a.meant)
            parts.append(_annotated(_kept(found, a) if a.keep else found, a))
    return parts


def annotations(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Array of annotations of ``text``, by (start, end, kind, first value)."""
    parts = _parts(text, kinds)
    if len(parts) == 1:  # matches of one pattern are in order
        return parts[0]
    key = F.transform(F.concat(*parts), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.coalesce(F.get(x["normalized_values"], F.lit(0)), F.lit("")).alias("first"), x.alias("it")))
    return F.transform(F.array_sort(key), lambda k: k["it"])


def _kept(found: Column, a: Annotator) -> Column:
    return F.filter(found, lambda s: a.keep(s["match"]))


def _annotated(found: Column, a: Annotator) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(F.lit(a.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("value"), a.values(s["match"]).alias("normalized_values")),
    )


def annotate(docs: DataFrame, key: str = "artifact_id", text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each annotation: ``key``, kind, start, end, value, normalized_values.  A null text has none."""
    found = docs.select(key, F.explode(F.concat(*_parts(F.col(text), kinds))).alias("a"))
    return found.select(key, "a.kind", "a.start", "a.end", "a.value", "a.normalized_values")
