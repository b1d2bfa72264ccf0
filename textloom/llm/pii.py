"""Personal data in texts, by DataFrame functions only.

Regular expressions propose spans; validators confirm them (octets, the Luhn sum, digit
counts, mod 97); words near a span raise its score.  Confirmed spans of the four base
kinds always stand; the kinds that the method adds (``iban``, ``ssn``) stand from a score
of ``cutoff`` on.

All positions come from one pass: splitting by a pattern gives the text between its
matches, and running sums of the lengths give each match's place in code points.  Every
repetition is possessive, counted or a single character class, so that neither the regex engine's
stack nor its time grows beyond the text's length, and a look-behind keeps it from trying
every place inside a run.  Sums are folded by blocks and texts are cut by blocks, so the
work also grows with the number of spans and not with its square.  Everything happens
within a row: nothing is shuffled, and a row costs what its own text costs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import unused
from textloom.operators.spans import ends, let, running

BASE = ("email", "ip", "card", "phone")
NEAR = 40  # code points on each side that are searched for context words
BLOCK = 4096  # code points in which a text is cut to take pieces out of it


@dataclass(frozen=True)
class Kind:
    """``hint``: a cheap pattern that each match's text has; ``words``: context that raises the score by 0.2."""

    name: str
    pattern: str
    hint: str
    words: str
    score: float


_LOCAL = "A-Za-z0-9._%+-"
# The registered lengths of IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


# A number of its country's length ends there, whatever follows; others run on as far as they can.
_BY_COUNTRY = "|".join(f"{_iban(n, c)}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|adresse", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"\bip\b|address|host|server", 0.7),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+", r"[0-9]", "card|visa|credit|karte|carte|tarjeta", 0.8),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile|fax", 0.7),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_BY_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}+(?: ?[A-Z0-9]{{1,3}})?+)(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "iban|account|konto|bank|compte|cuenta", 0.8),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social security|tax id", 0.5),
)


def _luhn(digits: Column) -> Column:
    one = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(one, F.lit(0), lambda s, x: s + x) % 10 == 0


def _mod97(compact: Column) -> Column:
    moved = F.split(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4)), "")
    rest = F.aggregate(moved, F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(r"^(?:0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.|$)){4}$") & ~text.rlike(r"0*+(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3})")
    digits = F.translate(text, " ().+-", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    compact = F.translate(text, " ", "")
    if kind == "iban":
        return F.when(F.length(compact).between(15, 34), _mod97(compact)).otherwise(False)
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _found(kind: Kind, gaps: Column, matches: Column, cutoff: float) -> Column:
    """Array of (kind, start, end, score) of the confirmed matches, by start."""
    n = F.size(matches)
    rows = F.arrays_zip(matches.alias("match"), ends(gaps, matches).alias("end"), F.slice(gaps, F.lit(1), n).alias("before"), F.slice(gaps, F.lit(2), n).alias("after"))

    def span(x: Column) -> Column:
        near = F.lower(F.concat(F.right(x["before"], F.lit(NEAR)), F.lit(" "), F.left(x["after"], F.lit(NEAR)))).rlike(kind.words)
        score = F.lit(kind.score) + F.when(near, 0.2).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), (x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"), score.alias("score"))

    good = F.filter(rows, lambda x: _valid(kind.name, x["match"]))
    spans = F.transform(good, span)
    return spans if kind.name in BASE else F.filter(spans, lambda s: s["score"] >= cutoff)


def with_spans(docs: DataFrame, text: str = "text", cutoff: float = 0.65, name: str = "pii_spans") -> DataFrame:
    """``docs`` with ``name``: array of (kind, start, end, score), by kind as in KINDS, then by start.

    Positions count code points, the end is exclusive.  Null and empty texts have none.
    Repeated rows stay repeated, an empty table gives an empty one; a column that is called
    ``name`` already is replaced, all others stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    hit = {k.name: whole.contains("@") if k.hint == "@" else whole.rlike(k.hint) for k in KINDS}
    hit["ip"] = whole.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    hit["card"] = whole.rlike("[0-9](?:[ -]?[0-9]){12}")
    names = {k.name: tuple(unused(docs, f"_{k.name}_{part}") for part in ("gaps", "found")) for k in KINDS}
    out = docs.withColumns({c: F.when(hit[k.name], f(whole, k)) for k in KINDS for c, f in zip(names[k.name], (lambda w, k: F.split(w, k.pattern, -1), lambda w, k: F.regexp_extract_all(w, F.lit(k.pattern), F.lit(0))))})
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    spans = [F.coalesce(F.when(F.size(names[k.name][1]) > 0, _found(k, F.col(names[k.name][0]), F.col(names[k.name][1]), cutoff)), none) for k in KINDS]
    return out.withColumn(name, F.concat(*spans)).drop(*(c for pair in names.values() for c in pair))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts of the base kinds and of all spans, the digest of the base spans, all spans, their scores.

    One row for each row: repeated rows stay repeated, a null text counts as empty, an empty
    table gives an empty one.  Other columns are not read.
    """
    spans = F.col("pii_spans")
    found = with_spans(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("_key").alias(key),
        *map(count, BASE),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, given as its blocks."""
    p, q = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    first, last = (F.coalesce(F.get(blocks, k), F.lit("")) for k in (p, q))
    at = start - p * BLOCK + 1
    across = F.concat(F.substring(first, at, F.lit(BLOCK)), F.array_join(F.slice(blocks, p + 2, q - p - 1), ""), F.substring(last, F.lit(1), end - q * BLOCK))
    return F.when(p == q, F.substring(first, at, end - start)).otherwise(across)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("low"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(rows: Column, top: Column, blocks: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.get(rows, i)["start"] >= F.get(top, i))
        parts = F.transform(first, lambda i: F.concat(_piece(blocks, F.get(top, i), F.get(rows, i)["start"]), F.lit("<"), F.upper(F.get(rows, i)["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), _piece(blocks, F.element_at(top, -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ready = let(order, lambda rows: let(running(F.transform(rows, lambda r: r["end"]), F.greatest), lambda top: let(blocks, lambda b: cut(rows, top, b))))
    return F.when(F.size(spans) > 0, ready).otherwise(text)


def redacted(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``size``, if there, is set to the new length.

    Of overlapping spans the one that starts first (the longest of these) gives the name, and
    all that they cover is replaced.  Null and empty texts stay as they are, repeated rows stay
    repeated, an empty table gives an empty one, and all other columns stay.
    """
    spans = unused(docs, "_spans")
    found = with_spans(docs, text, name=spans)
    out = found.withColumn(text, masked(F.col(text), F.col(spans))).drop(spans)
    return out.withColumn(size, F.coalesce(F.length(text).cast("long"), F.lit(0).cast("long"))) if size in docs.columns else out
