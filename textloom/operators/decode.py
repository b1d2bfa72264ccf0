"""Recursive expansion of encoded payloads under strict limits, one row at a time.

Every base64, hex or percent-encoded candidate of a text is decoded once; a decoded text
becomes a virtual child and is searched in turn.  Each level is one array column, made from
the level above; the budget (children and bytes for each root) is then spent greedily in
document order by one fold.  The fold keeps the accepted children alone, whose number the
limits bound; what each other candidate met follows from those before it.  Whatever lies
below a rejected child is dropped.  No row leaves its partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.operators.annotate import annotations
from textloom.operators.spans import let

SPAN = "struct<artifact_id:string,start:int,end:int>"
STEP = f"struct<parent_artifact_id:string,parent_span:{SPAN},codec:string>"
KINDS = ("base64_candidate", "hex_candidate", "url_encoded_candidate")


@dataclass(frozen=True)
class DecodeLimits:
    max_candidate_bytes: int = 16 * 1024
    max_child_bytes: int = 64 * 1024
    max_aggregate_bytes: int = 256 * 1024
    max_depth: int = 2
    max_children: int = 16
    candidate_minimum_chars: int = 8

    def __post_init__(self):
        bounds = {"max_candidate_bytes": 1 << 20, "max_child_bytes": 1 << 20, "max_aggregate_bytes": 4 << 20, "max_depth": 16, "max_children": 256, "candidate_minimum_chars": 16 << 10}
        for name, most in bounds.items():
            if not 1 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be from 1 to {most}")
        if self.max_aggregate_bytes < self.max_child_bytes:
            raise ValueError("max_aggregate_bytes must be at least max_child_bytes")
        if self.candidate_minimum_chars > self.max_candidate_bytes:
            raise ValueError("candidate_minimum_chars cannot exceed max_candidate_bytes")


def _codec(kind: Column) -> Column:
    return F.when(kind == "hex_candidate", "hex").when(kind == "base64_candidate", "base64").otherwise("url")


def candidates(text: Column, limits: DecodeLimits, sound: bool = False) -> Column:
    """Array of (start, end, codec, why, n_bytes, text) in document order; ``why`` is (code, message) of a failure.

    ``sound``: only those that decode to a text that is not empty.
    """

    def say(code: str, message: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))

    def tried(a: Column) -> Column:
        codec, raw = _codec(a["kind"]), a["value"]
        n = F.length(raw)
        size = F.when(codec == "base64", F.floor(n / 4) * 3).when(codec == "hex", F.floor(n / 2)).otherwise(0)
        why = (
            F.when(n < limits.candidate_minimum_chars, say("decode_limit", "too few characters to decode"))
            .when(n > limits.max_candidate_bytes, say("decode_limit", "too many characters to decode"))
            .when((codec == "base64") & (size > limits.max_child_bytes), say("decode_limit", "base64 that may decode to too many bytes"))
            .when((codec == "hex") & (size > limits.max_child_bytes), say("decode_limit", "hex that may decode to too many bytes"))
            .when((codec == "base64") & (n % 4 != 0), say("decode_invalid", "not sound base64"))
        )
        return F.struct(a["start"].alias("start"), a["end"].alias("end"), codec.alias("codec"), why.alias("why"), raw.alias("raw"))

    def decoded(a: Column) -> Column:
        raw = a["raw"]
        data = F.when(a["why"].isNotNull(), F.lit(None).cast("binary")).when(a["codec"] == "base64", F.unbase64(raw)).otherwise(F.unhex(F.replace(raw, F.lit("%"), F.lit(""))))

        def checked(d: Column) -> Column:
            big = F.when(F.octet_length(d) > limits.max_child_bytes, say("decode_limit", "decoded to too many bytes"))
            words = d.cast("string")
            inner = F.when(big.isNull() & F.is_valid_utf8(words), words)
            return F.struct(a["start"].alias("start"), a["end"].alias("end"), a["codec"].alias("codec"), F.coalesce(a["why"], big).alias("why"), F.octet_length(d).alias("n_bytes"), inner.alias("text"))

        return let(data, checked)

    def chosen(found: Column) -> Column:
        def alone(a: Column, i: Column) -> Column:  # the same span as base64 and as hex counts as hex
            later = F.get(found, i + 1)
            return ~((a["kind"] == "base64_candidate") & F.coalesce((later["kind"] == "hex_candidate") & (later["start"] == a["start"]) & (later["end"] == a["end"]), F.lit(False)))

        return F.filter(found, alone)

    attempts = F.transform(let(annotations(text, KINDS), chosen), tried)
    if not sound:
        return F.transform(attempts, decoded)
    return F.filter(F.transform(F.filter(attempts, lambda a: a["why"].isNull()), decoded), lambda c: c["why"].isNull() & (c["text"] != ""))


def child_id(text: Column, codec: Column, depth: Column, parent: Column, span: Column, chain: Column, **inferred: Column) -> Column:
    """Digest of the text's own id and its whole provenance, fields in alphabetical order; nulls are left out."""
    steps = F.transform(chain, lambda s: F.struct(s["codec"].alias("codec"), s["parent_artifact_id"].alias("parent_artifact_id"), _span_json(s["parent_span"]).alias("parent_span")))
    fields = {"chain": steps, "codec": codec, "depth": depth, "parent_artifact_id": parent, "parent_span": _span_json(span), **inferred}
    provenance = F.struct(*(fields[name].alias(name) for name in sorted(fields)))
    return F.sha2(ids.json_of(provenance.alias("decode_provenance"), ids.content_id(text).alias("text_id"), keep_nulls=False).cast("binary"), 256)


def _span_json(span: Column) -> Column:
    return F.struct(span["artifact_id"].alias("artifact_id"), span["end"].alias("end"), span["start"].alias("start"))


def _level(above: Column, limits: DecodeLimits, sound: bool) -> Column:
    """The candidates (or the sound ones) in the texts of ``above``, without regard to the budget."""

    def inside(f: Column) -> Column:
        return F.transform(candidates(f["text"], limits, sound), lambda c, i: placed(f, c, i))

    def placed(f: Column, c: Column, i: Column) -> Column:
        span = F.struct(f["artifact_id"].alias("artifact_id"), c["start"].alias("start"), c["end"].alias("end"))
        step = F.struct(f["parent_artifact_id"].alias("parent_artifact_id"), f["parent_span"].alias("parent_span"), f["codec"].alias("codec"))
        chain = F.when(f["parent_artifact_id"].isNull(), f["chain"]).otherwise(F.concat(f["chain"], F.array(step)))
        below = f["depth"] + 1
        own = F.when(c["text"].isNotNull(), child_id(c["text"], c["codec"], below, f["artifact_id"], span, chain))
        return F.struct(
            F.concat(f["path"], F.array(i)).alias("path"), below.alias("depth"), own.alias("artifact_id"), f["artifact_id"].alias("parent_artifact_id"), span.alias("parent_span"),
            c["codec"].alias("codec"), chain.alias("chain"), c["why"].alias("why"), c["n_bytes"].alias("n_bytes"), c["text"].alias("text"),
        )

    return F.flatten(F.transform(F.filter(above, lambda f: f["text"] != ""), inside))


KIND = f"struct<path:array<int>,depth:int,artifact_id:string,parent_artifact_id:string,parent_span:{SPAN},codec:string,chain:array<{STEP}>,why:struct<code:string,message:string>,n_bytes:int,text:string>"
ACCEPTED = "array<struct<i:int,path:array<int>,n_bytes:int>>"


def _refusal(x: Column, children: Column, used: Column, limits: DecodeLimits) -> Column:
    """Why a candidate is refused after so many children of so many bytes; null if it is accepted."""

    def say(code: str, message: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))

    return (
        F.when(x["why"].isNotNull(), x["why"])
        .when(F.size(x["path"]) > limits.max_depth, say("decode_limit", "nested too deeply"))
        .when(children >= limits.max_children, say("decode_limit", "too many children"))
        .when(used + x["n_bytes"] > limits.max_aggregate_bytes, say("decode_limit", "too many bytes in all children"))
        .when(x["text"].isNull(), say("decode_non_text", "decoded to no UTF-8 text"))
        .when(x["text"] == "", say("decode_invalid", "decoded to nothing"))
    )


def _orphan(x: Column, accepted: Column) -> Column:
    """Whether the text that holds a candidate was itself refused."""
    return (F.size(x["path"]) > 1) & ~F.exists(accepted, lambda a: a["path"] == F.slice(x["path"], F.lit(1), F.size(x["path"]) - 1))


def _accepted(steps: Column, limits: DecodeLimits) -> Column:
    """Which candidates become children: array of (place among ``steps``, path, bytes)."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("used"), F.array().cast(ACCEPTED).alias("accepted"))

    def spend(s: Column, x: Column) -> Column:
        good = ~_orphan(x, s["accepted"]) & _refusal(x, F.size(s["accepted"]), s["used"], limits).isNull()
        one = F.struct(s["i"].alias("i"), x["path"].alias("path"), x["n_bytes"].alias("n_bytes"))
        taken = F.struct((s["i"] + 1).alias("i"), (s["used"] + x["n_bytes"]).cast("bigint").alias("used"), F.concat(s["accepted"], F.array(one)).alias("accepted"))
        return F.when(x["why"].isNull() & good, taken).otherwise(F.struct((s["i"] + 1).alias("i"), s["used"].alias("used"), s["accepted"].alias("accepted")))

    return F.aggregate(steps, state, spend, lambda s: s["accepted"])


def _told(steps: Column, accepted: Column, limits: DecodeLimits) -> Column:
    """Every candidate that is looked at, with ``why`` it was refused."""

    def told(x: Column, i: Column) -> Column:
        def after(before: Column) -> Column:
            used = F.aggregate(before, F.lit(0).cast("bigint"), lambda s, a: s + a["n_bytes"])
            return x.withField("why", _refusal(x, F.size(before), used, limits))

        seen = F.when(x["why"].isNotNull(), x).otherwise(let(F.filter(accepted, lambda a: a["i"] < i), after))
        return F.when(~_orphan(x, accepted), seen)

    return F.filter(F.transform(steps, told), lambda x: x.isNotNull())


def expand(artifacts: DataFrame, limits: DecodeLimits = DecodeLimits(), sound: bool = False) -> DataFrame:
    """All outcomes of (artifact_id, text): one row each, ``ordinal`` in depth-first order, ``why`` null for children.

    ``root_id`` is the artifact searched.  A null text has no candidates.  Where artifacts have
    a ``decode_provenance``, that of their children goes on from it; the limits count from the
    artifact searched.  ``sound``: the accepted children only, which is much cheaper as most
    candidates are plain words; ``ordinal`` and ``path`` then count these alone.
    """
    none = F.lit(None)
    made = lambda name, kind: (F.col(f"decode_provenance.{name}") if "decode_provenance" in artifacts.columns else none).cast(kind)
    top = F.struct(
        F.array().cast("array<int>").alias("path"), F.coalesce(made("depth", "int"), F.lit(0)).alias("depth"), F.col("artifact_id"), made("parent_artifact_id", "string").alias("parent_artifact_id"),
        made("parent_span", SPAN).alias("parent_span"), made("codec", "string").alias("codec"), F.coalesce(made("chain", f"array<{STEP}>"), F.array().cast(f"array<{STEP}>")).alias("chain"),
        none.cast("struct<code:string,message:string>").alias("why"), none.cast("int").alias("n_bytes"), F.col("text"),
    )
    rows = artifacts.select(F.col("artifact_id").alias("root_id"), F.array(top).cast(f"array<{KIND}>").alias("_0"))
    levels = list(range(1, limits.max_depth + (1 if sound else 2)))
    for depth in levels:  # one below the limit is looked at only to say that the limit was met
        rows = rows.withColumn(f"_{depth}", _level(F.col(f"_{depth - 1}"), limits, sound).cast(f"array<{KIND}>"))
    steps = F.concat(*(f"_{depth}" for depth in levels)) if len(levels) > 1 else F.col("_1")
    rows = rows.select("root_id", (F.array_sort(steps) if len(levels) > 1 else steps).alias("steps"))  # by path: a parent comes before what it holds
    rows = rows.withColumn("accepted", _accepted(F.col("steps"), limits))
    every = F.transform("accepted", lambda a: F.element_at("steps", a["i"] + 1)) if sound else _told(F.col("steps"), F.col("accepted"), limits)
    return rows.select("root_id", F.posexplode(every).alias("ordinal", "o")).select("root_id", "ordinal", "o.*")


def decoded(artifacts: DataFrame, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """(root_id, start, end, codec, text) of every candidate of (artifact_id, text) that decodes to a text, one level deep.

    Each is held to the limits of one candidate; no budget of children or bytes is spent, so none is left out.
    """
    found = artifacts.select(F.col("artifact_id").alias("root_id"), F.explode(candidates(F.col("text"), limits, sound=True)).alias("c"))
    return found.select("root_id", "c.start", "c.end", "c.codec", "c.text")


def children(expanded: DataFrame) -> DataFrame:
    """The accepted virtual children as artifacts with their provenance."""
    provenance = F.struct("parent_artifact_id", "parent_span", "codec", "depth", "chain")
    return expanded.filter("why is null").select("root_id", "ordinal", "artifact_id", F.concat(F.lit("virtual://"), "artifact_id").alias("source_name"), "text", F.lit("virtual").alias("kind"), provenance.alias("decode_provenance"))


def diagnostics(expanded: DataFrame) -> DataFrame:
    return expanded.filter("why is not null").select("root_id", "ordinal", "why.code", F.lit("warning").alias("severity"), "why.message", F.col("parent_span").alias("span"))
