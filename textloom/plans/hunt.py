"""Hunting: rules over accepted readings, with places in the original input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import ids
from textloom.operators.graph import KEY, Facts
from textloom.plans.evaluate import evaluate
from textloom.plans.rules import Rule


def _farthest(spans: Column) -> Column:
    """Of an array of spans the farthest end in each text: (_of, _end)."""
    ends = F.sort_array(F.transform(spans, lambda x: F.struct(x["artifact_id"].alias("_of"), x["end"].alias("_end"))))
    last = lambda s: F.filter(s, lambda x, i: (i == F.size(s) - 1) | ~x["_of"].eqNullSafe(F.get(s, i + 1)["_of"]))
    return F.get(F.transform(F.array(ends), last), F.lit(0))


def _sizes(artifacts: DataFrame) -> DataFrame:
    """(_id, _length) of every artifact by packed id; -1 for a null text."""
    return artifacts.select(packed("artifact_id").alias("_id"), F.coalesce(F.length("text"), F.lit(-1)).alias("_length")).dropDuplicates(["_id"])


def unsupported(facts: Facts) -> DataFrame:
    """Keys of fragments with a piece of evidence that no artifact's text supports."""
    # Of each text that a fragment names only the farthest end goes to the texts; ids travel packed.
    if (whole := facts.known()) is not None:
        spans = [F.flatten(F.transform(k, lambda r: F.coalesce(r["evidence"], F.array().cast(schemas.EVIDENCE)))) for k in ("entities", "operations", "relationships")]
        every = whole.select(*KEY, F.explode(_farthest(F.concat(*spans))).alias("x")).select(*KEY, "x.*")
    else:
        every = reduce(DataFrame.union, [df.select(*KEY, F.explode("evidence").alias("span")) for df in (facts.entities, facts.operations, facts.relationships)])
        every = every.groupBy(*KEY, F.col("span.artifact_id").alias("_of")).agg(F.max("span.end").alias("_end"))
    every = every.select(packed("artifact_id").alias("_key"), "ordinal", packed("_of").alias("_of"), "_end")
    found = every.join(_sizes(facts.artifacts), F.col("_of") == F.col("_id"), "left")
    found = found.filter(F.col("_length").isNull() | (F.col("_length") < 0) | (F.col("_end") > F.col("_length"))).select("_key", "ordinal").distinct()
    return found.select(unpacked("_key").alias("artifact_id"), "ordinal")


def diagnostics(facts: Facts) -> DataFrame:
    return unsupported(facts).select("artifact_id", "ordinal", F.lit("invalid_canonical_evidence").alias("code"), F.lit("evidence that no text of the source supports").alias("message"))


def root_of(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, root): the span in the input that each decoded artifact comes from."""
    return _roots(artifacts).select(unpacked("_id").alias("artifact_id"), "root")


def _roots(artifacts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(_id, root) by packed id: the span in the input that each decoded artifact comes from, or each of ``wanted`` (_id).

    A provenance tells all steps from the input down, so nothing is climbed: the root is the
    first step from which all parents down to the artifact are known.  Only decoded artifacts'
    steps are joined, with the ids of all artifacts.
    """
    has = lambda name: name in artifacts.select("decode_provenance.*").columns
    if "decode_provenance" not in artifacts.columns:
        return artifacts.select(packed("artifact_id").alias("_id")).limit(0).withColumn("root", F.lit(None).cast(schemas.SPAN))
    made = F.col("decode_provenance")
    own = F.array(made["parent_span"])
    above = F.coalesce(F.transform(made["chain"], lambda s: s["parent_span"]), F.array().cast(schemas.EVIDENCE)) if has("chain") else F.array().cast(schemas.EVIDENCE)
    virtual = artifacts.filter(made.isNotNull()).select("artifact_id", F.concat(above, own).cast(schemas.EVIDENCE).alias("steps"))
    # Rows of one id are told apart by their steps, so that they need not meet before their steps are looked up.
    steps = virtual.select(packed("artifact_id").alias("_id"), F.xxhash64("steps").alias("_row"), F.posexplode("steps").alias("k", "span"))
    steps = steps.select("_id", "_row", "k", packed("span.artifact_id").alias("_parent"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))
    if wanted is not None:
        steps = steps.join(wanted, "_id", "left_semi")
    known = artifacts.select(packed("artifact_id").alias("_parent")).distinct().withColumn("known", F.lit(True))
    steps = steps.join(known, "_parent", "left")
    rows = steps.groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("_row", "k", F.coalesce("known", F.lit(False)).alias("known"), "_parent", "start", "end"))).alias("steps"))
    rows = rows.select("_id", F.filter("steps", lambda s: s["_row"] == F.get("steps", F.lit(0))["_row"]).alias("steps"))
    gap = F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: ~s["known"]), lambda s: s["k"])), F.lit(-1))
    root = F.get("steps", gap + 1)
    return rows.select("_id", root.alias("r")).filter("r is not null").select("_id", F.struct(unpacked("r._parent").alias("artifact_id"), "r.start", "r.end").alias("root"))


def packed(name: str) -> Column:
    """An artifact's id as bytes: 32 for a SHA-256 in hex, more for any other text, which thus stays apart from those."""
    c = F.col(name)
    return F.when(c.rlike("^[0-9a-f]{64}$") & (F.length(c) == 64), F.unhex(c)).otherwise(F.concat(c.cast("binary"), F.lit(bytes(33))))


def unpacked(name: str) -> Column:
    c = F.col(name)
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(c, F.lit(1), F.octet_length(c) - 33).cast("string"))


def root_spans(spans: DataFrame, artifacts: DataFrame, narrow: bool = False) -> DataFrame:
    """``spans`` (with a struct ``span``) with ``root``: the span in the input that it comes from, or itself.

    ``narrow`` for spans in few of the artifacts: the steps of these alone are looked up.
    """
    of = spans.withColumn("_of", packed("span.artifact_id"))
    up = _roots(artifacts, of.select(F.col("_of").alias("_id")).distinct() if narrow else None).withColumnRenamed("root", "_root")
    out = of.join(up, F.col("_of") == F.col("_id"), "left")
    return out.withColumn("root", F.coalesce("_root", "span")).drop("_of", "_id", "_root")


def _among(ids: DataFrame) -> Column:
    """Whether a packed ``_id`` may be among ``ids`` (_id): by its bit of 32,768, so true of every one that is."""
    bit = F.col("_id").cast("binary")
    place = F.pmod(F.xxhash64(bit), F.lit(1 << 15)) + 1
    bits = ids.select(F.bitmap_bit_position(place).alias("bit")).agg(F.bitmap_construct_agg("bit").alias("bits")).scalar()
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def hints(spans: DataFrame, artifacts: DataFrame, by: list[str]) -> DataFrame:
    """For each ``by`` the sorted distinct places (source name, artifact, start, end, line, column) of its spans.

    Places are found once for each text: only the starts go to the texts, and only places come back.
    Decoded texts are the most of all texts and hardly ever where a span comes from, so of these
    only those travel that may be.
    """
    at = root_spans(spans, artifacts, narrow=True).select(*by, "root").distinct()
    starts = at.groupBy(packed("root.artifact_id").alias("_id")).agg(F.collect_set("root.start").alias("_starts"))
    texts = artifacts.withColumn("_id", packed("artifact_id"))
    if "decode_provenance" in artifacts.columns:
        made = F.col("decode_provenance").isNotNull()
        columns = [F.col(c) for c in ("_id", "source_name", "text")]
        physical, decoded = texts.filter(~made), texts.filter(made)
        named = at.select(packed("root.artifact_id").alias("_id")).join(physical.select("_id"), "_id", "left_anti")
        texts = physical.select(*columns).union(decoded.filter(_among(named)).select(*columns))
    texts = texts.select("_id", "source_name", "text").dropDuplicates(["_id"]).join(starts, "_id")
    place = F.transform("_starts", lambda s: F.struct(s.alias("start"), ids.line_of(F.col("text"), s).alias("line"), ids.column_of(F.col("text"), s).alias("column")))
    places = texts.select("_id", "source_name", F.explode(place).alias("_p"))
    at = at.join(places, [packed("root.artifact_id") == F.col("_id"), F.col("root.start") == F.col("_p.start")])
    hint = F.struct("source_name", F.col("root.artifact_id").alias("artifact_id"), F.col("root.start").alias("start"), F.col("root.end").alias("end"), F.col("_p.line").alias("line"), F.col("_p.column").alias("column"))
    return at.select(*by, hint.alias("hint")).groupBy(*by).agg(F.array_sort(F.collect_set("hint")).alias("hints"))


def hunt(rule: Rule, facts: Facts, accepted: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row for each accepted fragment (key) whose evidence its sources support: status and hints.

    ``rounds`` once bounded the climb to the input; a provenance tells all steps, so it bounds nothing now.
    """
    usable = accepted.select(*KEY).join(unsupported(facts), KEY, "left_anti")
    result = evaluate(rule, facts, usable)
    spans = result.filter("status = 'HIT'").select(*KEY, F.explode("evidence").alias("r")).select(*KEY, F.explode("r.spans").alias("span"))
    places = hints(spans, facts.artifacts, KEY)
    none = F.array().cast("array<struct<source_name:string,artifact_id:string,start:int,end:int,line:int,column:int>>")
    return result.join(places, KEY, "left").withColumn("hints", F.coalesce("hints", none))


def hunt_all(rules: list[Rule], facts: Facts, accepted: DataFrame) -> DataFrame:
    """The results of several rules, one below the other; the facts are written once for all of them."""
    settled = facts.settled()
    return reduce(DataFrame.unionByName, [hunt(r, settled, accepted) for r in rules])
