"""Promotion of annotations to entities that need no model: destinations, files, variables.

In-row like the annotators.
"""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import ids, vocab
from textloom.functions import patterns as P
from textloom.operators.annotate import annotations
from textloom.operators.spans import let, running

ENTITY = (
    "struct<id:string,type:string,subtype:string,value:string,sensitivity:string,trust:string,"
    "evidence:array<struct<artifact_id:string,start:int,end:int>>,confidence:double,underspecified:boolean>"
)


def supported_domain(value: Column) -> Column:
    return F.lower(F.substring_index(value, ".", -1)).isin(*vocab.DOMAIN_SUFFIXES)


def host_of(value: Column) -> Column:
    """Host of a url, or the value itself; lower case, without trailing dots or brackets."""
    netloc = F.substring_index(F.regexp_extract(value, "://([^/?#]*)", 1), "@", -1)
    name = F.when(netloc.startswith("["), F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(netloc, ":", 1))
    return F.lower(F.rtrim(F.when(value.contains("://"), name).otherwise(value), F.lit(".")))


def _local_four(host: Column) -> Column:
    """Whether a host is an IPv4 address in a local network; false for malformed ones."""
    octet = "(?:0|[1-9][0-9]{0,2})"
    shape = host.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    parts = [F.get(F.split(host, r"\."), F.lit(k)).cast("long") for k in range(4)]
    number = reduce(lambda n, p: n * 256 + p, parts)
    nets = [ip_network(n) for n in vocab.LOCAL_NETWORKS if "." in n]
    inside = reduce(Column.__or__, [number.between(int(n.network_address), int(n.broadcast_address)) for n in nets])
    return F.when(shape, F.when(reduce(Column.__and__, [p <= 255 for p in parts]), inside).otherwise(False)).otherwise(False)


def _local_six(host: Column) -> Column:
    """Whether a host is an IPv6 address, in groups of hexadecimal digits, in a local network."""
    sides = F.split(host, "::", -1)
    groups = lambda k: F.filter(F.split(F.coalesce(F.get(sides, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    left, right = groups(0), groups(1)
    n = F.size(left) + F.size(right)
    shape = host.rlike("^[0-9a-f:]+$") & ~host.rlike(":::|^:[^:]|[^:]:$") & F.forall(F.concat(left, right), lambda g: F.length(g) <= 4)
    whole = shape & F.when(F.size(sides) == 1, n == 8).otherwise((F.size(sides) == 2) & (n <= 7))
    full = F.concat(left, F.array_repeat(F.lit("0"), 8 - n), right)
    top = F.conv(F.get(full, F.lit(0)), 16, 10).cast("long")
    tests = []
    for net in (ip_network(x) for x in vocab.LOCAL_NETWORKS if ":" in x):
        if net.prefixlen <= 16:
            low, high = (int(a) >> 112 for a in (net.network_address, net.broadcast_address))
            tests.append(top.between(low, high))
        else:  # a single address
            last = int(net.network_address)
            tests.append(F.forall(F.slice(full, 1, 7), lambda g: g.rlike("^0+$")) & (F.conv(F.get(full, F.lit(7)), 16, 10).cast("long") == last))
    return F.when(whole, reduce(Column.__or__, tests)).otherwise(False)


def local_destination(value: Column) -> Column:
    """Whether a destination is a localhost name or a well-formed address in a local network."""
    host = host_of(value)
    return (host == "localhost") | host.endswith(".localhost") | _local_four(host) | F.when(host.contains(":"), _local_six(host)).otherwise(False)


def clear_file_reference(text: Column, start: Column, end: Column) -> Column:
    """Whether a file name is called for: by a verb or label before it on its line, or by backticks around it."""
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    after = F.substring(text, end + 1, F.length(text))
    return before.rlike(P.FILE_ACTION_BEFORE) | before.rlike(P.FILE_LABEL_BEFORE) | (before.contains("`") & after.contains("`"))


WIDE = ("url", "explicit_file_reference")


def covered(found: Column) -> Column:
    """(it, inside) for each annotation of a text: whether a url or file reference holds its whole span.

    By start, wide ones first: then a span lies inside one of those before it exactly if the
    furthest of their ends is not before its own end.  That is a running maximum, whatever
    the number of either kind.
    """
    order = F.transform(found, lambda a: F.struct(a["start"].alias("start"), (~a["kind"].isin(*WIDE)).alias("narrow"), a["end"].alias("end"), a.alias("it")))

    def marked(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda r: F.when(r["narrow"], 0).otherwise(r["end"])), F.greatest)
        return F.zip_with(rows, F.slice(reach, F.lit(1), F.size(rows)), lambda r, e: F.struct(r["it"].alias("it"), (r["narrow"] & (e >= r["end"])).alias("inside")))

    return let(F.array_sort(order), marked)


def static_entities(text: Column, artifact_id: Column, suppress: bool = True) -> Column:
    """Array of entities shown on the surface of ``text``, by place."""
    whole = F.coalesce(text, F.lit(""))
    found = annotations(whole, tuple(vocab.PROMOTED))

    def over(found: Column) -> Column:
        def wanted(m: Column) -> Column:
            a = m["it"]
            domain = (a["kind"] != "domain") | (supported_domain(a["value"]) & (~m["inside"] if suppress else F.lit(True)))
            return domain & ((a["kind"] != "explicit_file_reference") | clear_file_reference(whole, a["start"], a["end"]))

        def entity(m: Column) -> Column:
            a = m["it"]
            value = F.when(a["kind"] == "environment_variable", F.get(a["normalized_values"], F.lit(0))).when(a["kind"] == "url", F.rtrim(a["value"], F.lit(".,;!?"))).otherwise(a["value"])
            kind = F.element_at(F.create_map(*(F.lit(x) for pair in vocab.PROMOTED.items() for x in pair)), a["kind"])
            trust = F.when(kind == "NETWORK_DESTINATION", F.when(local_destination(value), "UNKNOWN").otherwise("EXTERNAL")).otherwise("UNKNOWN")
            return F.struct(kind.alias("type"), value.alias("value"), a["start"].alias("start"), a["end"].alias("end"), trust.alias("trust"))

        entities = F.array_distinct(F.transform(F.filter(covered(found), wanted), entity))
        return F.filter(entities, lambda e: (F.length(e["value"]).between(1, 256)) & ~e["value"].rlike(f"[{P.WS}]"))

    def full(e: Column) -> Column:
        return F.struct(
            ids.static_entity_id(e["type"], e["value"], e["start"], e["end"]).alias("id"),
            e["type"].alias("type"),
            F.lit(None).cast("string").alias("subtype"),
            e["value"].alias("value"),
            F.lit("UNKNOWN").alias("sensitivity"),
            e["trust"].alias("trust"),
            F.array(F.struct(artifact_id.alias("artifact_id"), e["start"].alias("start"), e["end"].alias("end"))).alias("evidence"),
            F.lit(1.0).alias("confidence"),
            F.lit(False).alias("underspecified"),
        )

    return F.transform(over(found), full)


def entities(artifacts: DataFrame) -> DataFrame:
    """One row for each static entity of (artifact_id, text)."""
    found = artifacts.select("artifact_id", F.explode(static_entities(F.col("text"), F.col("artifact_id"))).alias("e"))
    return found.select("artifact_id", "e.*")
