"""Readings: where the facts of an artifact come from.

A lifter is any function from artifacts to attempts (artifact_id, ordinal, outcome,
payload).  ``catalog`` replays stored ones; ``from_function`` runs a Python callable, such as a
client of a language model, in Arrow batches on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vocab
from textloom.shipping import ship

ATTEMPTS = "artifact_id string, ordinal int, outcome string, payload string"


class CatalogError(ValueError):
    pass


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Attempts of a JSON catalog: {"version", "fixtures": {artifact_id: [{"outcome", "payload"}, ...]}}."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise CatalogError("a key occurs twice")
        return out

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        spec = json.loads(text, object_pairs_hook=unique)
    except json.JSONDecodeError as e:
        raise CatalogError("the catalog is not JSON") from e
    if not isinstance(spec, dict) or set(spec) != {"version", "fixtures"} or not spec["fixtures"]:
        raise CatalogError("a catalog has a version and fixtures")
    rows = []
    for artifact, attempts in spec["fixtures"].items():
        if not attempts:
            raise CatalogError("every artifact has an attempt")
        for k, a in enumerate(attempts):
            payload = a.get("payload")
            if a.get("outcome") not in vocab.OUTCOMES or (payload is not None) != (a["outcome"] == "fragment"):
                raise CatalogError("an attempt has a known outcome, and a payload if and only if it is a fragment")
            rows.append((artifact, k, a["outcome"], payload if payload is None or isinstance(payload, str) else json.dumps(payload)))
    return spark.createDataFrame(rows, ATTEMPTS)


def catalog(artifacts: DataFrame, attempts: DataFrame) -> DataFrame:
    """The stored attempts of each artifact; an artifact without any gets one refusal."""
    out = artifacts.select("artifact_id").distinct().join(attempts, "artifact_id", "left")
    return out.select("artifact_id", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.coalesce("outcome", F.lit("unsupported")).alias("outcome"), "payload")


def from_function(artifacts: DataFrame, lift: Callable[[str, str], Iterable[tuple[str, str | None]]]) -> DataFrame:
    """Attempts that ``lift`` (artifact_id, text) gives: (outcome, payload) each.  A failure is one incomplete attempt."""
    schema = pa.schema([("artifact_id", pa.string()), ("ordinal", pa.int32()), ("outcome", pa.string()), ("payload", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = list(lift(key, text or ""))
                except Exception:  # a model's failure is data, not the job's
                    found = [("incomplete", None)]
                rows += [(key, k, outcome, payload) for k, (outcome, payload) in enumerate(found)]
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ship(artifacts.sparkSession)
    return artifacts.select("artifact_id", "text").mapInArrow(run, ATTEMPTS)
