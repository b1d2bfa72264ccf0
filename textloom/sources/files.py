"""Text sources as tables of artifacts."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ids, vocab


def artifacts_of(df: DataFrame, name: Column, text: Column) -> DataFrame:
    """Any table with a text column as artifacts; the id is the digest of the text, so equal texts share it."""
    body = F.coalesce(text, F.lit(""))
    return df.select(ids.content_id(body).alias("artifact_id"), name.alias("source_name"), body.alias("text"), F.lit("physical").alias("kind"))


def _either(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in suffix)


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """A file, or all files below ``folder``: path, artifact_id and text of good ones, code of the others.

    Files are read as bytes, so texts keep their line ends and marks.  Contents are read of
    files with a good name and length only; the length is tested before the content is read.
    Links, and things that are no regular files, are known only where the folder is on the
    driver's own disk.  Rows have no order.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    names = every.load(folder).select("path", "length")
    known = _known(spark, folder)
    if known is not None:
        names = names.withColumn("_place", F.regexp_replace("path", "^file:/*", "/")).join(known, "_place", "full_outer")
        names = names.select(F.coalesce("path", F.concat(F.lit("file:"), "_place")).alias("path"), "length", "_code")
    else:
        names = names.withColumn("_code", F.lit(None).cast("string"))
    code = (
        F.when(F.col("_code").isin("skipped_symlink", "invalid_target"), F.col("_code"))
        .when(~suffix.isin(*vocab.SOURCE_SUFFIXES), "unsupported_suffix")
        .when(F.col("_code").isNotNull(), F.col("_code"))
        .when(F.col("length") > vocab.MAX_SOURCE_BYTES, "oversized_file")
    )
    names = names.select("path", code.alias("_why"))
    glob = "*.{" + ",".join(map(_either, vocab.SOURCE_SUFFIXES)) + "}"
    bodies = every.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").load(folder).filter(F.col("length") <= vocab.MAX_SOURCE_BYTES).select("path", "content")
    text = F.col("content").cast("string")
    out = names.join(bodies, "path", "left")
    code = F.coalesce("_why", F.when(F.col("content").isNull(), "unreadable_file").when(~F.is_valid_utf8(text), "invalid_utf8"))
    good = code.isNull()
    return out.select("path", F.when(good, ids.content_id(text)).alias("artifact_id"), F.when(good, text).alias("text"), code.alias("code"))


def _known(spark: SparkSession, folder: str) -> DataFrame | None:
    """(_place, _code) of what is no readable regular file below a folder of the driver's own disk."""
    root = Path(folder.removeprefix("file://"))
    if "://" in folder.removeprefix("file://") or not root.exists():
        return None
    places = [root] if not root.is_dir() or root.is_symlink() else [Path(d) / f for d, inside, names in os.walk(root) for f in (*names, *(x for x in inside if os.path.islink(os.path.join(d, x))))]
    rows = []
    for p in places:
        code = "skipped_symlink" if p.is_symlink() else "invalid_target" if not p.is_file() else None if os.access(p, os.R_OK) else "unreadable_file"
        if code:
            rows.append((str(p.absolute()), code))
    return spark.createDataFrame(rows, "_place string, _code string")


def accepted(scanned: DataFrame) -> DataFrame:
    return scanned.filter("code is null").select("artifact_id", F.col("path").alias("source_name"), "text", F.lit("physical").alias("kind"))


def diagnostics(scanned: DataFrame) -> DataFrame:
    return scanned.filter("code is not null").select("path", "code")
