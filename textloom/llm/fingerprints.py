"""Document fingerprints: one-permutation MinHash, by DataFrame functions only.

The five-word shingles of a text are hashed once.  The top bits of a hash name its bin,
and each bin keeps its smallest hash.  A text with few shingles leaves bins empty; each
empty bin borrows from a bin chosen by a hash of (bin, attempt) until it meets a full one
(optimal densification), after some attempts from the full bin of smallest such hash, which
is the same rule without the repetitions.  Only the lowest ``bits`` of each value are kept.  Two
fingerprints' likeness is the share of equal values, corrected for those that are equal
by chance.

All of it is array functions within a row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_LOG, BITS, WORDS = 7, 8, 5
BINS = 1 << BINS_LOG
ATTEMPTS = 12


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BINS_LOG).cast("int")


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """``df`` with the array ``name``: BINS values of BITS bits each; empty for texts without words.

    Words are lower-cased and parted by white space; a text of fewer words is one shingle.  A null text counts as empty.
    """
    a, b, c, d = (f"_{name}{k}" for k in range(4))
    split = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "")
    out = df.withColumn(a, F.transform(split, lambda w: F.xxhash64(w)))
    n, got = F.size(a), lambda i, k: F.get(F.col(a), i + k)
    shingles = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(got(i, k) for k in range(words))))
    none = F.array().cast("array<bigint>")
    out = out.withColumn(b, F.sort_array(F.when(n >= words, shingles).when(n > 0, F.array(F.xxhash64(a))).otherwise(none)))
    out = out.withColumn(c, F.filter(b, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(b), i - 1)))))
    full = F.map_from_arrays(F.transform(c, _bin), F.col(c))
    out = out.withColumn(d, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: full[i]))

    def filled(v: Column, i: Column) -> Column:
        tries = [F.get(F.col(d), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ATTEMPTS)]
        last = F.array_min(F.transform(c, lambda x: F.struct(F.xxhash64(i, _bin(x), F.lit("last")).alias("h"), x.alias("x"))))["x"]
        return F.coalesce(v, *tries, last).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    small = F.when(F.size(c) > 0, F.transform(d, filled)).otherwise(F.array().cast("array<int>"))
    return out.withColumn(name, small).drop(a, b, c, d)


def packed(values: Column) -> Column:
    """The values as lowercase hex, two digits each; empty for texts without words."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def likeness(one: Column, two: Column) -> Column:
    """Estimated share of common shingles, 0 to 1; two texts without words are alike, one is like nothing else."""
    same = F.aggregate(F.zip_with(one, two, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    share = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), F.when(F.size(one) == F.size(two), 1.0).otherwise(0.0)).otherwise(share)


def with_next(df: DataFrame, key: str, then: str, columns: list[str], parts: int) -> DataFrame:
    """``df`` with the struct ``_next`` of ``columns`` of the next row by (key, ``then``); the last row's is the first.

    Rows go to ``parts`` ranges of the key.  A range starts at a key that occurs, and rows
    with that key go to the range before too, as its end: so each range is worked on alone.
    Only the ranges' first keys reach the driver.  Null keys come first.
    """
    low = -(1 << 63)
    place = F.coalesce(F.col(key), F.expr("-9223372036854775807L - 1"))
    cuts = [k / parts for k in range(1, parts)]
    found = df.select(place.alias("o")).agg(F.min("o").alias("low"), F.percentile_approx("o", cuts or [0.5], max(10_000, 10 * parts)).alias("cuts")).first()
    first = sorted({found.low if found.low is not None else low, *(found.cuts or [])}) if cuts else [found.low if found.low is not None else low]
    o = F.col("_o")

    def rank(first: list[int]) -> Column:
        bounds = F.from_json(F.lit(json.dumps(first)), "array<bigint>")
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(first).bit_length()))))
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(first)) & (F.get(bounds, at + s - 1) <= o), at + s).otherwise(at))

    if len(first) > 1:  # the quantiles of large keys are rounded: each range starts at the first key that it has
        real = df.select(place.alias("_o")).groupBy(rank(first).alias("_range")).agg(F.min("_o").alias("o")).collect()
        first = sorted(r.o for r in real)
    bounds = F.from_json(F.lit(json.dumps(first)), "array<bigint>")
    rows = df.withColumn("_o", place).withColumn("_range", rank(first) - 1)
    before = F.pmod(F.col("_range") - 1, F.lit(len(first)))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))
    end = F.struct(before.alias("r"), F.lit(1).alias("copy"))
    rows = rows.withColumn("_at", F.explode(F.when(F.get(bounds, F.col("_range")) == o, F.array(own, end)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.r").orderBy("_at.copy", "_o", then)
    return rows.withColumn("_next", F.lead(F.struct(*columns)).over(order)).filter("_at.copy = 0").drop("_o", "_range", "_at")


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    A null text counts as empty.  Repeated rows stay; equal keys are ordered by their text,
    null keys come first, so all rows of one key are ordered in one task: keys are meant to
    be unique.  An empty table gives an empty one, other columns are not read.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = with_next(with_fingerprint(rows, "_text", "_own"), key, "_text", ["_text", "_own"], parts)
    n = F.length("_text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_quarter", F.floor(n / 4).cast("int"))
    edited = F.concat(F.substring("_text", F.lit(1), n - F.col("_quarter")), F.substring("_next._text", F.lit(1), F.col("_quarter")))
    rows = rows.withColumn("_edited", edited)
    rows = with_fingerprint(rows, "_edited", "_changed")
    return rows.select(
        key,
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("_own")).alias("fingerprint"),
        packed(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next._own")).alias("near_next"),
    )
