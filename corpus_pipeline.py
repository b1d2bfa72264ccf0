"""The corpus pipeline: toxicity, quality, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  It works on all rows
that the stage before it kept; each but the last returns the columns of ``documents``.
The two classifiers learn from the labelled rows of ``documents`` in ``sf_dir``, not from
``docs``, so that what they know does not depend on what was filtered before.  Null and
empty texts pass the filters as they score, are masked to themselves, and are packed as
one end mark; rows without a doc_id pass the filters and the near-duplicate stage.  Empty
tables give empty tables, and further columns are carried along, whatever their names.

The near-duplicate stage is operator 10 for a similarity of 0.8 of five-word shingles, which
fingerprints of 64 bits reach in part; README says what proposes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import packing, pii, quality, shingles, toxicity
from textloom.llm.common import cut, small_batches, table
from textloom.llm.queries import WORD_VOCABULARY


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def without_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return shingles.one_of_each(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed(docs, WORD_VOCABULARY)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", without_junk),
    ("near_duplicates", one_of_each),
    ("pii", masked),
    ("packing", packed),
]

# A trained classifier has no counterpart in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
