"""Several rules read each fragment once; hunting moves only the decoded texts that spans may come from."""

import re

from pyspark.sql import functions as F
from textloom import queries_facts
from textloom.plans import hunt

SF = "/root/testdata/sf0.001"


def test_rules_of_one_query_share_one_pass(spark):
    plan = queries_facts.uses_role(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1


def test_bits_let_every_named_id_through_and_few_others(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("artifact_id"), "id").withColumn("_id", hunt.packed("artifact_id"))
    found = {r.id for r in rows.filter(hunt._among(rows.filter("id % 1000 = 7").select("_id"))).select("id").collect()}
    assert {7, 1007, 2007, 3007, 4007} <= found and len(found) < 100
    assert rows.filter(hunt._among(rows.filter("id < 0").select("_id"))).count() == 0
