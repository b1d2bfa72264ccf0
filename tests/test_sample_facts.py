"""The sample facts are dealt out once, by their fragment, and nothing that grows is written between steps."""

import re

import pytest

from textloom import queries_facts
from textloom.operators import canonical, graph
from textloom.plans.sample_facts import order_facts

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _dealt(df) -> list[str]:
    """What rows are dealt out by, without the tables' own rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan) if "order:" not in x and "custkey" not in x]


@pytest.mark.parametrize("name", ["trust_boundary", "distance_k", "first_path", "derivation_path", "evidence_union", "dangling_refs"])
def test_facts_are_dealt_out_once(shuffled, name):
    assert _dealt(queries_facts.QUERIES[name](shuffled, SF)) == []


def test_nothing_is_written_for_facts_and_walks(shuffled, monkeypatch):
    def written(df):
        raise AssertionError("written")

    monkeypatch.setattr("textloom.plans.evaluate.materialized", written)
    monkeypatch.setattr("textloom.operators.graph.materialized", written)
    for name in ("all_paths", "path_exists", "rule_first_match"):
        queries_facts.QUERIES[name](shuffled, SF)


def test_lines_of_one_number_and_orders_without_lines(spark, tmp_path):
    for name in ("nation", "region", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders, lines = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("orders", "lineitem"))
    key = orders.join(lines, orders.o_orderkey == lines.l_orderkey).agg({"o_orderkey": "min"}).first()[0]
    orders = orders.filter(f"o_orderkey = {key}")
    orders.union(orders.withColumn("o_orderkey", -1 - orders.o_orderkey)).write.parquet(f"{tmp_path}/orders.parquet")
    lines = lines.filter(f"l_orderkey = {key}")
    lines.union(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    facts = order_facts(spark, str(tmp_path))
    assert facts.operations.count() == lines.select("l_linenumber").distinct().count()
    assert facts.entities.filter("id = 'order'").count() == 2
    sources = facts.entities.select(*graph.KEY, "id").withColumnRenamed("id", "source")
    assert graph.reachable(graph.edges_of(facts.relationships), sources).filter("source = 'order' and target = 'region'").count() == 2


def test_one_row_for_each_text_of_a_fragment_goes_to_the_texts(shuffled):
    """The rows dealt out by the text that evidence names are sums of the fragment's own rows."""
    plan = queries_facts.hunt_unsupported(shuffled, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(_of#") :].split("\n")[1]
    assert "HashAggregate" in below or "Filter" in below, below


@pytest.mark.parametrize("name", ["path_exists", "all_paths"])
def test_walks_are_counted_where_they_are_walked(shuffled, name):
    assert _dealt(queries_facts.QUERIES[name](shuffled, SF)) == []


def test_counts_equal_the_listed_paths(spark):
    edges = [("k", 0, a, b, f"{a}{b}{n}") for a, b, n in (("a", "b", 0), ("a", "b", 1), ("b", "c", 0), ("c", "a", 0), ("a", "c", 0), ("c", "d", 0))]
    edges = spark.createDataFrame(edges, "artifact_id string, ordinal int, source string, target string, edge string")
    pairs = spark.createDataFrame([("k", 0, *p) for p in (("a", "d"), ("b", "a"), ("d", "a"), ("a", "a"), ("x", "d"), (None, "d"))], "artifact_id string, ordinal int, source string, sink string")
    for depth in (None, 2):
        listed = {}
        for r in graph.paths(edges, pairs, depth).collect():
            n, longest = listed.get((r.source, r.sink), (0, 0))
            listed[r.source, r.sink] = n + 1, max(longest, len(r.edges))
        assert listed == {(r.source, r.sink): (r.n, r.longest) for r in graph.path_counts(edges, pairs, depth).collect()}
    sources = pairs.select(*graph.KEY, "source").filter("source is not null").distinct()
    reached = graph.reachable(edges, sources).groupBy("source").count().collect()
    assert {(r.source, r["count"]) for r in reached} == {(r.source, r.n) for r in graph.reach_counts(edges, sources).collect()}


def test_evidence_is_united_without_comparing_every_two(spark):
    rows = [[[("b", 1, 2), ("a", 5, 6)], [("a", 5, 6), None], [("a", 0, 9), ("a", 0, 3), None]], [[]], None]
    df = spark.createDataFrame([(r,) for r in rows], "e array<array<struct<artifact_id:string,start:int,end:int>>>")
    got = [None if r.u is None else [x and tuple(x) for x in r.u] for r in df.select(canonical.union_of(df.e).alias("u")).collect()]
    assert got == [[("a", 0, 3), ("a", 0, 9), ("a", 5, 6), ("b", 1, 2), None], [], None]
    assert "array_distinct" not in df.select(canonical.union_of(df.e))._jdf.queryExecution().toString()


def test_orders_are_dealt_out_once_for_a_path(spark):
    """Plans that read the fragments for nodes and for edges share their exchanges, whatever filters joins add."""
    found = []

    def walk(plan):
        if plan.nodeName() == "Exchange" and "o_custkey" in plan.schema().simpleString() and "r_name" in plan.schema().simpleString():
            found.append(plan)
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(queries_facts.first_path(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().initialPlan())
    assert len(found) > 1 and all(found[0].sameResult(other) for other in found[1:])


def _nodes(plan, name):
    children = plan.children()
    return (name in plan.nodeName()) + sum(_nodes(children.apply(i), name) for i in range(children.size()))


@pytest.mark.parametrize("name,sorts", [("rule_first_match", 4), ("any_selector", 4), ("uses_decodes_to", 4), ("rule_paths", 4), ("rule_sequence", 4), ("decoded_from", 6)])
def test_a_rule_sorts_no_facts(shuffled, name, sorts):
    """The tables' rows meet as whole fragments; a rule adds no join of facts, so no sorter that could spill (a join sorts two inputs)."""
    plan = queries_facts.QUERIES[name](shuffled, SF)._jdf.queryExecution().executedPlan().initialPlan()
    assert _nodes(plan, "ArrowEvalPython") == 1
    joins = _nodes(plan, "SortMergeJoin")
    assert joins <= sorts // 2, joins


def test_whole_fragments_hold_the_tables_records(spark):
    facts = order_facts(spark, SF)
    for table in ("entities", "operations", "relationships"):
        rows = getattr(facts, table)
        listed = facts.fragments().selectExpr(*graph.KEY, f"inline({table})").select(rows.columns)
        assert listed.schema.simpleString() == rows.schema.simpleString()
        assert listed.exceptAll(rows).isEmpty() and rows.exceptAll(listed).isEmpty()
    assert facts.fragments().count() == facts.keys().count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_replaced_tables_are_gathered_anew(spark):
    from dataclasses import replace

    facts = order_facts(spark, SF)
    fewer = replace(facts, relationships=facts.relationships.filter("relation = 'SENT_TO'"))
    assert {r.relation for r in fewer.fragments().selectExpr("inline(relationships)").select("relation").distinct().collect()} == {"SENT_TO"}


def test_roots_are_looked_up_by_packed_ids(shuffled):
    spark = shuffled
    from textloom import schemas
    from textloom.plans import hunt

    sha, mixed, odd = "0a" * 32, "0A" * 32, "\0" * 32  # only the first is a packed SHA-256
    kind = f"artifact_id string, decode_provenance struct<parent_artifact_id:string,parent_span:{schemas.SPAN}>"
    made = lambda parent, start: (parent, (parent, start, start + 1))
    rows = [("root", None), (sha, made("root", 3)), (mixed, made("root", 5)), (odd, made(sha, 7)), ("", made("lost", 1)), (sha, made("root", 3))]
    got = {r.artifact_id: (r.root.artifact_id, r.root.start) for r in hunt.root_of(spark.createDataFrame(rows, kind)).collect()}
    assert got == {sha: ("root", 3), mixed: ("root", 5), odd: (sha, 7)}
    twice = spark.createDataFrame([("root", None), ("x", made("root", 1)), ("x", made("root", 2))], kind)
    assert [r.root.start in (1, 2) for r in hunt.root_of(twice).collect()] == [True]
    plan = hunt.root_of(spark.createDataFrame(rows, kind))._jdf.queryExecution().executedPlan().initialPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 3, plan  # steps and ids by the parent, steps by the artifact


@pytest.mark.parametrize("name", ["canon_operations", "canon_relationships"])
def test_ids_are_replaced_in_one_join(shuffled, name):
    """A fragment's ids go to its rows as a map, for all columns at once."""
    plan = queries_facts.QUERIES[name](shuffled, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_book" in plan and "_new" not in plan
