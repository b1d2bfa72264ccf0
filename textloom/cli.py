"""Commands: ``scan PATH``, ``rules DIR``, ``lift PATH``, ``benchmark MANIFEST``.

A command that fails prints ``error [code] path: message`` and ends with status 2.  Only what
is printed is collected.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans import evaluate, reports
from textloom.plans.rules import Rule, RuleError, read_rule, read_rule_dir
from textloom.session import InputError, Session, scan_tables
from textloom.sources import corpus, model


def _rows(df: DataFrame, *order: str) -> list:
    return [json.loads(r.j) for r in (df.orderBy(*order) if order else df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]


def scan(spark: SparkSession, path: str) -> dict:
    """The report of one file or folder: artifacts, annotations, children and diagnostics, all sorted."""
    found = scan_tables(spark, path)
    return {
        "annotations": _rows(found["annotations"].drop("value"), "artifact_id", "start", "end", "kind"),
        "artifacts": _rows(found["artifacts"].select("artifact_id").distinct(), "artifact_id"),
        "decode_diagnostics": _rows(found["decode_diagnostics"], "root_id", "ordinal"),
        "diagnostics": _rows(found["diagnostics"], "path"),
        "occurrences": _rows(found["artifacts"].select("source_name", "artifact_id"), "source_name"),
        "virtual_children": _rows(found["virtual_children"].drop("text"), "root_id", "ordinal"),
    }


def lift(spark: SparkSession, path: str, config: str, show: bool = False, rule: Rule | None = None, post: model.Post = model.send) -> dict:
    """Attempts with their states and codes; with ``show`` the accepted facts, with ``rule`` its results."""
    with Session.from_live_config(spark, config, post) as session:
        lifted = session.lift_file(path)
        found = _rows(reports.lift_report(lifted.attempts, lifted.diagnostics, lifted.artifacts), "artifact_id")
        out = {"artifacts": found}
        if show:
            out["ir"] = [x | {"fragment": json.loads(x["fragment"])} for x in _rows(reports.reading_report(lifted.facts(), lifted.accepted()), "artifact_id", "ordinal")]
        if rule is not None:
            out["rule_test"] = _rows(reports.rule_test(session.run_rule(rule, lifted)), "artifact_id", "ordinal")
        return out


def benchmark(spark: SparkSession, manifest: str, rule_list: list[Rule], config: str, family: str | None = None, post: model.Post = model.send) -> dict:
    """Every case of a corpus lifted and hunted with every rule, by family."""
    cases = corpus.read_manifest(spark, manifest)
    if family is not None:
        cases = cases.filter(F.col("family") == family)
        if cases.isEmpty():
            raise InputError("unknown_family", f"no case is of the family {family!r}")
    loaded = corpus.load(spark, cases, str(Path(manifest).parent / "fixtures"))
    with Session.from_live_config(spark, config, post) as session:
        lifted = session.lift(loaded.select("artifact_id", F.col("fixture_path").alias("source_name"), "text"))
        results = evaluate.evaluate_all(rule_list, lifted.facts(), lifted.accepted())
        hits = reports.case_hits(reports.by_root(results, lifted.artifacts), loaded)
        families = reports.family_report(hits)
        bad = reports.incomplete(lifted.attempts, lifted.artifacts).withColumnRenamed("root_id", "artifact_id")
        return {
            "cases": _rows(hits.join(loaded.select("case_id", "artifact_id", "modality"), "case_id").join(bad, "artifact_id", "left").drop("artifact_id"), "case_id"),
            "families": _rows(families, "family"),
            "summary": _rows(reports.summary(families))[0],
        }


def _print(report: dict) -> None:
    print(json.dumps(report, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _check_rules(path: str) -> int:
    bad = 0
    for p in sorted(Path(path).glob("*.yaml")):
        try:
            print(read_rule(p).id)
        except RuleError as e:
            bad += 1
            print(f"error {e}", file=sys.stderr)
    return 2 if bad else 0


def _lift_command(args, spark) -> int:
    if args.check:
        if args.path:
            raise InputError("check_has_source", "a check takes no source")
        if args.show or args.test_rule:
            raise InputError("check_has_lift_options", "a check shows no facts and tests no rule")
        found = model.check_capability(model.Config.read(args.config))
        _print(found)
        if not found["available"]:
            raise InputError(found["diagnostics"][0], "the model does not answer in the form asked for")
        return 0
    if not args.path:
        raise InputError("missing_source", "a source is needed")
    report = lift(spark(), args.path, args.config, args.show, read_rule(args.test_rule) if args.test_rule else None)
    _print(report)
    codes = [c for a in report["artifacts"] for t in a["attempts"] for c in t["diagnostics"]]
    if codes:
        raise InputError(codes[0], "an attempt gave no facts", args.path)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("scan").add_argument("path")
    commands.add_parser("rules").add_argument("path")
    one = commands.add_parser("lift")
    one.add_argument("path", nargs="?")
    one.add_argument("--config", required=True)
    one.add_argument("--check", action="store_true")
    one.add_argument("--show", action="store_true")
    one.add_argument("--test-rule")
    many = commands.add_parser("benchmark")
    many.add_argument("manifest")
    many.add_argument("--config", required=True)
    many.add_argument("--rules", default="rules")
    many.add_argument("--family")
    args = parser.parse_args(argv)
    spark = lambda: SparkSession.builder.appName(f"textloom {args.command}").getOrCreate()
    try:
        if args.command == "rules":
            return _check_rules(args.path)
        if args.command == "scan":
            _print(scan(spark(), args.path))
        elif args.command == "lift":
            return _lift_command(args, spark)
        else:
            _print(benchmark(spark(), args.manifest, read_rule_dir(args.rules), args.config, args.family))
        return 0
    except InputError as e:
        print(f"error {e}", file=sys.stderr)
    except RuleError as e:
        print(f"error [{e.code}] {e.path or 'local'}: {e}", file=sys.stderr)
    except model.ConfigError as e:
        print(f"error [invalid_live_config] {args.config}: {e}", file=sys.stderr)
    except corpus.CorpusError as e:
        print(f"error [invalid_benchmark_manifest] {args.manifest}: {e}", file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main())
