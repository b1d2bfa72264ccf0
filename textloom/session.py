"""The library as one session: read rules, lift files, run rules, close."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.operators import annotate, decode
from textloom.operators.decode import DecodeLimits
from textloom.plans import evaluate, hunt, reports, rules
from textloom.plans.lift import Lifted, Reader, Unpacker, lift
from textloom.sources import files, model

MAX_PROMPT = 128 * 1024


class InputError(ValueError):
    """An input that cannot be used: ``code`` says why, ``path`` where."""

    def __init__(self, code: str, message: str, path: str = "local"):
        super().__init__(f"[{code}] {path}: {message}")
        self.code, self.path, self.message = code, path, message


SAID = {
    "skipped_symlink": "links are not followed", "invalid_target": "not a regular file", "unsupported_suffix": "no suffix of a text file", "unreadable_file": "the file cannot be read",
    "oversized_file": "the file is too long", "invalid_utf8": "the file is not UTF-8",
}


class Session:
    """``reader`` turns artifacts into attempts, ``unpacker`` finds hidden texts; without a reader only rules can be read and run."""

    def __init__(self, spark: SparkSession, reader: Reader | None = None, unpacker: Unpacker | None = None, limits: DecodeLimits = DecodeLimits()):
        self.spark, self.reader, self.unpacker, self.limits, self.open = spark, reader, unpacker, limits, True

    @classmethod
    def from_live_config(cls, spark: SparkSession, path: str | Path, post: model.Post = model.send) -> Session:
        """A session that reads by the model that a TOML file names."""
        config = model.Config.read(str(path))
        return cls(spark, lambda artifacts: model.lift(artifacts, config, post), model.unpacker(config, post) if config.unpack_model else None)

    def __enter__(self) -> Session:
        self._need_open()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.open = False

    def _need_open(self) -> None:
        if not self.open:
            raise RuntimeError("the session is closed")

    def read_rule(self, path: str | Path) -> rules.Rule:
        self._need_open()
        return rules.read_rule(path)

    def read_rule_dir(self, path: str | Path) -> list[rules.Rule]:
        self._need_open()
        if not Path(path).is_dir():
            raise InputError("invalid_rule_directory", "no folder of rules", str(path))
        return rules.read_rule_dir(path)

    def lift(self, roots: DataFrame) -> Lifted:
        """Everything that ``roots`` (artifact_id, source_name, text) hold."""
        self._need_open()
        if self.reader is None:
            raise RuntimeError("a session without a reader cannot lift")
        return lift(roots, self.reader, self.limits, self.unpacker)

    def lift_file(self, path: str | Path) -> Lifted:
        """One file, or all good files of a folder; a single bad file raises ``InputError``."""
        self._need_open()
        return self.lift(load(self.spark, str(path)))

    def lift_text(self, text: str, name: str = "input") -> Lifted:
        self._need_open()
        return self.lift(self.spark.createDataFrame([(name, text)], "source_name string, text string").withColumn("artifact_id", ids.content_id(F.col("text"))))

    def run_rule(self, rule: rules.Rule, lifted: Lifted | list[Lifted]) -> DataFrame:
        """The hunt of one rule over what was lifted, once or several times; ``hunt.diagnostics`` tells of readings that are left out."""
        self._need_open()
        every = [lifted] if isinstance(lifted, Lifted) else list(lifted)
        both = every[0]
        for more in every[1:]:
            both = both.union(more)
        return hunt.hunt(rule, both.facts(), both.accepted())

    def analyze(self, prompt: str, rule_list: list[rules.Rule]) -> dict[str, DataFrame]:
        """What one prompt holds: tokens to mark, nodes and edges to draw, rules with their matches, codes, attempts."""
        if not isinstance(prompt, str) or not prompt.strip():
            raise InputError("empty_prompt", "there is no text to analyze")
        if len(prompt) > MAX_PROMPT:
            raise InputError("oversized_prompt", "the text is too long")
        lifted = self.lift_text(prompt)
        facts = lifted.facts()
        results = evaluate.evaluate_all(rule_list, facts, lifted.accepted()) if rule_list else None
        return {
            "tokens": reports.text_tokens(facts).orderBy("start", "end", "node_id"),
            "nodes": reports.graph_nodes(facts),
            "edges": reports.graph_elements(facts),
            **({"rules": reports.rule_matches(results, facts), "rule_status": reports.rule_summary(results)} if rule_list else {}),
            "diagnostics": reports.diagnostic_codes(lifted.diagnostics).orderBy("code"),
            "attempts": reports.attempt_list(lifted.attempts).orderBy("artifact_id", "ordinal"),
        }


def load(spark: SparkSession, path: str) -> DataFrame:
    """(artifact_id, source_name, text) of a file, or of the good files of a folder.

    Raises ``InputError`` for what is not there and for a single file that cannot be used.
    """
    local = "://" not in path
    if local and not Path(path).exists() and not Path(path).is_symlink():
        raise InputError("invalid_target", "there is no such file or folder", path)
    scanned = files.scan(spark, path)
    if local and not Path(path).is_dir():
        code = scanned.select("code").first()
        if code and code[0]:
            raise InputError(code[0], SAID[code[0]], path)
    return files.accepted(scanned)


def scan_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What a file or folder shows without any reading: artifacts by occurrence, annotations, decoded children, and what was wrong.

    Texts that occur several times are scanned once.
    """
    load(spark, path)
    scanned = files.scan(spark, path)
    artifacts = files.accepted(scanned)
    once = artifacts.select("artifact_id", "text").dropDuplicates(["artifact_id"])
    return {
        "artifacts": artifacts,
        "annotations": annotate.annotate(once),
        "virtual_children": decode.children(decode.expand(once, sound=True)),
        "decode_diagnostics": decode.diagnostics(decode.expand(once)),
        "diagnostics": files.diagnostics(scanned),
    }
