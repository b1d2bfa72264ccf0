"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.llm.bpe import BoundedCache
from textloom.plans.materialize import materialized
from textloom.shipping import ship

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    return materialized(df)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores, so that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Let the session build Arrow batches of at most ``rows`` rows.

    Batches are built outside the JVM's heap and again in the Python worker, so with long
    texts the session's default of 10,000 rows is the largest part of an executor's memory.
    The setting is read when a plan runs, so it has to stand for as long as the session does;
    only the registered queries and the pipeline set it, the operators leave it alone.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def release() -> None:
    """Give freed memory back to the system.

    Workers outlive their task, and what their allocators keep stands beside the executor's heap while others work.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` by workers that know this package, and that keep only the words of the operator at work."""
    owner = fn.__module__ if fn.__module__ != __name__ else fn.owner

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        BoundedCache.forget(owner)
        yield from fn(batches)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def in_worker(df: DataFrame, fn: Callable[[pa.Table], Any]) -> Any:
    """``fn`` of all rows of ``df``, which must be few, worked out in one task of an executor.

    The driver gets nothing but the result, so neither the rows nor what is made of them weigh on its memory.
    """
    schema = df.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        rows = pa.Table.from_batches(rows) if rows else to_arrow_schema(schema).empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fn(rows))], pa.binary())], ["found"])

    run.__module__ = fn.__module__
    return pickle.loads(arrow_map(df.repartition(1), run, "found binary").first()[0])


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """For plans that run inside: at most ``rows`` rows in a batch."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def slices(batch: pa.RecordBatch, text: str, budget: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one slice holds about ``budget`` characters, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def over_slices(fn, schema: pa.Schema, text: str):
    """A ``mapInArrow`` function that applies ``fn`` (batch to list of columns) to bounded slices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(fn(part), schema)],
                    schema=schema,
                )

    run.owner = fn.__module__
    return run
