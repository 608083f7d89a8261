"""Helpers of the training-data operators: tables, Arrow batches, the hold-out rule."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, unless a single text is longer.
SLICE_BYTES = 4 << 20
#: Rows with whole texts that go to Python at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; such rows never train a model. Null ids are false."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shipped(spark: SparkSession, tool: object) -> Broadcast:
    """A broadcast of a tool pickled with its class: executors need no copy of this package. Open it with ``unpacked``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(tool))


def unpacked(broadcast: Broadcast) -> object:
    return cloudpickle.loads(broadcast.value)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is executed inside, not what is only planned, sends so many rows to Python at once.

    Thousands of whole texts in one Arrow batch, in every task at once, are a large part of an executor's memory.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def small_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``size`` bytes in each; rows are never cut."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start, held = 0, 0
        for i in range(batch.num_rows):
            value = batch.column(at)[i]
            held += value.as_buffer().size if value.is_valid else 0
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def with_fields(batches: Iterator[pa.RecordBatch], fields: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Put fields of the only column, a struct, in front of it, by their place; nothing is copied."""
    for batch in batches:
        row = batch.column(0)
        yield pa.RecordBatch.from_arrays([*[row.field(i) for i in fields.values()], row], [*fields, "row"])


def text_or_empty(array: pa.Array) -> list[str]:
    return [t or "" for t in array.to_pylist()]
