"""Ordered per-key work in bounded pieces.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here every key is cut into time chunks, the
ordered step runs inside (key, chunk), and what one chunk owes to its predecessors travels through a summary with one
row per (key, chunk), windowed over the key and joined back. The rows are shuffled once, on (key, chunk); the summary is
made from that same shuffle, so the source is read once. The size of the summary depends on the time span, not on the number
of rows: one row per chunk, that is 144 per key and day with ten-minute chunks.

Null is a key like any other, and rows without a date come first, in a chunk of their own: ``KEY`` wraps the key in a struct,
which is never null and equals itself, so plain equality joins serve.

``chunk`` is a duration text. Take one that holds a comfortable number of rows of the busiest key: days for a
ten-minute grid, minutes for a dense raw feed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dockflow.functions.durations import duration_seconds, wall_seconds

KEY = "_key"
CHUNK = "_chunk"
GRID_CHUNK = "7d"
#: Chunk of the rows without a date.
NO_DATE = -(2**62)


def with_chunk(df: DataFrame, chunk: str = GRID_CHUNK, key: str = "station_id", date: str = "date") -> DataFrame:
    """Add key and chunk and deal the rows by them."""
    number = F.coalesce(F.floor(wall_seconds(date) / duration_seconds(chunk)), F.lit(NO_DATE))
    return df.withColumns({KEY: F.struct(key), CHUNK: number}).repartition(KEY, CHUNK)


def in_chunk(date: str, ties: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(KEY, CHUNK).orderBy(date, *ties)


def across_chunks() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(CHUNK)


def earlier_chunks() -> WindowSpec:
    return across_chunks().rowsBetween(Window.unboundedPreceding, -1)


def ordering(date: str, ties: Sequence[str] = ()) -> Column:
    """The row order as one value, for ``max_by`` and ``min_by``."""
    return F.struct(date, *ties)


def per_chunk(df: DataFrame, *summary: Column) -> DataFrame:
    """One row per key and chunk.

    The condition, which always holds, reads all columns: so this branch and that of the rows have the same columns below
    and share one shuffle.
    """
    return df.groupBy(KEY, CHUNK).agg(*summary, F.bit_xor(F.xxhash64(*df.columns)).alias("_all")).where("_all IS NOT NULL")


def relay(df: DataFrame, carried: DataFrame) -> DataFrame:
    """Join what each chunk owes to others, one row per key and chunk, to the rows."""
    return df.join(carried, [KEY, CHUNK], "left")


def previous_values(df: DataFrame, columns: Sequence[str], date: str, ties: Sequence[str] = (), prefix: str = "_prev_") -> DataFrame:
    """Add the previous row's value of ``columns`` within the key; ``df`` carries key and chunk."""
    w, order = in_chunk(date, ties), ordering(date, ties)
    local = df.withColumns(
        {f"{prefix}{c}": F.lag(c).over(w) for c in columns} | {"_head": F.row_number().over(w) == 1}
    )
    tails = per_chunk(df, *[F.max_by(c, order).alias(f"_tail_{c}") for c in columns])
    carried = tails.select(KEY, CHUNK, *[F.lag(f"_tail_{c}").over(across_chunks()).alias(f"_tail_{c}") for c in columns])
    resolved = {
        f"{prefix}{c}": F.when(F.col("_head"), F.col(f"_tail_{c}")).otherwise(F.col(f"{prefix}{c}")) for c in columns
    }
    return relay(local, carried).withColumns(resolved).drop("_head", *[f"_tail_{c}" for c in columns])


def with_row_number(
    df: DataFrame, key: str, date: str, ties: Sequence[str] = (), name: str = "_rn", chunk: str = GRID_CHUNK
) -> DataFrame:
    """Number the rows of each key from 1 in time order."""
    df = with_chunk(df, chunk, key, date)
    counted = per_chunk(df, F.count(F.lit(1)).alias("_rows"))
    offsets = counted.select(KEY, CHUNK, F.coalesce(F.sum("_rows").over(earlier_chunks()), F.lit(0)).alias("_before"))
    local = df.withColumn(name, F.row_number().over(in_chunk(date, ties)).cast("bigint"))
    return (
        relay(local, offsets)
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop(KEY, CHUNK, "_before")
    )


def running_sum(
    df: DataFrame, value: Column, name: str, key: str, date: str, ties: Sequence[str] = (), chunk: str = GRID_CHUNK
) -> DataFrame:
    """Cumulative sum of ``value`` per key in time order."""
    df = with_chunk(df.withColumn("_value", value), chunk, key, date)
    totals = per_chunk(df, F.sum("_value").alias("_total"))
    offsets = totals.select(KEY, CHUNK, F.coalesce(F.sum("_total").over(earlier_chunks()), F.lit(0)).alias("_before"))
    within = F.sum("_value").over(in_chunk(date, ties).rowsBetween(Window.unboundedPreceding, 0))
    return (
        relay(df.withColumn(name, within), offsets)
        .withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("_before", F.lit(0)))
        .drop(KEY, CHUNK, "_value", "_before")
    )


def forward_fill(
    df: DataFrame, column: str | Sequence[str], key: str = "station_id", date: str = "date", ties: Sequence[str] = (),
    chunk: str = GRID_CHUNK,
) -> DataFrame:
    """Replace nulls by the latest earlier value of the same key, in one column or, with one shuffle, in several."""
    columns = [column] if isinstance(column, str) else list(column)
    df = with_chunk(df, chunk, key, date)
    filled_at = {c: F.when(F.col(c).isNotNull(), ordering(date, ties)) for c in columns}
    latest = per_chunk(df, *[F.max_by(c, filled_at[c]).alias(f"_latest_{c}") for c in columns])
    carried = latest.select(KEY, CHUNK, *[F.last(f"_latest_{c}", ignorenulls=True).over(earlier_chunks()).alias(f"_latest_{c}") for c in columns])
    w = in_chunk(date, ties).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    whole = relay(within, carried).withColumns({c: F.coalesce(c, f"_latest_{c}") for c in columns})
    return whole.drop(KEY, CHUNK, *[f"_latest_{c}" for c in columns])
