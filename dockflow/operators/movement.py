"""Movements between consecutive rows of a station and the length of idle runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.operators.timeline import (
    CHUNK,
    GRID_CHUNK,
    KEY,
    across_chunks,
    in_chunk,
    ordering,
    per_chunk,
    previous_values,
    relay,
    with_chunk,
)

LEVELS = ("available_stands", "available_bikes")
MOVEMENTS = ("transactions_in", "transactions_out", "transactions_all")
RUN = "consecutive_no_transactions_out"


def rise(now: Column, before: Column) -> Column:
    """Increase over the previous level, 0 for a fall. A missing previous level counts as no change."""
    change = now - F.coalesce(before, now)
    return F.when(change < 0, F.lit(0).cast("bigint")).otherwise(change)


def level_change(now: Column, before: Column) -> Column:
    return F.abs(now - F.coalesce(before, now))


def movement_columns(stands: Column, bikes: Column, stands_before: Column, bikes_before: Column) -> dict[str, Column]:
    """The three counts of one step. Differences are taken on signed integers."""
    stands, bikes, stands_before, bikes_before = (
        c.cast("bigint") for c in (stands, bikes, stands_before, bikes_before)
    )
    return {
        "transactions_in": rise(bikes, bikes_before),
        "transactions_out": rise(stands, stands_before),
        "transactions_all": level_change(bikes, bikes_before),
    }


def _movements(df: DataFrame, names: Sequence[str], date: str, ties: Sequence[str]) -> DataFrame:
    """Movement counts on a chunked frame; key and chunk stay."""
    stands, bikes = LEVELS
    needed = []
    if "transactions_out" in names:
        needed.append(stands)
    if "transactions_in" in names or "transactions_all" in names:
        needed.append(bikes)
    d = previous_values(df, needed, date, ties)
    level = {c: F.col(c) if c in needed else F.lit(None) for c in LEVELS}
    before = {c: F.col(f"_prev_{c}") if c in needed else F.lit(None) for c in LEVELS}
    counts = movement_columns(level[stands], level[bikes], before[stands], before[bikes])
    kept = [c for c in df.columns if c not in names]
    return d.select(*[F.col(f"`{c}`") for c in kept], *[counts[n].alias(n) for n in names])


def add_movements(
    df: DataFrame, names: Sequence[str] = MOVEMENTS, key: str = "station_id", date: str = "date",
    ties: Sequence[str] = (), chunk: str = GRID_CHUNK,
) -> DataFrame:
    """Add the asked movement counts in one pass: one shuffle on (station, chunk), one sort, one window."""
    return _movements(with_chunk(df, chunk, key, date), names, date, ties).drop(KEY, CHUNK)


def add_movements_and_idle(
    df: DataFrame, names: Sequence[str] = MOVEMENTS, key: str = "station_id", date: str = "date",
    ties: Sequence[str] = (), chunk: str = GRID_CHUNK, steps: str | None = None,
) -> DataFrame:
    """Movement counts and idle run together: the idle run works on the partitions of the movements.

    ``names`` must hold ``transactions_out``, on which the idle run rests. ``steps`` as for the idle run alone.
    """
    return _idle(_movements(with_chunk(df, chunk, key, date), names, date, ties), date, ties, steps).drop(KEY, CHUNK)


def get_transactions_out(df: DataFrame, **options) -> DataFrame:
    """Add ``transactions_out``: bikes taken since the previous row, seen as freed stands."""
    return add_movements(df, ["transactions_out"], **options)


def get_transactions_in(df: DataFrame, **options) -> DataFrame:
    """Add ``transactions_in``: bikes returned since the previous row."""
    return add_movements(df, ["transactions_in"], **options)


def get_transactions_all(df: DataFrame, **options) -> DataFrame:
    """Add ``transactions_all``: absolute change of the bike count since the previous row."""
    return add_movements(df, ["transactions_all"], **options)


def breaks_idle() -> Column:
    """True on rows that end an idle run: a departure, a closed station, too few bikes, or no data.

    A null in any other operand does not break a run.
    """
    return F.coalesce((F.col("transactions_out") >= 1) | _idle_ends_without_departure(), F.lit(False))


def held_breaks_idle() -> Column:
    """The same on the steps that hold a row's levels after it: these have no departure."""
    return F.coalesce(_idle_ends_without_departure(), F.lit(False))


def _idle_ends_without_departure() -> Column:
    return (F.col("status") == 0) | (F.col("available_bikes") <= 2) | F.col("available_stands").isNull()


def get_consecutive_no_transactions_out(
    df: DataFrame, key: str = "station_id", date: str = "date", ties: Sequence[str] = (), chunk: str = GRID_CHUNK,
    steps: str | None = None,
) -> DataFrame:
    """Add ``consecutive_no_transactions_out``: position, from 1, within a run of idle rows, 0 on breaking rows.

    A gap in the data is a breaking row too: after it the count starts again at 1. With ``steps``, a column of counts from 1, a row
    stands for so many steps that hold its levels; it gets the position of the first, and later rows count on from the last.
    """
    return _idle(with_chunk(df, chunk, key, date), date, ties, steps).drop(KEY, CHUNK)


def _idle(df: DataFrame, date: str, ties: Sequence[str], steps: str | None = None) -> DataFrame:
    """Idle run on a chunked frame; key and chunk stay.

    Inside a chunk the position is the distance to the last breaking row. Before the chunk's first break it
    continues the run that reaches in from earlier chunks: rows since the last break of the key.
    """
    name = RUN
    w = in_chunk(date, ties)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    if steps is None:
        local = df.drop(name).withColumn("_pos", F.row_number().over(w).cast("bigint"))
        end, broken = F.col("_pos"), F.when(breaks_idle(), F.col("_pos"))
    else:
        local = df.drop(name).withColumn("_pos", F.sum(steps).over(upto) - F.col(steps) + 1)
        end = F.col("_pos") + F.col(steps) - 1
        broken = F.when(held_breaks_idle(), end).when(breaks_idle(), F.col("_pos"))
    local = local.withColumn("_break", F.max(broken).over(upto))

    # rows left idle at the end of each chunk; a chunk without a break adds all its rows to the run before it
    ends = per_chunk(local, F.max(end).alias("_n"), F.max("_break").alias("_last"))
    over_key = across_chunks()
    stretches = ends.withColumn("_stretch", F.count("_last").over(over_key))
    in_stretch = Window.partitionBy(KEY, "_stretch").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    ends = stretches.withColumn("_open", F.sum(F.col("_n") - F.coalesce("_last", F.lit(0))).over(in_stretch))
    entry = ends.select(KEY, CHUNK, F.coalesce(F.lag("_open").over(over_key), F.lit(0)).alias("_entry"))

    run = F.when(F.col("_break").isNotNull(), F.col("_pos") - F.col("_break")).otherwise(
        F.col("_pos") + F.coalesce("_entry", F.lit(0))
    )
    if steps is not None:
        run = F.when(breaks_idle(), F.lit(0).cast("bigint")).otherwise(run)
    return relay(local, entry).withColumn(name, run).drop("_pos", "_break", "_entry")


def smooth_status(
    df: DataFrame, key: str = "station_id", date: str = "date", ties: Sequence[str] = (), chunk: str = GRID_CHUNK
) -> DataFrame:
    """Turn a single closed row into an open one when the *next* row of the station is open; null status is 0.

    The next row is taken within the station, so a station's last row never looks at another station.
    """
    d = with_chunk(df, chunk, key, date)
    w = in_chunk(date, ties)
    heads = per_chunk(d, F.min_by("status", ordering(date, ties)).alias("_head"))
    following = heads.select(KEY, CHUNK, F.lead("_head").over(across_chunks()).alias("_following"))
    local = d.withColumns({"_next": F.lead("status").over(w), "_final": F.lead(F.lit(True)).over(w).isNull()})
    upcoming = F.when(F.col("_final"), F.col("_following")).otherwise(F.col("_next"))
    status = F.when(F.coalesce("status", F.lit(0)) != 0, F.col("status")).when(upcoming == 1, 1).otherwise(0)
    return (
        relay(local, following)
        .withColumn("status", status.cast("int"))
        .drop(KEY, CHUNK, "_next", "_final", "_following")
    )
