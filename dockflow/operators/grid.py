"""Regular grids: duplicates, resampling, filling of missing steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.functions.durations import duration_seconds, interval_text, wall_seconds
from dockflow.operators.movement import MOVEMENTS, RUN, add_movements, held_breaks_idle
from dockflow.operators.timeline import CHUNK, GRID_CHUNK, KEY, across_chunks, in_chunk, per_chunk, relay, with_chunk
from dockflow.schemas import ACTIVITY_COLUMNS

STEP = "10m"
#: Chunk of raw polls: a station polled every millisecond has 60,000 rows in it.
POLL_CHUNK = "1m"


def deduplicate(
    df: DataFrame, by: Sequence[str] = ("station_id", "date"), order: Sequence[str] = ()
) -> DataFrame:
    """One row per ``by``: the smallest in ``order``, then in the remaining columns, so the choice is repeatable.

    An aggregate, so copies collapse before the shuffle however many there are of one row.
    """
    rest = [c for c in df.columns if c not in by and c not in order]
    kept = F.min(F.struct(*order, *rest)).alias("_kept")
    out = df.groupBy(*by).agg(kept)
    return out.select(*[F.col(c) if c in by else F.col("_kept")[c].alias(c) for c in df.columns])


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))


def resample_activity(df: DataFrame, key: str = "station_id", date: str = "date", every: str = STEP) -> DataFrame:
    """Rows with movement counts on a regular grid, each step named by its *end*; empty steps are not produced.

    Last levels, highest status (a short disconnection inside a step does not show) and summed movements.
    """
    step = F.window(F.col(date), interval_text(every))
    out = df.groupBy(key, step.alias("_step")).agg(
        F.max_by("available_stands", date).alias("available_stands"),
        F.max_by("available_bikes", date).alias("available_bikes"),
        F.max("status").alias("status"),
        *[_total(F.col(c)).alias(c) for c in MOVEMENTS],
    )
    named = out.withColumn(date, F.col("_step.end"))
    return named.select(key, date, *[c for c in ACTIVITY_COLUMNS if c not in ("station_id", "date")])


def polls_to_grid(
    polls: DataFrame, key: str = "station_id", date: str = "date", every: str = STEP, chunk: str = POLL_CHUNK
) -> DataFrame:
    """Raw polls, unique per station and date, straight to the grid with movement counts.

    Movements are counted inside chunks of ``chunk`` and across their borders, then summed per step, before the shuffle; take a
    chunk in which the busiest station has a comfortable number of polls. No window holds a whole station or a whole step.
    """
    needed = polls.select(key, date, "available_stands", "available_bikes", "status")
    return resample_activity(add_movements(needed, key=key, date=date, chunk=chunk), key, date, every)


def _next_dates(df: DataFrame, key: str, date: str, chunk: str) -> tuple[DataFrame, Column]:
    """The rows with a date, and the date of the key's next row: known from the same chunk or handed over from a later one."""
    dated = with_chunk(df.where(F.col(date).isNotNull()), chunk, key, date)
    heads = per_chunk(dated, F.min(date).alias("_head"))
    following = heads.select(KEY, CHUNK, F.lead("_head").over(across_chunks()).alias("_following"))
    local = dated.withColumn("_next", F.lead(date).over(in_chunk(date)))
    return relay(local, following), F.coalesce("_next", "_following")


def fill_steps(df: DataFrame, key: str, date: str, every: str, chunk: str = GRID_CHUNK) -> DataFrame:
    """Grid rows with the missing steps of each key added after the row before them; ``_added`` tells them.

    The source is read once and nothing is joined with a calendar. Rows without a date are left out.
    """
    dated, until = _next_dates(df, key, date, chunk)
    return _steps_until(dated, until, date, every).select(*df.columns, "_added")


def count_steps(
    df: DataFrame, key: str = "station_id", date: str = "date", every: str = STEP, chunk: str = GRID_CHUNK, name: str = "steps"
) -> DataFrame:
    """Grid rows with the number of steps up to the key's next row as ``name``: 1, and the missing ones that ``upsample`` adds.

    Rows without a date are left out.
    """
    dated, until = _next_dates(df, key, date, chunk)
    return dated.withColumn(name, _missing(until, date, every) + 1).select(*df.columns, name)


def _missing(until: Column, date: str, every: str) -> Column:
    """Steps between the row's and ``until``."""
    missing = F.ceil((wall_seconds(until) - wall_seconds(date)) / duration_seconds(every)) - 1
    return F.greatest(F.coalesce(missing, F.lit(0)), F.lit(0)).cast("bigint")


def _steps_until(df: DataFrame, until: Column, date: str, every: str) -> DataFrame:
    """Every row, and after it the steps that lie before ``until``."""
    return _with_steps(df, _missing(until, date, every), date, every).withColumn("_added", F.col("_added") > 0)


def _with_steps(df: DataFrame, missing: Column, date: str, every: str) -> DataFrame:
    """Every row, with 0 as ``_added``, and after it ``missing`` steps, numbered from 1."""
    steps = df.withColumn("_added", F.explode(F.sequence(F.lit(0).cast("bigint"), missing)))
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("_added") * duration_seconds(every)).cast("decimal(18,6)"))
    return steps.withColumn(date, F.col(date) + offset)


def upsample(
    df: DataFrame, key: str = "station_id", date: str = "date", every: str = STEP, steps: str | None = None
) -> DataFrame:
    """Add the missing steps between each station's first and last row of a grid.

    Movements of an added step are 0; levels and status stay null. With ``steps``, the column that ``count_steps`` has made, added
    steps hold the levels and the status of their row, and its idle run, if there, goes on: what filling them forward and counting
    them gives. No row then leaves its task, so these few rows are what is shuffled, not the many steps.
    """
    if steps is not None:
        first = df.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in MOVEMENTS if c in df.columns})
        whole = _with_steps(first, F.col(steps) - 1, date, every)
        zero, added = F.lit(0).cast("bigint"), F.col("_added") > 0
        later = {c: F.when(added, zero).otherwise(F.col(c)) for c in MOVEMENTS if c in df.columns}
        if RUN in df.columns:
            later[RUN] = F.when(added, F.when(held_breaks_idle(), zero).otherwise(F.col(RUN) + F.col("_added"))).otherwise(F.col(RUN))
        return whole.withColumns(later).drop("_added", steps)
    filled = fill_steps(df, key, date, every)
    empty = {c: F.lit(0).cast("bigint") if c in MOVEMENTS else F.lit(None) for c in df.columns if c not in (key, date)}
    kept = {c: F.coalesce(c, F.lit(0).cast("bigint")) if c in MOVEMENTS else F.col(c) for c in empty}
    return filled.select(
        *[F.when(F.col("_added"), empty[c]).otherwise(kept[c]).alias(c) if c in empty else F.col(c) for c in df.columns]
    )


def hourly_totals(
    df: DataFrame, feature: str, key: str = "station_id", date: str = "date", every: str = "1h"
) -> DataFrame:
    """Totals of ``feature`` per station and hour over rows with status 1, each hour named by its end.

    Hours without rows between a station's first and last hour count 0.
    """
    hour = F.window(F.col(date), interval_text(every)).end
    totals = (
        df.where(F.col("status") == 1)
        .groupBy(key, hour.alias(date))
        .agg(F.coalesce(F.sum(feature), F.lit(0)).alias(feature))
    )
    # 24 rows a station and day, fewer than the summaries of chunks that are windowed over a station elsewhere
    following = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    filled = _steps_until(totals.where(F.col(date).isNotNull()).withColumn("_next", following), F.col("_next"), date, every)
    return filled.select(key, date, F.when(F.col("_added"), 0).otherwise(F.col(feature)).alias(feature))


def source_steps(
    polls: DataFrame, start: str, stop: str, stations: Sequence[int] | None = None, every: str = "5m"
) -> DataFrame:
    """Five-minute aggregate of raw source records between ``start`` and ``stop`` (stop not included).

    Columns of ``polls``: ``time``, ``ident``, ``nom``, ``etat``, ``nbplaces``, ``nbvelos``. The most frequent text
    wins, the smallest one on a tie; levels are the highest seen.
    """
    wanted = (F.col("time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("time") < F.lit(stop).cast("timestamp_ntz"))
    if stations is not None:
        wanted = wanted & F.col("ident").isin(list(stations))
    step = F.window("time", interval_text(every)).start
    return (
        polls.where(wanted)
        .groupBy("ident", step.alias("time"))
        .agg(
            F.mode("nom", True).alias("nom"),
            F.mode("etat", True).alias("etat"),
            F.max("nbplaces").alias("nbplaces"),
            F.max("nbvelos").alias("nbvelos"),
        )
        .select("time", "ident", "nom", "etat", "nbplaces", "nbvelos")
    )
