"""Is an hourly table whole: every hour there, once, and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.operators.timeline import KEY

#: Rows, by their position, that are looked at together.
ROWS = 4096
_CHUNK = "_chunk"


def expected_hours(df: DataFrame, key: str = "station_id", date: str = "date") -> DataFrame:
    """All hours from the first to the last of each key."""
    hour = F.date_trunc("hour", F.col(date)).cast("timestamp_ntz")
    ends = df.groupBy(key).agg(F.min(hour).alias("_first"), F.max(hour).alias("_last")).where(F.col("_first").isNotNull())
    step = F.make_dt_interval(F.lit(0), F.lit(1))
    return ends.select(key, F.explode(F.sequence("_first", "_last", step)).alias("hour"))


def rows_out_of_order(df: DataFrame, position: str, key: str = "station_id", date: str = "date", rows: int = ROWS) -> DataFrame:
    """Rows whose hour lies before that of the previous row of the key, by ``position``; with ``hour``.

    A whole number as position cuts each key into chunks; the last hour of a chunk travels to the next one that has rows.
    """
    hour = F.date_trunc("hour", F.col(date)).cast("timestamp_ntz")
    placed = df.where(F.col(date).isNotNull()).select(
        F.struct(key).alias(KEY), F.floor(F.col(position) / rows).alias(_CHUNK), F.col(position).alias("_position"), hour.alias("hour")
    )
    inside = Window.partitionBy(KEY, _CHUNK).orderBy("_position")
    local = placed.withColumn("_before", F.lag("hour").over(inside))
    tails = placed.groupBy(KEY, _CHUNK).agg(F.max_by("hour", "_position").alias("_tail"))
    carried = tails.select(KEY, _CHUNK, F.lag("_tail").over(Window.partitionBy(KEY).orderBy(_CHUNK)).alias("_tail"))
    joined = local.join(carried, [KEY, _CHUNK])
    # the first row of a chunk has no row before it there
    return joined.where(F.col("hour") < F.coalesce("_before", "_tail")).select(F.col(KEY)[key].alias(key), "hour")


def hourly_problems(df: DataFrame, position: str, key: str = "station_id", date: str = "date", rows: int = ROWS) -> DataFrame:
    """``hour``, ``problem`` and ``n`` per key: hours that are ``missing`` (n = 0), ``doubled`` (n rows) or ``unordered`` (n rows too late).

    Rows without a date are left aside; a key without dated rows has no hours to miss. A null key is a key.
    """
    hour = F.date_trunc("hour", F.col(date)).cast("timestamp_ntz")
    counted = df.where(F.col(date).isNotNull()).groupBy(key, hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    there = counted.select(F.col(key).alias("_key"), F.col("hour").alias("_hour"))
    calendar = expected_hours(df, key, date)
    missing = calendar.join(there, F.col(key).eqNullSafe(F.col("_key")) & (F.col("hour") == F.col("_hour")), "left_anti")
    late = rows_out_of_order(df, position, key, date, rows).groupBy(key, "hour").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        missing.select(key, "hour", F.lit("missing").alias("problem"), F.lit(0).cast("bigint").alias("n")),
        counted.where("n > 1").select(key, "hour", F.lit("doubled").alias("problem"), "n"),
        late.select(key, "hour", F.lit("unordered").alias("problem"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
