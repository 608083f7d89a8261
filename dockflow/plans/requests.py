"""Request plans: date intervals, chunks of stations, and both together."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _day(text: str) -> date:
    return datetime.strptime(text, "%Y-%m-%d").date()


def _starts(start_date: str, stop_date: str, chunk_days: int) -> Column | None:
    """Array of interval starts; ``None`` for an empty period."""
    start, stop = _day(start_date), _day(stop_date)
    if start > stop:
        raise ValueError("start_date must not be after stop_date")
    if start == stop:
        return None
    last = stop - timedelta(days=1)
    return F.sequence(F.lit(start), F.lit(last), F.expr(f"INTERVAL {int(chunk_days)} DAYS"))


def add_date_intervals(df: DataFrame, start_date: str, stop_date: str, chunk_days: int = 60) -> DataFrame:
    """Every row once per interval: adds ``start_date`` and ``stop_date`` texts. The last interval is cut short."""
    starts = _starts(start_date, stop_date, chunk_days)
    if starts is None:
        starts = F.array().cast("array<date>")
    end = F.least(F.date_add("_start", int(chunk_days)), F.lit(_day(stop_date)))
    return df.withColumn("_start", F.explode(starts)).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.date_format("_start", "yyyy-MM-dd").alias("start_date"),
        F.date_format(end, "yyyy-MM-dd").alias("stop_date"),
    )


def generate_date_intervals(spark: SparkSession, start_date: str, stop_date: str, chunk_days: int = 60) -> DataFrame:
    """Consecutive intervals between two dates, each at most ``chunk_days`` long."""
    return add_date_intervals(spark.range(1).select(), start_date, stop_date, chunk_days)


def chunk_list(stations: DataFrame, chunk_size: int, key: str = "station_id", span: int = 100_000) -> DataFrame:
    """Station ids in chunks of ``chunk_size`` consecutive ids: ``chunk, station_ids``.

    Ids are numbered within ranges of ``span`` ids, and the ranges by their counts, so no task sorts all ids.
    """
    ranged = stations.select(F.col(key).alias("_id")).withColumn("_range", F.floor(F.col("_id") / span))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_id"))
    numbered = ranged.withColumn("_rn", within).join(offsets, "_range")
    chunk = F.floor((F.col("_before") + F.col("_rn") - 1) / chunk_size)
    return (
        numbered.groupBy(chunk.alias("chunk"))
        .agg(F.sort_array(F.collect_list("_id")).alias("station_ids"))
        .select("chunk", "station_ids")
    )


def request_plan(
    stations: DataFrame, start_date: str, stop_date: str, chunk_days: int = 4, chunk_size: int = 25,
    key: str = "station_id",
) -> DataFrame:
    """One row per request: every station chunk with every interval."""
    return add_date_intervals(chunk_list(stations, chunk_size, key), start_date, stop_date, chunk_days)
