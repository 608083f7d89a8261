"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_activity(df: DataFrame, path: str, key: str = "station_id", date: str = "date", files: int | None = None) -> None:
    """Activity as Parquet, sorted by station and date within each file.

    Dealt by station and month, so a busy station spreads over several files and a reader of one station skips most row
    groups. Nothing is sampled for it: the plan runs once.
    """
    by = [F.col(key), F.date_trunc("month", F.col(date))]
    dealt = df.repartition(files, *by) if files else df.repartition(*by)
    dealt.sortWithinPartitions(key, date).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with header; quotes inside a quoted value are doubled."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, escape='"')


def export_model(models: DataFrame, path: str, key: str = "station_id") -> None:
    """Model table as Parquet, dealt by station and sorted in each file; every model is fitted once."""
    models.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, station_id: int | None = None, key: str = "station_id") -> DataFrame:
    """All models, or the one of a station."""
    models = spark.read.parquet(path)
    return models if station_id is None else models.where(F.col(key) == station_id)
