"""From polls to activity on the ten-minute grid, and the station attribute table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.functions.calendar import naive_timestamp, offset_instant, zone_wall_clock
from dockflow.functions.scalars import capacity, point_part, status_flag
from dockflow.operators.grid import deduplicate, polls_to_grid, upsample
from dockflow.schemas import ARRAY_STATUS, GEOJSON_STATUS, STATION_ATTRIBUTES
from dockflow.sources.readers import fields_of, read_geojson, read_station_files
from dockflow.sources.writers import write_activity, write_csv


def flatten_geojson(docs: DataFrame) -> DataFrame:
    """One row per feature with its ``properties``; drops what no later step uses."""
    features = docs.select(F.explode("features").alias("_f"))
    return features.select("_f.properties.*").drop("gid", "nom")


def flatten_arrays(docs: DataFrame) -> DataFrame:
    """One row per poll from parallel arrays: ``id, available_bikes, available_stands, status, ts``."""
    stations = docs.select(F.explode("data").alias("_s"))
    names = ("available_bikes", "available_stands", "status", "ts")
    zipped = F.arrays_zip(*[F.col(f"_s.{n}").alias(n) for n in names])
    return stations.select(F.col("_s.id").alias("id"), F.inline(zipped)).toDF("id", *names)


def typed_geojson_polls(docs: DataFrame, zone: str = "Europe/Paris") -> DataFrame:
    """Typed polls in wall-clock time of ``zone``, copies included; ``_instant`` orders copies of (station, date)."""
    return flatten_geojson(docs).select(
        F.col("ident").cast("int").alias("station_id"),
        zone_wall_clock("time", zone).alias("date"),
        F.col("nbplaces").cast("bigint").alias("available_stands"),
        F.col("nbvelos").cast("bigint").alias("available_bikes"),
        status_flag("etat", GEOJSON_STATUS).alias("status"),
        offset_instant("time").alias("_instant"),
    )


def geojson_polls(docs: DataFrame, zone: str = "Europe/Paris") -> DataFrame:
    """Typed polls in wall-clock time of ``zone``; of copies of (station, date) the earliest instant stays."""
    return deduplicate(typed_geojson_polls(docs, zone), order=["_instant"]).drop("_instant")


def array_polls(docs: DataFrame) -> DataFrame:
    """Typed polls of the parallel-array format, unique per station and date."""
    flat = flatten_arrays(docs)
    typed = flat.select(
        F.col("id").cast("int").alias("station_id"),
        naive_timestamp("ts").alias("date"),
        F.col("available_stands").cast("bigint").alias("available_stands"),
        F.col("available_bikes").cast("bigint").alias("available_bikes"),
        status_flag("status", ARRAY_STATUS).alias("status"),
    )
    return deduplicate(typed)


def geojson_to_activity(docs: DataFrame, zone: str = "Europe/Paris") -> DataFrame:
    """GeoJSON documents to activity on the grid; steps without polls are left out."""
    return polls_to_grid(geojson_polls(docs, zone))


def arrays_to_activity(docs: DataFrame) -> DataFrame:
    """Parallel-array documents to activity on the grid; missing steps are filled."""
    return upsample(polls_to_grid(array_polls(docs)))


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Several sources one after the other, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def station_file_polls(files: DataFrame) -> DataFrame:
    """Typed polls of the station CSV files. An unknown status word has no value here."""
    status = F.when(F.col("status") == "open", 1).when(F.col("status") == "closed", 0)
    typed = files.select(
        F.col("id").alias("station_id"),
        F.col("timestamp").alias("date"),
        F.col("available_stands").cast("bigint").alias("available_stands"),
        F.col("available_bikes").cast("bigint").alias("available_bikes"),
        status.alias("status"),
    )
    return deduplicate(typed)


def create_activity_time_series(spark: SparkSession, files: str, target: str) -> DataFrame:
    """All station CSV files to one activity table on the grid, written as Parquet."""
    write_activity(polls_to_grid(station_file_polls(read_station_files(spark, files))), target)
    return spark.read.parquet(target)


def create_learning_dataset(
    spark: SparkSession, landed: str | list[str], target: str, start_time: str | None = None,
    end_time: str | None = None, multi_line: bool = False,
) -> DataFrame:
    """All landed GeoJSON responses to one activity table, written as Parquet.

    Every interval is kept. Neighbouring responses share their border day; the copies fall to the (station, date) rule.
    """
    polls = geojson_polls(read_geojson(spark, landed, multi_line))
    if start_time:
        polls = polls.where(F.col("date") >= F.lit(start_time).cast("timestamp_ntz"))
    if end_time:
        polls = polls.where(F.col("date") <= F.lit(end_time).cast("timestamp_ntz"))
    write_activity(polls_to_grid(polls), target)
    return spark.read.parquet(target)


def create_station_attribute(open_data: DataFrame, target: str | None = None) -> DataFrame:
    """Station attributes from the open-data list, with capacity and coordinates; written as CSV when asked."""
    stations = open_data.withColumns(
        {
            "total_stand": capacity(),
            "lat": point_part("`Geo Point`", 0),
            "lon": point_part("`Geo Point`", 1),
        }
    ).withColumnsRenamed({"commune": "COMMUNE", "IDENT": "station_id", "TYPE": "TYPEA"})
    stations = stations.select(*[F.col(f"`{name}`") for name in fields_of(STATION_ATTRIBUTES).names])
    if target is not None:
        write_csv(stations, target, sep=";")
    return stations
