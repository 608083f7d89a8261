"""Joins with side tables and nearest stations.

No broadcast is forced: Spark broadcasts a side whose measured size is below its threshold and otherwise
shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.durations import offset_by, wall_seconds
from dockflow.functions.geo import geodesic_km, get_distance


def get_meteo(df: DataFrame, meteo: DataFrame, date: str = "date") -> DataFrame:
    """Add the weather of the row's hour; rows without weather keep nulls."""
    hour = (F.floor(wall_seconds(date) / 3600)).alias("_hour")
    left = df.withColumn("_hour", F.floor(wall_seconds(date) / 3600))
    right = meteo.select(hour, *[F.col(c) for c in meteo.columns if c != date])
    return left.join(right, "_hour", "left").drop("_hour")


def with_profile(
    df: DataFrame, profile: DataFrame, label: str | None = None, key: str = "station_id",
    name: str = "profile_station_activity",
) -> DataFrame:
    """Add the activity label of the row's station, or one given ``label`` for all."""
    if label is not None:
        return df.withColumn(name, F.lit(label))
    first = profile.groupBy(key).agg(F.min(name).alias(name))
    return df.join(first, key, "left")


def create_target(
    df: DataFrame, target_col: str, horizon_prediction: str, key: str = "station_id", date: str = "date"
) -> DataFrame:
    """Add ``target``: value of ``target_col`` exactly one horizon later in the same station, else null.

    The match is by time, so gaps in the series give null. Rows are unique per station and date; a copy of a row
    never multiplies others.
    """
    later = df.groupBy(F.col(key).alias("_key"), F.col(date).alias("_then")).agg(F.max(target_col).alias("target"))
    there = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_future") == F.col("_then"))
    dated = df.withColumn("_future", offset_by(date, horizon_prediction))
    return dated.join(later, there, "left").select(*[F.col(f"`{c}`") for c in df.columns], "target")


def find_nearest_stations(
    stations: DataFrame, lat: float, lon: float, nombre_station_proche: int = 3, method: str = "geodesic",
    key: str = "station_id",
) -> DataFrame:
    """The k stations closest to a point, with ``distance`` in km, nearest first.

    Each task keeps its own k best; only those meet.
    """
    measure = {"geodesic": geodesic_km, "haversine": get_distance}[method]
    measured = stations.withColumn("distance", measure(float(lat), float(lon), "lat", "lon"))
    return measured.orderBy("distance", key).limit(nombre_station_proche)


def extreme_stations(
    snapshot: DataFrame, column: str = "available_bikes", most: bool = True, k: int = 1, key: str = "station_id"
) -> DataFrame:
    """The k stations with the most (or fewest) bikes."""
    first = F.desc(column) if most else F.asc_nulls_last(column)
    return snapshot.orderBy(first, key).limit(k)
