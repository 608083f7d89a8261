"""Row filters, snapshots and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.schemas import CLOSED_PERIOD, MAX_IDLE_STEPS, MONITORED_MEAN, UNUSED_STATIONS


def _instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def filter_periode(
    df: DataFrame, non_use_station_id: Sequence[int] | None = UNUSED_STATIONS,
    period: tuple[str, str] = CLOSED_PERIOD, key: str = "station_id", date: str = "date",
) -> DataFrame:
    """Leave out the closed period, both ends included, and the listed stations."""
    start, end = period
    kept = df.where(~F.col(date).between(_instant(start), _instant(end)))
    return without_stations(kept, non_use_station_id, key)


def without_stations(
    df: DataFrame, stations: Sequence[int] | DataFrame | None, key: str = "station_id"
) -> DataFrame:
    """Leave out stations given as a list or as a table with the key column."""
    if isinstance(stations, DataFrame):
        return df.join(stations.select(key).distinct(), key, "left_anti")
    if not stations:
        return df
    return df.where(~F.col(key).isin(list(stations)))


def usable_rows(df: DataFrame, max_idle: int = MAX_IDLE_STEPS) -> DataFrame:
    """Rows of open stations whose idle run is not longer than ``max_idle`` steps."""
    return df.where((F.col("status") == 1) & (F.col("consecutive_no_transactions_out") <= max_idle))


def monitored_stations(
    profile: DataFrame, threshold: float = MONITORED_MEAN,
    non_use_station_id: Sequence[int] | DataFrame | None = UNUSED_STATIONS, key: str = "station_id",
) -> DataFrame:
    """Distinct stations active enough to be monitored."""
    return without_stations(profile.where(F.col("mean") >= threshold).select(key).distinct(), non_use_station_id, key)


def date_slice(df: DataFrame, start_date: str = "", end_date: str = "", date: str = "date") -> DataFrame:
    """Rows between two dates, both included; an empty text leaves that side open."""
    if start_date:
        df = df.where(F.col(date) >= _instant(start_date))
    if end_date:
        df = df.where(F.col(date) <= _instant(end_date))
    return df


def require_station(df: DataFrame, station_id: int, key: str = "station_id") -> None:
    """Raise ``ValueError`` when no row has the station. Looks for one row only."""
    if df.where(F.col(key) == station_id).limit(1).isEmpty():
        raise ValueError(f"no rows for station {station_id}")


def labelled_rows(df: DataFrame, target: str = "target") -> DataFrame:
    return df.where(F.col(target).isNotNull())


def latest_rows(
    df: DataFrame, scope: str = "global", key: str = "station_id", date: str = "date"
) -> DataFrame:
    """Rows of the newest date: of the whole table, or of each station with ``scope="station"``."""
    if scope == "global":
        return df.where(F.col(date) == df.select(F.max(date)).scalar())
    if scope == "station":
        newest = df.groupBy(F.col(key).alias("_key")).agg(F.max(date).alias("_newest"))
        return df.join(newest, F.col(key).eqNullSafe(F.col("_key")) & (F.col(date) == F.col("_newest")), "left_semi")
    raise ValueError("scope is 'global' or 'station'")


def named_stations(df: DataFrame, name: str, exact: bool = True, column: str = "station_name") -> DataFrame:
    """Stations by name: equal, or containing the text whatever its case."""
    if exact:
        return df.where(F.col(column) == name)
    return df.where(F.lower(column).contains(name.lower()))


def stations_in_anomaly(df: DataFrame) -> DataFrame:
    return df.where(F.col("anomaly") == -1)


def map_focus(
    stations: DataFrame, station_id: int | None = None, zoom: float = 15.0,
    centre: tuple[float, float, float] = (44.837794, -0.581662, 11.0), key: str = "station_id",
) -> DataFrame:
    """One row ``lat, lon, zoom``: the station, or the city when no station is asked for."""
    if station_id is None:
        lat, lon, wide = (F.lit(v) for v in centre)
        return stations.sparkSession.range(1).select(lat.alias("lat"), lon.alias("lon"), wide.alias("zoom"))
    require_station(stations, station_id, key)
    one = stations.where(F.col(key) == station_id)
    return one.select("lat", "lon", F.lit(float(zoom)).alias("zoom")).limit(1)
