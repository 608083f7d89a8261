"""Tables behind the activity, anomaly and map reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.calendar import display_date
from dockflow.functions.scalars import hover_text, state_colour, state_rank, station_state
from dockflow.models.anomaly import RUN, predict_anomalies_station
from dockflow.operators.filters import date_slice, filter_periode, require_station
from dockflow.operators.grid import hourly_totals
from dockflow.operators.movement import add_movements_and_idle
from dockflow.operators.timeline import GRID_CHUNK, running_sum
from dockflow.schemas import CLOSED_PERIOD, LEGEND_STATIONS, UNUSED_STATIONS
from dockflow.session import settle

_AGGREGATES = {
    "mean": F.avg,
    "sum": F.sum,
    "median": F.median,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
    "count": F.count,
}


def station_activity(
    df: DataFrame, station_id: int, features_to_plot: Sequence[str] | None = None, start_date: str = "",
    end_date: str = "", date: str = "date",
) -> DataFrame:
    """Chosen columns of one station over a date range."""
    features = ["available_stands"] if features_to_plot is None else features_to_plot
    if not isinstance(features, list):
        raise TypeError("give features_to_plot as a list of column names")
    require_station(df, station_id)
    rows = date_slice(df, start_date, end_date, date).where(F.col("station_id") == station_id)
    return rows.select("station_id", date, *features)


def activity_heatmap(
    df: DataFrame, feature_to_plot: str, station_id: int | None = None, aggfunc: str = "mean",
    filter_data: bool = False, non_use_station_id: Sequence[int] | None = UNUSED_STATIONS,
    period: tuple[str, str] = CLOSED_PERIOD, wide: bool = False,
) -> DataFrame:
    """Hourly totals by weekday (Monday = 0) and hour, of one station or all.

    Long form ``station_id, weekday, hours, value``; ``wide`` gives one column per hour.
    """
    if station_id is not None:
        df = df.where(F.col("station_id") == station_id)
    if filter_data:
        df = filter_periode(df, non_use_station_id, period)
    hourly = hourly_totals(df, feature_to_plot).withColumns(
        {"weekday": F.weekday("date"), "hours": F.hour("date")}
    )
    value = _AGGREGATES[aggfunc](feature_to_plot)
    if wide:
        return hourly.groupBy("station_id", "weekday").pivot("hours", list(range(24))).agg(value)
    return hourly.groupBy("station_id", "weekday", "hours").agg(value.alias("value"))


def anomaly_groups(df: DataFrame, chunk: str = GRID_CHUNK) -> DataFrame:
    """Add ``anomaly_grp``: number of normal rows so far. Neighbouring anomalies share it."""
    normal = F.when(F.col("anomaly") == 1, 1).otherwise(0)
    return running_sum(df, normal, "anomaly_grp", "station_id", "date", chunk=chunk)


def anomaly_episodes(df: DataFrame, chunk: str = GRID_CHUNK) -> DataFrame:
    """Runs of anomalies per station: first and last date, and the station's highest bike count as box height."""
    grouped = anomaly_groups(df, chunk).where(F.col("anomaly") == -1)
    runs = grouped.groupBy("station_id", "anomaly_grp").agg(F.min("date").alias("min"), F.max("date").alias("max"))
    heights = df.groupBy("station_id").agg(F.max("available_bikes").alias("max_value"))
    return runs.join(heights, "station_id", "left")


def station_anomaly_report(
    df: DataFrame, models: DataFrame, station_id: int | None = None, start_date: str = "", end_date: str = "",
    with_score: bool = False, chunk: str = GRID_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Series and episodes of one station or all; features are built when missing."""
    if station_id is not None:
        df = df.where(F.col("station_id") == station_id)
    if RUN not in df.columns:
        df = add_movements_and_idle(df, chunk=chunk)
    # read by the series and twice by the episodes
    scored = settle(predict_anomalies_station(df, models, station_id, with_score))
    return anomaly_series(scored, start_date, end_date), anomaly_episodes(date_slice(scored, start_date, end_date), chunk)


def anomaly_series(scored: DataFrame, start_date: str = "", end_date: str = "") -> DataFrame:
    """Scored rows with ``ano_hover_text``: the bike count on anomalies, null elsewhere."""
    shown = F.when(F.col("anomaly") == -1, F.col("available_bikes"))
    return date_slice(scored, start_date, end_date).withColumn("ano_hover_text", shown)


def series_extent(df: DataFrame) -> DataFrame:
    """First and last date and highest bike count per station: the frame of the plot."""
    return df.groupBy("station_id").agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.max("available_bikes").alias("max_bikes")
    )


def station_map(control: DataFrame, since: str = "anomaly_since") -> DataFrame:
    """Station control table with state, colour and hover text (flat map)."""
    with_state = control.withColumns(
        {"etat": station_state(), "anomaly_since_str": F.coalesce(display_date(since), F.lit("-"))}
    )
    return with_state.withColumns({"colour": state_colour(), "text": hover_text()})


def station_map_layers(control: DataFrame, since: str = "anomaly_since") -> DataFrame:
    """Station control table for the tilted map: one placeholder per state added, ordered by state, nulls shown empty."""
    with_state = control.withColumns({"etat": station_state(), "anomaly_since_str": display_date(since)})
    columns = [
        "station_id", "mean_activity", "is_anomaly", "is_inactive", "available_bikes", "lat", "lon", "NOM", "etat",
        "anomaly_since_str",
    ]
    stations = with_state.select(*columns)
    legend = control.sparkSession.createDataFrame(list(LEGEND_STATIONS), stations.schema)
    layered = stations.unionByName(legend).withColumn("etat_id_sort", state_rank())
    text = {"NOM": F.coalesce("NOM", F.lit("")), "anomaly_since_str": F.coalesce("anomaly_since_str", F.lit(""))}
    return layered.withColumns(text).orderBy("etat_id_sort", "station_id")
