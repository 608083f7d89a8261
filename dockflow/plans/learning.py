"""Station profile and fleet training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.scalars import activity_bit
from dockflow.models.anomaly import RUN, train_cluster_station
from dockflow.operators.filters import filter_periode, monitored_stations, usable_rows
from dockflow.operators.grid import upsample
from dockflow.operators.movement import add_movements_and_idle, get_consecutive_no_transactions_out
from dockflow.operators.profile import activity_statistics, cut
from dockflow.operators.timeline import GRID_CHUNK
from dockflow.schemas import CLOSED_PERIOD, IDLE_LIMITS, MAX_IDLE_STEPS, MONITORED_MEAN, UNUSED_STATIONS
from dockflow.session import settle, spread
from dockflow.sources.writers import export_model, write_csv


def create_station_profilage_activity(
    activity: DataFrame, target: str | None = None, non_use_station_id: Sequence[int] | None = UNUSED_STATIONS,
    period: tuple[str, str] = CLOSED_PERIOD, max_idle: int = MAX_IDLE_STEPS, chunk: str = GRID_CHUNK, steps: str | None = None,
) -> DataFrame:
    """Activity profile of every station with its label, least active first; written as CSV when asked.

    With ``steps``, the column that ``count_steps`` has made, a row stands for all steps up to the next; these are added last.
    """
    needed = activity.select("station_id", "date", "available_stands", "available_bikes", "status", *([steps] if steps else []))
    idle = add_movements_and_idle(needed, ["transactions_out"], chunk=chunk, steps=steps)
    if steps:
        # without a level there is no movement, on added steps neither
        moved = F.when(F.col("available_stands").isNotNull(), F.col("transactions_out"))
        idle = upsample(spread(idle, "station_id"), steps=steps).withColumn("transactions_out", moved)
    usable = usable_rows(filter_periode(idle, non_use_station_id, period), max_idle)
    stats = activity_statistics(usable.select("station_id", activity_bit().alias("transactions_out_bool")))
    # one row per station, read three times by the labelling: computed once
    profile = cut(settle(stats), "mean").orderBy("mean", "station_id")
    if target is not None:
        write_csv(profile, target)
    return profile


def run_train_cluster(
    activity: DataFrame, profile: DataFrame, target: str | None = None, threshold: float = MONITORED_MEAN,
    non_use_station_id: Sequence[int] | None = UNUSED_STATIONS, rules: Mapping[str, int] = IDLE_LIMITS,
    chunk: str = GRID_CHUNK, **options,
) -> DataFrame:
    """Fit the detector of every monitored station in one job; the model table is written when asked.

    ``activity`` is grid data with ``transactions_out``, as the learning dataset has it; the idle run is added
    when missing.
    """
    wanted = monitored_stations(profile, threshold, non_use_station_id)
    if RUN in activity.columns:
        rows = activity.select("station_id", "date", "status", RUN).join(wanted, "station_id", "left_semi")
    else:
        # the columns of the idle run and no others: its two branches then share one shuffle of the rows
        needed = ["station_id", "date", "available_stands", "available_bikes", "status", "transactions_out"]
        rows = activity.select(*needed).join(wanted, "station_id", "left_semi")
        rows = get_consecutive_no_transactions_out(rows, chunk=chunk)
    models = train_cluster_station(rows, profile=profile, rules=rules, non_use_station_id=non_use_station_id, **options)
    if target is not None:
        export_model(models, target)
        return activity.sparkSession.read.parquet(target)
    return models
