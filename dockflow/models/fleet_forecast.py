"""Forecast of bikes or stands of every station in one job.

Features are built for all stations at once, the forests of all stations grow from one set of histograms (``histogram_forest``),
and each station's newest row is answered by its own forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.calendar import process_temporal_feat
from dockflow.functions.durations import offset_by
from dockflow.models.forecast import get_feature_to_use_for_model
from dockflow.models.histogram_forest import DEPTH, TREES, forest_answers
from dockflow.operators.filters import latest_rows
from dockflow.operators.grid import deduplicate
from dockflow.operators.lookups import create_target
from dockflow.operators.rolling import build_feat_for_regression
from dockflow.schemas import SEED
from dockflow.session import settle


def forecast_inputs(history: DataFrame, target_col: str, horizon_prediction: str) -> DataFrame:
    """Rows of all stations with the forecast's features; ``asked`` marks the rows to answer for, at the horizon's calendar."""
    ready = settle(build_feat_for_regression(create_target(history, target_col, horizon_prediction), target_col))
    features = get_feature_to_use_for_model(target_col)
    newest = latest_rows(ready, scope="station").withColumn("date", offset_by("date", horizon_prediction))
    ask = process_temporal_feat(newest, "date").withColumn("asked", F.lit(True))
    known = ready.where(F.col("target").isNotNull()).withColumn("asked", F.lit(False))
    columns = ["station_id", "date", "asked", F.col("target").cast("double").alias("target"), *[F.col(f).cast("double").alias(f) for f in features]]
    return known.select(*columns).unionByName(deduplicate(ask.select(*columns)))


def forecast_all(
    history: DataFrame, target_col: str, horizon_prediction: str, seed: int = SEED, trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """``station_id``, ``date`` and ``y_pred`` (rounded) for every station; null where a station has no row to learn from."""
    inputs = forecast_inputs(history, target_col, horizon_prediction)
    answers = forest_answers(inputs, get_feature_to_use_for_model(target_col), seed, trees, depth)
    return answers.select("station_id", "date", F.floor(F.col("answer") + 0.5).cast("int").alias("y_pred"))
