"""Forecast of bikes or stands of one station at a horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.calendar import process_temporal_feat
from dockflow.functions.durations import offset_by
from dockflow.operators.filters import labelled_rows, latest_rows
from dockflow.operators.lookups import create_target
from dockflow.operators.rolling import LAGS, WINDOWS, build_feat_for_regression
from dockflow.schemas import SEED
from dockflow.session import settle

#: Counts are never negative, so this puts "no value yet" below all values.
MISSING = -1.0


def get_feature_to_use_for_model(target_col: str) -> list[str]:
    """Ordered list of the forecast's features."""
    time = [f"{wave}_{part}" for part in ("weekday", "hours", "minutes") for wave in ("Sin", "Cos")]
    lags = [f"{target_col}_lag_{n}" for n in LAGS]
    rolls = [f"{target_col}_rolling_{side}_{suffix}" for side in ("max", "min") for suffix in WINDOWS]
    return time + lags + rolls


def _vector(features: Sequence[str]):
    return array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features]))


def train_model_for_station(df: DataFrame, feat_to_use: Sequence[str], seed: int = SEED) -> RandomForestRegressionModel:
    """Random forest on the rows that have a target; training is distributed over the rows."""
    train = labelled_rows(df).select(_vector(feat_to_use).alias("features"), F.col("target").cast("double"))
    forest = RandomForestRegressor(
        labelCol="target", maxDepth=6, numTrees=50, featureSubsetStrategy="0.75", seed=seed
    )
    return forest.fit(train)


def make_prediction_for_user(
    df: DataFrame, horizon_prediction: str, model: RandomForestRegressionModel, feat_to_use: Sequence[str],
    return_df: bool = True, date: str = "date",
) -> DataFrame | int:
    """Forecast from the newest row: its lags and rolling values, the calendar of the horizon, ``y_pred`` rounded."""
    newest = latest_rows(df, date=date).withColumn(date, offset_by(date, horizon_prediction))
    ready = process_temporal_feat(newest, date).withColumn("_features", _vector(feat_to_use))
    predicted = model.setFeaturesCol("_features").setPredictionCol("y_pred").transform(ready)
    out = predicted.withColumn("y_pred", F.round("y_pred").cast("int")).drop("_features")
    return out if return_df else out.select("y_pred").head()[0]


def parse_request(params: dict | str) -> dict[str, str]:
    """``"target_station_id=102,target_col=available_bikes,horizon_prediction=30m"`` as a dictionary."""
    if isinstance(params, dict):
        return dict(params)
    pairs = (item.split("=", 1) for item in params.split(","))
    return {name.strip(): value.strip() for name, value in pairs}


def get_prediction_station(history: DataFrame, params: dict | str, return_df: bool = True) -> DataFrame | int:
    """Answer one forecast request: the station filter reaches the scan, then target, features, training, forecast."""
    request = parse_request(params)
    target_col, horizon = request["target_col"], request["horizon_prediction"]
    station = history.where(F.col("station_id") == int(request["target_station_id"]))
    features = get_feature_to_use_for_model(target_col)
    labelled = create_target(station, target_col, horizon)
    ready = settle(build_feat_for_regression(labelled, target_col))
    model = train_model_for_station(ready, features)
    return make_prediction_for_user(ready, horizon, model, features, return_df)
