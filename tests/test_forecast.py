from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from dockflow.models.forecast import (
    get_feature_to_use_for_model,
    get_prediction_station,
    make_prediction_for_user,
    parse_request,
    train_model_for_station,
)
from dockflow.operators.lookups import create_target
from dockflow.operators.rolling import WINDOWS, build_feat_for_regression, build_lag_and_rolling_feat

from tests.helpers import frame, seeded_history, values

SCHEMA = "station_id int, date timestamp_ntz, available_stands int, available_bikes int"


@pytest.fixture(scope="module")
def history(spark):
    return frame(spark, seeded_history(), SCHEMA)


@pytest.mark.parametrize(
    "station, column, horizon, first, last",
    [(101, "available_stands", "20m", [13, 8, 8, 17, 1], [14, 1, 14, None, None]),
     (101, "available_bikes", "20m", [8, 2, 11, 18, 1], [18, 2, 15, None, None]),
     (102, "available_stands", "30m", [16, 8, 0, 9, 4], [19, 10, None, None, None]),
     (102, "available_bikes", "30m", [0, 15, 8, 13, 17], [18, 11, None, None, None])],
)
def test_target(history, station, column, horizon, first, last):
    got = values(create_target(history, column, horizon).where(f"station_id = {station}"), "target")
    assert got[:5] == first and got[-5:] == last


def test_target_skips_gaps(spark):
    base = datetime(2024, 1, 1)
    rows = [(1, base + timedelta(minutes=m), m) for m in (0, 10, 30, 40)]
    df = spark.createDataFrame(rows, "station_id int, date timestamp_ntz, v int")
    assert values(create_target(df, "v", "20m"), "target") == [None, 30, None, None]


def test_feature_list():
    names = get_feature_to_use_for_model("available_bikes")
    assert len(names) == 17
    assert names[:7] == ["Sin_weekday", "Cos_weekday", "Sin_hours", "Cos_hours", "Sin_minutes", "Cos_minutes", "available_bikes_lag_1"]
    assert names[9:] == [f"available_bikes_rolling_{s}_{w}" for s in ("max", "min") for w in ("6", "12", "1d", "7d")]


def test_feature_values(history):
    built = build_feat_for_regression(history, "available_bikes").where("station_id = 102").orderBy("date")
    rows = built.select(*get_feature_to_use_for_model("available_bikes")).tail(2)
    # The last two rows of the seeded station.
    expected = [
        (0.7818314824680298, 0.6234898018587336, -0.25881904510252157, 0.9659258262890681, -0.8660254037844355,
         -0.5000000000000056, 15, 10, 14, 18, 18, 19, None, 10, 1, 0, None),
        (0.7818314824680298, 0.6234898018587336, -0.25881904510252157, 0.9659258262890681, 0.8660254037844408,
         -0.49999999999999617, 18, 15, 10, 18, 18, 19, None, 10, 1, 0, None),
    ]
    for row, want in zip(rows, expected):
        for got, value in zip(row, want):
            assert got == value if value is None else got == pytest.approx(value, rel=1e-5)


@pytest.mark.parametrize("block", [1008, 1100, 3024])
def test_rolling_against_pandas(spark, block):
    rng = np.random.default_rng(1)
    parts = []
    for station, n in ((1, 2600), (2, 1009), (3, 5)):
        keep = np.sort(rng.choice(n * 2, n, replace=False))
        v = rng.integers(0, 40, n).astype(float)
        v[rng.random(n) < 0.001] = np.nan
        parts.append(pd.DataFrame({"station_id": station, "date": [datetime(2024, 1, 1) + timedelta(minutes=10 * int(i)) for i in keep], "v": v}))
    pdf = pd.concat(parts, ignore_index=True)
    df = frame(spark, pdf, "station_id int, date timestamp_ntz, v bigint")
    got = build_lag_and_rolling_feat(df, "v", block=block, chunk="1d").orderBy("station_id", "date").toPandas()
    assert len(got) == len(pdf)
    by = pdf.groupby("station_id")["v"]
    for n in (1, 2, 3):
        np.testing.assert_array_equal(got[f"v_lag_{n}"].to_numpy(dtype=float), by.shift(n).to_numpy())
    for suffix, rows in WINDOWS.items():
        for side in ("max", "min"):
            want = by.transform(lambda s: getattr(s.rolling(rows, min_periods=rows), side)())
            np.testing.assert_array_equal(got[f"v_rolling_{side}_{suffix}"].to_numpy(dtype=float), want.to_numpy())


def test_block_must_hold_the_longest_window(history):
    with pytest.raises(ValueError):
        build_lag_and_rolling_feat(history, "available_bikes", block=100)


def test_forecast(history):
    features = get_feature_to_use_for_model("available_bikes")
    station = history.where("station_id = 102")
    ready = build_feat_for_regression(create_target(station, "available_bikes", "30m"), "available_bikes").cache()
    model = train_model_for_station(ready, features)
    assert model.getNumTrees == 50 and max(t.depth for t in model.trees) <= 6
    row = make_prediction_for_user(ready, "30m", model, features).collect()[0]
    assert row.date == datetime(2025, 3, 4, 0, 20)
    assert 7 <= row.y_pred <= 12
    assert row.weekday == 2 and row.hours == 0 and row.minutes == 20
    again = make_prediction_for_user(ready, "30m", train_model_for_station(ready, features), features, return_df=False)
    assert again == row.y_pred


def test_request(history):
    text = "target_station_id=102,target_col=available_bikes,horizon_prediction=10m"
    assert parse_request(text) == {"target_station_id": "102", "target_col": "available_bikes", "horizon_prediction": "10m"}
    assert parse_request({"a": "b"}) == {"a": "b"}
    row = get_prediction_station(history, text).collect()[0]
    assert row.station_id == 102 and row.date == datetime(2025, 3, 4, 0, 0) and 0 <= row.y_pred <= 19
