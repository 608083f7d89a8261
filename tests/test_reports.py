from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from dockflow.plans.reports import (
    activity_heatmap,
    anomaly_episodes,
    anomaly_groups,
    anomaly_series,
    series_extent,
    station_activity,
    station_map,
    station_map_layers,
)

from tests.helpers import values

BASE = datetime(2024, 1, 1)


def flagged(spark, flags, station=1):
    rows = [(station, BASE + timedelta(minutes=10 * i), i, f) for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "station_id int, date timestamp_ntz, available_bikes int, anomaly int")


@pytest.mark.parametrize("chunk", ["10m", "30m", "7d"])
def test_episodes(spark, chunk):
    flags = [1, -1, -1, 1, 1, -1, 1, -1, -1, -1]
    df = flagged(spark, flags).unionByName(flagged(spark, [-1, -1, 1], station=2))
    assert values(anomaly_groups(df, chunk), "anomaly_grp") == [1, 1, 1, 2, 3, 3, 4, 4, 4, 4] + [0, 0, 1]
    got = sorted((r.station_id, (r["min"] - BASE).seconds // 600, (r["max"] - BASE).seconds // 600, r.max_value)
                 for r in anomaly_episodes(df, chunk).collect())
    assert got == [(1, 1, 2, 9), (1, 5, 5, 9), (1, 7, 9, 9), (2, 0, 1, 2)]


def test_series(spark):
    df = flagged(spark, [1, -1, 1, -1])
    out = anomaly_series(df, "2024-01-01 00:10:00", "2024-01-01 00:20:00")
    assert values(out, "ano_hover_text") == [1, None]
    assert series_extent(df).collect()[0][1:] == (BASE, BASE + timedelta(minutes=30), 3)


def test_station_activity(spark):
    df = flagged(spark, [1, -1, 1, -1]).withColumnRenamed("available_bikes", "available_stands")
    assert station_activity(df, 1, start_date="2024-01-01 00:10:00").columns == ["station_id", "date", "available_stands"]
    assert station_activity(df, 1, end_date="2024-01-01 00:10:00").count() == 2
    with pytest.raises(ValueError):
        station_activity(df, 9)
    with pytest.raises(TypeError):
        station_activity(df, 1, "available_stands")


@pytest.mark.parametrize("how", ["mean", "sum", "median", "max", "min", "std", "count"])
def test_heatmap_against_pandas(spark, how):
    rng = np.random.default_rng(0)
    rows = [(1, BASE + timedelta(minutes=10 * int(i)), int(rng.integers(0, 5)), int(rng.random() < 0.9))
            for i in np.sort(rng.choice(6000, 2500, replace=False))]
    pdf = pd.DataFrame(rows, columns=["station_id", "date", "transactions_all", "status"])
    df = spark.createDataFrame(rows, "station_id int, date timestamp_ntz, transactions_all bigint, status int")
    hourly = pdf[pdf.status == 1].set_index("date").resample("h", label="right")["transactions_all"].sum().reset_index()
    want = hourly.assign(weekday=hourly.date.dt.weekday, hours=hourly.date.dt.hour).pivot_table(
        index="weekday", columns="hours", values="transactions_all", aggfunc=how)
    wide = activity_heatmap(df, "transactions_all", 1, how, wide=True).orderBy("weekday").toPandas()
    got = wide.drop(columns=["station_id", "weekday"]).to_numpy(dtype=float)
    np.testing.assert_allclose(got, want.to_numpy(dtype=float))
    assert activity_heatmap(df, "transactions_all", aggfunc=how).count() == want.size


CONTROL = ("station_id int, mean_activity double, is_anomaly int, is_inactive int, available_bikes int, lat double, lon double, "
           "NOM string, last_date_anomaly timestamp_ntz, anomaly_since timestamp_ntz")


def test_maps(spark):
    rows = [(1, 0.4, 0, 0, 3, 44.8, -0.5, "A", None, None), (2, 0.4, 1, 0, 4, 44.8, -0.5, "B", BASE, BASE),
            (3, 0.01, 0, 0, 5, 44.8, -0.5, None, None, None)]
    df = spark.createDataFrame(rows, CONTROL)
    flat = {r.station_id: r for r in station_map(df).collect()}
    assert [flat[i].etat for i in (1, 2, 3)] == ["normal", "anomaly", "non surveillée"]
    assert flat[2].anomaly_since_str == "2024-01-01 00:00" and flat[1].anomaly_since_str == "-"
    renamed = station_map(df.withColumnRenamed("anomaly_since", "En anomalie depuis"), since="En anomalie depuis")
    assert {r.anomaly_since_str for r in renamed.collect()} == {"-", "2024-01-01 00:00"}
    layers = station_map_layers(df).collect()
    assert [r.etat_id_sort for r in layers] == [0, 0, 1, 1, 2, 2, 3]
    assert {r.station_id for r in layers} == {1, 2, 3, 990, 991, 992, 993}
    assert [r.NOM for r in layers if r.station_id == 3] == [""]
