from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockflow.operators import filters
from dockflow.operators.lookups import extreme_stations, find_nearest_stations, get_meteo, with_profile
from dockflow.operators.profile import activity_statistics, calculate_breakpoints, cut, idle_percentile
from dockflow.plans.learning import create_station_profilage_activity
from dockflow.sources.readers import read_station_profile

from tests.helpers import frame
from tests.test_movement import SCHEMA, random_activity


def test_closed_period(spark):
    days = [datetime(2020, 3, 16), datetime(2020, 3, 17), datetime(2020, 5, 13), datetime(2020, 5, 14), datetime(2020, 5, 15)]
    df = spark.createDataFrame(list(zip(days, range(1, 6))), "date timestamp_ntz, station_id int")
    assert [r.station_id for r in filters.filter_periode(df, [4]).orderBy("station_id").collect()] == [1, 5]
    assert filters.filter_periode(df, []).count() == 3


def test_cut(spark):
    df = spark.createDataFrame([(v,) for v in range(1, 11)], "value int")
    assert [r.breakpoint for r in calculate_breakpoints(df, "value", 4).orderBy("bin").collect()] == [3.25, 5.5, 7.75]
    labels = [r.label for r in cut(df, "value", "label").orderBy("value").collect()]
    assert labels == ["low"] * 3 + ["medium"] * 2 + ["hight"] * 2 + ["very high"] * 3
    assert labels == pd.cut(pd.Series(range(1, 11)), 4, labels=["low", "medium", "hight", "very high"]).tolist()


def test_border_belongs_to_the_lower_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    got = {r.v: r.label for r in cut(df, "v", "label").collect()}
    assert got == {0.0: "low", 1.0: "low", 2.0: "medium", 3.0: "hight", 4.0: "very high", None: None}


@pytest.mark.parametrize("n", [1, 2, 7, 40, 101])
def test_statistics(spark, n):
    rng = np.random.default_rng(n)
    for ones in (0, n // 2, max(n - 1, 0), n):
        bits = np.zeros(n, dtype=int)
        bits[:ones] = 1
        rng.shuffle(bits)
        df = spark.createDataFrame([(1, int(b)) for b in bits] + [(1, None)], "station_id int, transactions_out_bool bigint")
        row = activity_statistics(df).collect()[0]
        ordered = np.sort(bits)
        assert row.total_point == n and row["max"] == bits.max()
        assert row["mean"] == pytest.approx(bits.mean())
        assert row["median"] == np.median(bits)
        for q, name in ((0.95, "95%"), (0.98, "98%"), (0.99, "99%")):
            assert row[name] == ordered[int(np.floor((n - 1) * q + 0.5))]
        if n > 1:
            assert row["std"] == pytest.approx(bits.std(ddof=1))


def rank_percentile(values, limit):
    values = np.asarray(values)
    below, upto = (values < limit).sum(), (values <= limit).sum()
    return (below + upto + (upto > below)) * 50.0 / len(values)


def test_percentile(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 300)
    df = spark.createDataFrame([(int(i % 2), int(v)) for i, v in enumerate(values)], "station_id int, run int")
    got = {r.station_id: r.percentile for r in idle_percentile(df, F.lit(36), "run").collect()}
    assert got == {s: pytest.approx(rank_percentile(values[s::2], 36)) for s in (0, 1)}
    counted = df.groupBy("station_id", "run").agg(F.count("*").alias("n"))
    same = {r.station_id: r.percentile for r in idle_percentile(counted, F.lit(36), "run", weight="n").collect()}
    assert same == got


def test_station_profile(spark, tmp_path):
    pdf = pd.concat([random_activity(seed=9, stations=3, quiet=0.5), random_activity(seed=10, stations=3, quiet=0.95).assign(
        station_id=lambda d: d.station_id + 10)])
    made = create_station_profilage_activity(frame(spark, pdf, SCHEMA), str(tmp_path / "p"), max_idle=5, chunk="1d")
    rows = made.collect()
    assert [r["mean"] for r in rows] == sorted(r["mean"] for r in rows)
    assert rows[0].profile_station_activity == "low" and rows[-1].profile_station_activity == "very high"
    back = read_station_profile(spark, str(tmp_path / "p"))
    assert {r.station_id: r.total_point for r in back.collect()} == {r.station_id: r.total_point for r in rows}


def test_snapshots(spark):
    base = datetime(2024, 1, 1)
    rows = [(1, base, 3), (1, base + timedelta(hours=1), 5), (2, base, 9), (3, base + timedelta(hours=1), 1)]
    df = spark.createDataFrame(rows, "station_id int, date timestamp_ntz, available_bikes int")
    assert {r.station_id for r in filters.latest_rows(df).collect()} == {1, 3}
    per = filters.latest_rows(df, scope="station")
    assert {(r.station_id, r.available_bikes) for r in per.collect()} == {(1, 5), (2, 9), (3, 1)}
    with pytest.raises(ValueError):
        filters.latest_rows(df, scope="other")
    with pytest.raises(ValueError):
        filters.require_station(df, 77)


# The six stations of the snapshot questions.
SIX = [
    (1, "Meriadeck", 10, 20, 44.83803, -0.58437, 1), (2, "St Bruno", 5, 15, 44.83784, -0.59028, 1),
    (3, "Piscine Judaique", 15, 5, 44.840813, -0.593233, 1), (4, "St Seurin", 2, 18, 44.84221, -0.58482, 1),
    (5, "Place Gambetta", 8, 12, 44.840714, -0.581124, 1), (6, "Square Andre Lhote", 0, 19, 44.83779, -0.58166, -1),
]


def test_station_questions(spark):
    df = spark.createDataFrame(
        SIX, "station_id int, station_name string, available_stands int, available_bikes int, lat double, lon double, anomaly int")
    assert df.agg(F.countDistinct("station_id")).collect()[0][0] == 6
    assert extreme_stations(df).collect()[0].station_name == "Meriadeck"
    assert extreme_stations(df, most=False).collect()[0].station_name == "Piscine Judaique"
    assert [r.station_name for r in filters.stations_in_anomaly(df).collect()] == ["Square Andre Lhote"]
    near = find_nearest_stations(df, 44.840714, -0.581124, 3)
    assert [r.station_id for r in near.collect()] == [5, 6, 4]
    assert near.collect()[0].distance == 0
    assert [r.station_id for r in find_nearest_stations(df, 44.840714, -0.581124, 3, method="haversine").collect()] == [5, 6, 4]
    assert filters.named_stations(df, "place", exact=False).collect()[0].station_id == 5
    assert filters.map_focus(df).collect()[0][:] == (44.837794, -0.581662, 11.0)
    assert filters.map_focus(df, 3, 15.3).collect()[0][:] == (44.840813, -0.593233, 15.3)


def test_weather(spark):
    data = spark.createDataFrame([(1, datetime(2020, 9, 17, 19, 40)), (1, datetime(2020, 9, 17, 21, 0))], "station_id int, date timestamp_ntz")
    meteo = spark.createDataFrame([(datetime(2020, 9, 17, 19), 26.4)], "date timestamp_ntz, temperature double")
    assert {(r.date.hour, r.temperature) for r in get_meteo(data, meteo).collect()} == {(19, 26.4), (21, None)}


def test_profile_lookup(spark):
    df = spark.createDataFrame([(1,), (2,)], "station_id int")
    prof = spark.createDataFrame([(1, "low")], "station_id int, profile_station_activity string")
    assert {tuple(r) for r in with_profile(df, prof).collect()} == {(1, "low"), (2, None)}
    assert {tuple(r) for r in with_profile(df, None, "medium").collect()} == {(1, "medium"), (2, "medium")}
    assert filters.monitored_stations(prof.withColumn("mean", F.lit(0.06)), non_use_station_id=[1]).count() == 0
