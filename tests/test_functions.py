import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockflow.functions.calendar import (
    display_date,
    get_encoding_time,
    naive_timestamp,
    offset_instant,
    process_data_cluster,
    process_temporal_feat,
    zone_wall_clock,
)
from dockflow.functions.durations import duration_seconds, offset_by, parse_duration
from dockflow.functions.geo import ellipsoid_km, geodesic_km, get_distance, ride_minutes
from dockflow.functions.scalars import (
    activity_bit,
    anomaly_probability,
    hover_text,
    parameter_map,
    point_part,
    state_code,
    state_colour,
    state_rank,
    station_state,
    status_flag,
)
from dockflow.schemas import ARRAY_STATUS, GEOJSON_STATUS


def one(df):
    return df.collect()[0][0]


@pytest.mark.parametrize(
    "text, months, micros",
    [("30m", 0, 1_800_000_000), ("2h10m", 0, 7_800_000_000), ("1mo", 1, 0), ("1y2q", 18, 0), ("1w", 0, 604_800_000_000),
     ("-1d", 0, -86_400_000_000), ("5ms3us", 0, 5003), ("2500ns", 0, 2)],
)
def test_durations(text, months, micros):
    assert parse_duration(text) == (months, micros)


@pytest.mark.parametrize("text", ["", "m", "10", "10 minutes", "1x"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_duration_seconds():
    assert duration_seconds("10m") == 600
    with pytest.raises(ValueError):
        duration_seconds("1mo")


def test_offset_by(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31, 23, 50),)], "date timestamp_ntz")
    row = df.select(offset_by("date", "1mo"), offset_by("date", "2h10m"), offset_by("date", "-1y"), offset_by("date", "500ms"))
    assert row.collect()[0][:] == (
        datetime(2024, 2, 29, 23, 50), datetime(2024, 2, 1, 2, 0), datetime(2023, 1, 31, 23, 50),
        datetime(2024, 1, 31, 23, 50, 0, 500000))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Paris"])
def test_offset_texts_do_not_depend_on_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-05-06T12:20:00+02:00", "2024-05-06T10:20:00Z", "2024-10-27T02:30:00+02:00", "2024-10-27T02:30:00+01:00",
                 "2024-03-10T02:30:00-0500"]
        df = spark.createDataFrame([(t,) for t in texts], "time string")
        got = df.select(zone_wall_clock("time").alias("d"), offset_instant("time").alias("i"), display_date("d")).collect()
        assert [r.d for r in got] == [datetime(2024, 5, 6, 12, 20)] * 2 + [datetime(2024, 10, 27, 2, 30)] * 2 + [
            datetime(2024, 3, 10, 8, 30)]
        assert got[3].i - got[2].i == 3600
        assert got[0][2] == "2024-05-06 12:20"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_naive_timestamp(spark):
    df = spark.createDataFrame([("2020-10-14T08:15:30",)], "ts string")
    assert one(df.select(naive_timestamp("ts"))) == datetime(2020, 10, 14, 8, 15, 30)


@pytest.mark.parametrize("name, top, numbers", [("quarter", 4, range(1, 5)), ("weekday", 7, range(7)), ("hours", 24, range(24))])
def test_encoding(spark, name, top, numbers):
    df = get_encoding_time(spark.createDataFrame([(n,) for n in numbers], f"{name} int"), name, max_val=top)
    for row in df.collect():
        angle = 2 * np.pi * row[name] / top
        assert row[f"Sin_{name}"] == pytest.approx(math.sin(angle), abs=1e-12)
        assert row[f"Cos_{name}"] == pytest.approx(math.cos(angle), abs=1e-12)


def test_calendar_conventions(spark):
    df = spark.createDataFrame([(datetime(2025, 3, 3, 23, 40),), (datetime(2025, 3, 9, 0, 0),)], "date timestamp_ntz")
    rows = process_temporal_feat(df).orderBy("date").collect()
    assert [r.weekday for r in rows] == [1, 7]
    assert rows[0].Sin_weekday == pytest.approx(0.7818314824680298)
    assert rows[0].Sin_minutes == pytest.approx(math.sin(2 * math.pi * 40 / 6))
    assert [r.quarter for r in process_data_cluster(df).collect()] == [1, 1]


def test_status_words(spark):
    words = ["CONNECTEE", "DECONNECTEE", "MAINTENANCE", "AUTRE CHOSE ???", None]
    df = spark.createDataFrame([(w,) for w in words], "etat string")
    assert [r[0] for r in df.select(status_flag("etat", GEOJSON_STATUS)).collect()] == [1, 0, 0, 0, 0]
    assert [r[0] for r in df.select(status_flag(F.lit("open"), ARRAY_STATUS)).collect()] == [1] * 5
    coded = df.select(state_code("etat", {"CONNECTEE": 1, "DECONNECTEE": 0})).collect()
    assert [r[0] for r in coded] == ["1", "0", "MAINTENANCE", "AUTRE CHOSE ???", None]


def test_activity_bit(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (-2,), (None,)], "transactions_out bigint")
    assert [r[0] for r in df.select(activity_bit()).collect()] == [0, 1, 1, 0, None]


def test_states(spark):
    rows = [(0.5, 0, 0), (0.01, 0, 0), (0.01, 1, 0), (0.01, 1, 1), (0.06, 0, 0), (None, 0, 0)]
    df = spark.createDataFrame(rows, "mean_activity double, is_anomaly int, is_inactive int")
    got = df.select(station_state().alias("etat")).select("etat", state_colour(), state_rank()).collect()
    assert [r[0] for r in got] == ["normal", "non surveillée", "anomaly", "inactive", "normal", "normal"]
    assert [r[1] for r in got][:4] == ["#6DDE75", "#696A6A", "#EB4D50", "#5E9BE6"]
    assert [r[2] for r in got][:4] == [1, 0, 2, 3]


def test_hover_text(spark):
    df = spark.createDataFrame([("Meriadeck", 1, 20, "-")], "NOM string, station_id int, available_bikes int, anomaly_since_str string")
    assert one(df.select(hover_text())) == (
        "Meriadeck <br />station N° : 1 <br />Nombre de vélo dispo : 20 <br />Activité suspecte depuis : -")


def test_texts(spark):
    df = spark.createDataFrame([("44.83803,-0.58437", "lat=44.8378, lon = -0.5792 ,k=3")], "p string, q string")
    row = df.select(point_part("p", 0), point_part("p", 1), parameter_map("q")).collect()[0]
    assert row[0] == 44.83803 and row[1] == -0.58437
    assert row[2] == {"lat": "44.8378", "lon": "-0.5792", "k": "3"}


def test_probability(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (-0.1,)], "d double")
    got = [r[0] for r in df.select(anomaly_probability("d")).collect()]
    assert got[0] == 0.5
    assert got[1] == pytest.approx(1 / (1 + math.exp(2)))
    assert got[2] == pytest.approx(1 / (1 + math.exp(-2)))


# Two documented pairs, and the station pair of the ride-time question.
ADDRESS = (44.8404215, -0.5704848)
BOURSE, PALAIS = (44.8402, -0.5718), (44.8378, -0.5704)


def test_distances(spark):
    df = spark.createDataFrame([(44.83803, -0.58437, 44.840714, -0.581124)], "a double, b double, c double, d double")
    row = df.select(get_distance("a", "b", "c", "d").alias("km"), geodesic_km("a", "b", "c", "d").alias("geo")).withColumn(
        "min", ride_minutes("km")).collect()[0]
    assert row["km"] == pytest.approx(0.393, abs=5e-4)
    assert row["min"] == pytest.approx(1.57, abs=5e-3)
    assert row["geo"] == pytest.approx(row["km"], rel=6e-3)


def test_ellipsoid():
    # A published geodesic (Flinders Peak to Buninyong, 54.972271 km on GRS80, same to the millimetre).
    km = ellipsoid_km([-37.951033417], [144.424867889], [-37.652821139], [143.926495528])
    assert km[0] == pytest.approx(54.972271, abs=1e-5)
    assert ellipsoid_km([10.0], [20.0], [10.0], [20.0])[0] == 0
    assert ellipsoid_km([0.0], [0.0], [0.0], [1.0])[0] == pytest.approx(111.319491, abs=1e-5)
    assert np.isfinite(ellipsoid_km([0.0], [0.0], [0.3], [179.9])[0])
    assert np.isnan(ellipsoid_km([np.nan], [0.0], [0.3], [1.0])[0])
