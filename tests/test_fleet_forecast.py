"""The forecast of all stations in one job."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockflow.models import fleet_forecast as ff
from dockflow.models import histogram_forest as hf
from dockflow.models.forecast import get_prediction_station
from tests.helpers import frame, seeded_history


FEATURES = ["a", "b", "c"]
ROWS = "station_id int, date timestamp_ntz, asked boolean, target double, a double, b double, c double"


def training(spark, n=400, stations=(1, 2, None), seed=6, rule=lambda a, b, c: 20.0 if b > 3 else 5.0):
    rng = np.random.default_rng(seed)
    rows = []
    for station in stations:
        for i in range(n):
            x = [float(v) for v in rng.integers(0, 6, size=3)]
            rows.append((station, datetime(2025, 3, 1) + timedelta(minutes=10 * i), False, rule(*x), *x))
        rows.append((station, datetime(2025, 9, 1), True, None, 0.0, 5.0, None))
    return spark.createDataFrame(rows, ROWS)


def test_bins_and_draws(spark):
    values = [None, 0.0, 1.0, 31.0, 63.0, 64.0, -5.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(1)
    got = [r[0] for r in df.select(hf.bin_of(F.col("v"), F.lit(0.0), F.lit(63.0))).collect()]
    assert got == [0, 1, 2, 32, 64, 64, 1]
    assert df.select(hf.bin_of(F.col("v"), F.lit(1.0), F.lit(1.0)).alias("b")).where("b > 1").count() == 0
    rows = hf.prepared(training(spark), FEATURES).collect()
    drawn = np.array([r.draws for r in rows])
    assert drawn.shape[1] == 50 and abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.05
    assert sum(bin(hf.allowed_features(1, t, 0, 17)).count("1") for t in range(200)) / 200 / 17 == pytest.approx(0.75, abs=0.03)


def test_first_split_is_the_best_of_all(spark):
    df = training(spark, 60, (1,), rule=lambda a, b, c: 3 * a + (b - 2) ** 2 - c)
    rows = hf.prepared(df, FEATURES, trees=8)
    histogram = hf.level_histogram(rows, 0, 3, trees=8)
    got = {r.tree: r for r in hf.best_splits(histogram).collect()}
    facts = [r for r in rows.collect() if not r.asked]
    for tree in range(8):
        mask = hf.allowed_features(hf.SEED, tree, 0, 3)
        x = np.array([r.bins for r in facts for _ in range(r.draws[tree])])
        y = np.array([r.target for r in facts for _ in range(r.draws[tree])])
        gains = {}
        for f in range(3):
            for cut in np.unique(x[:, f])[:-1] if mask >> f & 1 else []:
                left = x[:, f] <= cut
                gains[f, int(cut)] = ((y - y.mean()) ** 2).sum() - sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, ~left))
        assert max(gains.values()) == pytest.approx(got[tree].gain, abs=1e-4)
        assert gains[got[tree].feature, got[tree].cut] == pytest.approx(got[tree].gain, abs=1e-4)


def test_rows_follow_the_splits(spark):
    rows = hf.prepared(training(spark, 50, (1, None)), FEATURES, trees=4)
    splits = hf.best_splits(hf.level_histogram(rows, 0, 3, trees=4))
    cuts = {(r.station_id, r.tree): (r.feature, r.cut) for r in splits.collect()}
    moved = hf.next_level(rows, splits, 0).collect()
    assert len(moved) == 102
    for r in moved:
        for tree, node in enumerate(r.nodes):
            f, cut = cuts.get((r.station_id, tree), (None, None))
            assert node == (0 if f is None else 1 + (r.bins[f] > cut))


def test_a_rule_is_learned_whatever_the_partitioning(spark):
    df = training(spark)
    got = {r.station_id: r.answer for r in hf.forest_answers(df, FEATURES).collect()}
    assert set(got) == {1, 2, None} and all(abs(v - 20) <= 1.5 for v in got.values())
    again = {r.station_id: r.answer for r in hf.forest_answers(df.repartition(7, "b"), FEATURES).collect()}
    assert again == got


def test_no_task_holds_a_station(spark):
    """Histograms are aggregates with partial sums; no rows of a station are gathered, and no Python worker runs."""
    rows = hf.prepared(training(spark), FEATURES)
    plan = hf.best_splits(hf.level_histogram(rows, 2, 3))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("HashAggregate") + plan.count("SortAggregate") >= 4


def test_every_station_in_one_job(spark):
    pdf = seeded_history()
    schema = "station_id int, date timestamp_ntz, available_stands bigint, available_bikes bigint"
    history = frame(spark, pdf, schema)
    short = spark.createDataFrame([(7, datetime(2025, 3, 1), 3, 4), (None, datetime(2025, 3, 1), 3, 4)], schema)
    out = ff.forecast_all(history.unionByName(short), "available_bikes", "30m").collect()
    rows = {r.station_id: r for r in out}
    assert len(out) == 4 and rows[7].y_pred is None and rows[7].date == datetime(2025, 3, 1, 0, 30)
    single = get_prediction_station(history, "target_station_id=102,target_col=available_bikes,horizon_prediction=30m").collect()[0]
    assert rows[102].date == single.date == datetime(2025, 3, 4, 0, 20)
    assert 0 <= rows[101].y_pred <= 19 and abs(rows[102].y_pred - single.y_pred) <= 3
    again = {r.station_id: r.y_pred for r in ff.forecast_all(history.repartition(5), "available_bikes", "30m").collect()}
    assert again[101] == rows[101].y_pred and again[102] == rows[102].y_pred


def test_the_daily_wave_is_forecast(spark):
    start = datetime(2024, 5, 6)
    rows = [(s, start + timedelta(minutes=10 * i), 20, 15 if (i // 6) % 24 < 12 else 3) for s in (1, 2) for i in range(144 * 12)]
    history = spark.createDataFrame(rows, "station_id int, date timestamp_ntz, available_stands bigint, available_bikes bigint")
    for horizon, want in (("10m", 15), ("1h", 15)):  # the newest row, at 23:50, holds 3
        out = ff.forecast_all(history, "available_bikes", horizon).collect()
        assert [abs(r.y_pred - want) <= 1 for r in out] == [True, True]
