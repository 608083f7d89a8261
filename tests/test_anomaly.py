import hashlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dockflow.functions.calendar import process_data_cluster
from dockflow.models import anomaly, isolation
from dockflow.models.components import coordinates
from dockflow.plans.learning import run_train_cluster
from dockflow.schemas import DETECTOR_FEATURES
from dockflow.sources.writers import export_model, load_model

RUN = anomaly.RUN
SCHEMA = f"station_id int, date timestamp_ntz, status int, {RUN} bigint"


def station(station_id, days=119, start=datetime(2023, 5, 1), seed=0):
    """Idle runs that are short by day and longer at night, with a few outages of half a day."""
    rng = np.random.default_rng([seed, station_id])
    rows, run, out = [], 0, 0
    for i in range(days * 144):
        at = start + timedelta(minutes=10 * (i + 1))
        out = max(out - 1, 80 if rng.random() < 0.0006 else 0)
        busy = 0.12 if at.hour < 6 else 0.5
        run = 0 if out == 0 and rng.random() < busy else run + 1
        rows.append((station_id, at, 1, run))
    return rows


@pytest.fixture(scope="module")
def activity(spark):
    rows = station(106) + station(7, days=60) + [(8, datetime(2023, 5, 1), 1, 0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def models(activity):
    return anomaly.train_cluster_station(activity, profile_station_activity="very high").cache()


def usual(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def test_usual_path_and_tree_size(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 100, 256)], "n long").orderBy("n")
    got = df.select(isolation.usual_path(F.col("n")), isolation.tree_depth(F.col("n")), isolation.tree_nodes(F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([usual(n) for n in (0, 1, 2, 3, 100, 256)], abs=1e-9)
    assert [r[1] for r in got] == [1, 1, 1, 2, 7, 8] and [r[2] for r in got] == [3, 3, 3, 7, 255, 511]


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def trees_by_hand(points, counts, station, seed, trees, sample):
    """Drawn and grown row by row: {(tree, node): (feature, cut) or path}."""
    rows = [(i, copy) for i, n in enumerate(counts) for copy in range(1, n + 1)]
    size = min(sample, len(rows))
    depth, out = int(np.ceil(np.log2(max(size, 2)))), {}
    for tree in range(trees):
        at = (tree % 4) * 8
        ranked = sorted(rows, key=lambda r: (md5(seed, station, r[0], r[1], tree // 4)[at : at + 8], r))[:size]
        todo = [(0, 0, points[[i for i, _ in ranked]])]
        while todo:
            node, level, x = todo.pop()
            digits = md5(seed, station, tree, node)
            movable = [d for d in range(x.shape[1]) if x[:, d].max() > x[:, d].min()]
            if level == depth or not movable:
                out[tree, node] = level + usual(len(x))
                continue
            d = max(movable, key=lambda d: (digits[4 * d : 4 * d + 4], -d))
            low, high = x[:, d].min(), x[:, d].max()
            cut = low + int(md5(seed, station, tree, node, "cut")[:8], 16) / 2**32 * (high - low)
            out[tree, node] = (d, cut)
            todo += [(2 * node + 1, level + 1, x[x[:, d] <= cut]), (2 * node + 2, level + 1, x[x[:, d] > cut])]
    return out, size


def scores_by_hand(points, grown, trees, size):
    total = np.zeros(len(points))
    for i, x in enumerate(points):
        for tree in range(trees):
            node = 0
            while isinstance(grown[tree, node], tuple):
                d, cut = grown[tree, node]
                node = 2 * node + 1 + int(x[d] > cut)
            total[i] += grown[tree, node]
    return -(2.0 ** (-total / trees / usual(size)))


@pytest.mark.parametrize("sample", [256, 40])
def test_trees_and_scores_by_hand(spark, sample):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(90, 3)), 2)
    points[0] = 6.0
    counts = rng.integers(1, 9, 90)
    rows = [(s, i, int(n), int(counts.sum()), [float(v) for v in p]) for s in (7, 8) for i, (p, n) in enumerate(zip(points, counts))]
    df = spark.createDataFrame(rows, "station_id int, i int, rows long, total long, point array<double>")
    sizes = spark.createDataFrame([(s, min(sample, int(counts.sum()))) for s in (7, 8)], "station_id int, size int")
    drawn = isolation.draw(df, ["i"], 5, trees=6, sample=sample)
    assert {r[0] for r in drawn.groupBy("station_id", "tree").agg(F.sum("members")).select(F.col("sum(members)")).collect()} == {min(sample, counts.sum())}
    arrays = isolation.as_arrays(isolation.grow(drawn, sizes, 3, 5, sample), sizes, trees=6)
    models = {r.station_id: r for r in arrays.collect()}
    scored = df.join(arrays.join(sizes, "station_id"), "station_id")
    scored = scored.withColumn("_billionths", F.transform("path_length", lambda x: F.round(x * 1_000_000_000.0).cast("bigint")))
    scored = scored.select("station_id", "i", F.expr(isolation.score_sql("point", "size")).alias("score")).collect()
    for station in (7, 8):
        grown, size = trees_by_hand(points, counts, station, 5, 6, sample)
        nodes = 2 ** (int(np.ceil(np.log2(size))) + 1) - 1
        m = models[station]
        assert len(m.split_feature) == 6 * nodes
        found = {(k // nodes, k % nodes) for k, f in enumerate(m.split_feature) if f >= 0}
        assert found == {k for k, v in grown.items() if isinstance(v, tuple)}
        for (tree, node), v in grown.items():
            k = tree * nodes + node
            if isinstance(v, tuple):
                assert (m.split_feature[k], m.split_at[k]) == pytest.approx(v)
            else:
                assert m.path_length[k] == pytest.approx(v, abs=1e-8)
        wanted = scores_by_hand(points, grown, 6, size)
        got = {r.i: r.score for r in scored if r.station_id == station}
        np.testing.assert_allclose([got[i] for i in range(90)], wanted, atol=1e-8)
        assert wanted.argmin() == 0 and wanted.max() < 0


def test_counted_percentile(spark):
    rng = np.random.default_rng(3)
    values, counts = rng.normal(size=50).round(1), rng.integers(1, 6, 50)
    shares = (0.0, 0.013, 0.25, 0.5, 1.0)
    rows = [(k, float(v), int(n), share) for k, share in enumerate(shares) for v, n in zip(values, counts)]
    df = spark.createDataFrame(rows, "station_id int, value double, rows long, share double")
    got = isolation.counted_percentile(df, "value", "share").orderBy("station_id").collect()
    assert [r.threshold for r in got] == pytest.approx([np.percentile(np.repeat(values, counts), s * 100) for s in shares])


def test_moments(spark, activity):
    rows = activity.where("station_id = 7")
    got = anomaly.feature_moments(anomaly.count_combinations(rows)).collect()[0]
    x = process_data_cluster(rows).select(*DETECTOR_FEATURES).toPandas().to_numpy(dtype=float)
    assert got.rows == len(x)
    np.testing.assert_allclose(got["mean"], x.mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(got["covariance"], np.cov(x.T, ddof=0)[np.triu_indices(7)], atol=1e-8)


def test_components(activity):
    moments = anomaly.feature_moments(anomaly.count_combinations(activity.where("station_id = 106")))
    row = moments.select(anomaly.principal_components("mean", "covariance", "rows").alias("p")).collect()[0].p
    x = process_data_cluster(activity.where("station_id = 106")).select(*DETECTOR_FEATURES).toPandas().to_numpy(dtype=float)
    std = x.std(axis=0)
    scale = np.where(std < 1e-12, 1.0, std)
    np.testing.assert_allclose(row.scale, scale, rtol=1e-6)
    z = (x - x.mean(axis=0)) / scale
    ratio = np.linalg.svd(z, compute_uv=False) ** 2
    ratio = ratio / ratio.sum()
    np.testing.assert_allclose(row.explained, ratio, atol=1e-9)
    kept = int(np.searchsorted(np.cumsum(ratio), 0.9, side="right")) + 1
    loading = np.array(row.components).reshape(-1, 7)
    assert loading.shape == (kept, 7)
    np.testing.assert_allclose(loading @ loading.T, np.eye(kept), atol=1e-9)


def test_standardise(activity):
    z = anomaly.standardise(process_data_cluster(activity.where("station_id = 7"))).select("z_" + RUN, "z_Sin_quarter").toPandas()
    assert z["z_" + RUN].mean() == pytest.approx(0, abs=1e-9) and z["z_" + RUN].std(ddof=0) == pytest.approx(1)


def test_fleet(activity, models):
    rows = {r.station_id: r for r in models.collect()}
    assert set(rows) == {7, 8, 106}
    runs = np.array([r[0] for r in activity.where(f"station_id = 106 and {RUN} <= 144").select(RUN).collect()])
    below, upto = (runs < 36).sum(), (runs <= 36).sum()
    share = 1 - (below + upto + (upto > below)) * 50 / len(runs) / 100
    assert rows[106].contamination == pytest.approx(share)
    assert 0 < share < 0.05
    assert rows[106].sample_rows == 256 and rows[8].sample_rows == 1


def test_predictions(spark, activity, models):
    cases = spark.createDataFrame(
        [(106, datetime(2023, 5, 1, 8, 10), 0), (106, datetime(2023, 8, 25, 3, 50), 40), (106, datetime(2023, 8, 25, 13, 50), 100)],
        f"station_id int, date timestamp_ntz, {RUN} bigint")
    rows = anomaly.predict_anomalies_station(cases, models, 106, with_score=True).orderBy("date").collect()
    # the series is simulated, so the exact scores of real stations are not expected
    assert rows[0].anomaly == 1 and rows[0].anomaly_score < 38
    assert rows[2].anomaly == -1 and rows[2].anomaly_score > 50
    assert rows[0].anomaly_score < rows[1].anomaly_score < rows[2].anomaly_score
    scored = anomaly.predict_anomalies_station(activity, models, 106)
    share = scored.agg(F.avg((F.col("anomaly") == -1).cast("double"))).collect()[0][0]
    used = [r.contamination for r in models.collect() if r.station_id == 106][0]
    assert share <= used + 1 / scored.count()
    assert scored.count() == activity.where("station_id = 106").count()


def test_same_result_twice(activity, models):
    again = anomaly.train_cluster_station(activity.repartition(7), profile_station_activity="very high")
    pick = ["station_id", "split_feature", "split_at", "threshold"]
    assert sorted(again.select(*pick).collect()) == sorted(models.select(*pick).collect())


def test_no_rows_no_model(spark, activity, models):
    assert anomaly.predict_anomalies_station(activity, models, station_id=999).count() == 0
    unknown = spark.createDataFrame([(55, datetime(2023, 5, 1), 0)], f"station_id int, date timestamp_ntz, {RUN} bigint")
    assert [r.anomaly for r in anomaly.predict_anomalies_station(unknown, models).collect()] == [None]
    with pytest.raises(ValueError):
        anomaly.train_cluster_station(activity)


def test_no_threshold_without_a_usable_share(spark, activity):
    """Neither a share above a half nor none at all is bent into one that fits."""
    for limit in (0, 100_000):
        made = anomaly.train_cluster_station(activity, 106, "very high", rules={"very high": limit})
        model = made.collect()[0]
        assert not 0 < model.contamination <= 0.5
        assert model.threshold is None and "outside" in model.reason
        flags = anomaly.predict_anomalies_station(activity, made, 106, with_score=True)
        assert flags.where("anomaly IS NOT NULL OR decision IS NOT NULL").count() == 0 < flags.count()


def test_missing_null_and_unknown_labels(spark, activity):
    labels = spark.createDataFrame([(106, None), (7, "unheard of")], "station_id int, profile_station_activity string")
    models = anomaly.train_cluster_station(activity, profile=labels)
    rows = {r.station_id: r for r in models.collect()}
    assert set(rows) == {7, 8, 106}
    assert all(r.contamination is None and r.threshold is None and "label" in r.reason for r in rows.values())
    assert anomaly.predict_anomalies_station(activity, models).where("anomaly IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="unheard of"):
        anomaly.train_cluster_station(activity, 106, "unheard of")


def test_no_row_goes_through_python(activity, models):
    plan = anomaly.predict_anomalies_station(activity, models, with_score=True)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_model_table(spark, activity, models, tmp_path):
    export_model(models, str(tmp_path / "m"))
    one = load_model(spark, str(tmp_path / "m"), 7)
    assert one.count() == 1
    assert load_model(spark, str(tmp_path / "m")).count() == 3
    a = anomaly.predict_anomalies_station(activity, one, 7, with_score=True)
    b = anomaly.predict_anomalies_station(activity, models, 7, with_score=True)
    assert sorted(a.collect()) == sorted(b.collect())


def test_training_of_monitored_stations(spark, tmp_path):
    rows = [(s, d, 10, 10, st, 0, int(run == 0), 0) for s, d, st, run in station(1, days=30) + station(2, days=30)]
    names = ["station_id", "date", "available_stands", "available_bikes", "status", "transactions_in", "transactions_out", "transactions_all"]
    df = spark.createDataFrame(rows, names)
    df = df.withColumn("station_id", F.col("station_id").cast("int")).withColumn("date", F.col("date").cast("timestamp_ntz"))
    profile = spark.createDataFrame([(1, 0.4, "very high"), (2, 0.01, "low")], "station_id int, mean double, profile_station_activity string")
    fitted = run_train_cluster(df, profile, str(tmp_path / "models"))
    assert [r.station_id for r in fitted.collect()] == [1]


def test_projection_of_rows(activity, models):
    placed = anomaly.project_rows(activity.where("station_id <> 8"), models, 3)
    assert placed.columns == [*activity.columns, "axis_1", "axis_2", "axis_3"]
    row = placed.where("station_id = 106").orderBy("date").limit(50).collect()
    x = process_data_cluster(activity.where("station_id = 106")).orderBy("date").limit(50).select(*DETECTOR_FEATURES).toPandas().to_numpy(dtype=float)
    m = models.where("station_id = 106").collect()[0]
    wanted = ((x - np.array(m["mean"])) / np.array(m["scale"])) @ np.array(m["components"]).reshape(-1, 7)[:3].T
    np.testing.assert_allclose([r[-3:] for r in row], wanted, atol=1e-8)
    without = anomaly.project_rows(activity, models.where("station_id = 106"))
    assert without.where("station_id = 7 AND axis_1 IS NOT NULL").count() == 0 < without.where("station_id = 7").count()


def test_trees_grow_in_one_pass_dealt_by_station(spark):
    """No window or sort a level: a station's drawn rows meet once, and stations are dealt over all partitions."""
    points = spark.createDataFrame([(1, 0, 2, 2, [1.0])], "station_id int, i int, rows long, total long, point array<double>")
    sizes = spark.createDataFrame([(1, 2)], "station_id int, size int")
    made = isolation.grow(isolation.draw(points, ["i"], 5, trees=2), sizes, 1, 5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("FlatMapGroupsInArrow") == 2
    assert [(r.place, r.feature, r.path) for r in made.where("place = 0").collect()] == [(0, -1, 1.0)]


def test_fit_gives_what_its_steps_give(spark, activity, models):
    """Trees, scores and threshold of the one pass are those of drawing, growing and scoring one after the other."""
    counted = anomaly.count_combinations(anomaly.training_rows(activity)).cache()
    values = F.array(*[F.col(f).cast("double") for f in DETECTOR_FEATURES])
    setup = models.select("station_id", F.col("rows").alias("total"), F.col("sample_rows").alias("size"), "mean", "scale", "components")
    placed = anomaly.add_encodings(counted).withColumn("_values", values).join(setup, "station_id")
    points = placed.select("station_id", *anomaly.COMBINATION, "rows", "total", F.expr(coordinates("_values")).alias("point"))
    sizes = setup.select("station_id", "size")
    drawn = isolation.draw(points, list(anomaly.COMBINATION), anomaly.SEED)
    arrays = isolation.as_arrays(isolation.grow(drawn, sizes, len(DETECTOR_FEATURES), anomaly.SEED), sizes)
    names = ["station_id", "split_feature", "split_at", "path_length"]
    assert sorted(arrays.select(*names).collect()) == sorted(models.select(*names).collect())
    scored = anomaly._scores(counted, models.where("reason IS NULL"), "contamination", "rows")
    wanted = {r.station_id: r.threshold for r in isolation.counted_percentile(scored, "score", "contamination").collect()}
    assert wanted and {r.station_id: r.threshold for r in models.where("threshold IS NOT NULL").collect()} == wanted


def test_training_deals_combinations_once_and_shuffles_no_scores(activity, monkeypatch):
    plans = []

    def settled(df, stays=False, settle=anomaly.settle):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, stays)

    monkeypatch.setattr(anomaly, "settle", settled)
    assert anomaly.train_cluster_station(activity.where("station_id = 8"), profile_station_activity="very high").count() == 1
    whole = "\n".join(plans)
    assert whole.count("FlatMapCoGroupsInArrow") == 1 and "FlatMapGroupsInArrow" not in whole
    assert "Window" not in whole and "explode" not in whole and "_each" not in whole


def test_digests_of_many_texts():
    texts = [f"42:{i % 1200}:{i}" for i in range(20_000)] + ["", "é", "x" * 50]
    wanted = [hashlib.md5((t + end).encode()).digest() for end in (":3", ":cut") for t in texts]
    assert isolation.digests(pa.array(texts), ":3", ":cut").tobytes() == b"".join(wanted)
    long = ["x" * n for n in range(130)]
    assert isolation.digests(pa.array(long), "").tobytes() == b"".join(hashlib.md5(t.encode()).digest() for t in long)
    assert isolation.digests(pa.array(texts)[5:9], "").tobytes() == b"".join(hashlib.md5(t.encode()).digest() for t in texts[5:9])


def test_rounding_as_spark_does(spark):
    values = [0.0000000005, 1.0000000005, -1.0000000005, 2.0000000015, 0.1234567895, 1.0000000004999, *np.random.default_rng(2).normal(size=200).tolist()]
    wanted = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9)).collect()
    assert isolation.rounded_half_up(np.array(values)).tolist() == [r[0] for r in wanted]
