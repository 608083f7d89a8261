"""Queries: station profiles, anomaly detectors and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockflow.catalog import inputs as I
from dockflow.catalog.detector_sql import components_sql, detector_sql
from dockflow.catalog.features import FORECAST_COLUMNS, QUERIES as FEATURES, r, rounded
from dockflow.catalog.inputs import sql
from dockflow.functions.calendar import process_data_cluster
from dockflow.models import anomaly, forecast
from dockflow.models import fleet_forecast as fleet_forecasts
from dockflow.models import histogram_forest as forests
from dockflow.operators import filters, lookups, profile
from dockflow.operators.movement import get_consecutive_no_transactions_out
from dockflow.plans import learning
from dockflow.schemas import DETECTOR_FEATURES, SEED
from dockflow.session import scratch_path, settle
from dockflow.sources import writers

OUTSIDE = f"NOT (date BETWEEN TIMESTAMP '{I.PERIOD[0]}' AND TIMESTAMP '{I.PERIOD[1]}')"
USABLE = f"status = 1 AND consecutive_no_transactions_out <= {I.MAX_IDLE}"
TRAIN = f"SELECT * FROM idle WHERE {OUTSIDE} AND {USABLE}"
SETTINGS = {"period": I.PERIOD, "max_idle": I.MAX_IDLE}


# -- profile --------------------------------------------------------------------------------------------------


def activity_statistics(spark, sf_dir):
    rows = filters.usable_rows(filters.filter_periode(I.idle_activity(spark, sf_dir), [], I.PERIOD), I.MAX_IDLE)
    bit = F.when(F.col("transactions_out") > 1, 1).otherwise(F.col("transactions_out"))
    stats = profile.activity_statistics(rows.select("station_id", bit.alias("transactions_out_bool")))
    return stats.withColumns({"mean": rounded("mean"), "std": rounded("std")})


def _nearest_rank(q):
    return f"CAST(list_sort(list(bit))[CAST(floor((count(bit) - 1) * {q} + 0.5) AS BIGINT) + 1] AS DOUBLE)"


STATS = f"""SELECT station_id, count(bit) AS total_point, avg(bit) AS mean, CAST(median(bit) AS DOUBLE) AS median,
    stddev_samp(bit) AS std, {_nearest_rank(0.95)} AS "95%", {_nearest_rank(0.98)} AS "98%", {_nearest_rank(0.99)} AS "99%",
    max(bit) AS max FROM (SELECT station_id, least(greatest(transactions_out, 0), 1) AS bit FROM train) GROUP BY station_id"""


def station_profile(spark, sf_dir):
    made = learning.create_station_profilage_activity(
        I.stored_activity(spark, sf_dir), non_use_station_id=[], period=I.PERIOD, max_idle=I.MAX_IDLE
    )
    return made.withColumns({"mean": rounded("mean"), "std": rounded("std")})


def _cut_sql(value, low, high):
    return f"""CASE WHEN {value} <= {low} + ({high} - {low}) / 4 * 1 THEN 'low' WHEN {value} <= {low} + ({high} - {low}) / 4 * 2
        THEN 'medium' WHEN {value} <= {low} + ({high} - {low}) / 4 * 3 THEN 'hight' ELSE 'very high' END"""


ROUNDED = f"* REPLACE ({r('mean')} AS mean, {r('std')} AS std)"
#: The profile derives movements anew from the levels of the grid.
REGRID = f"""SELECT station_id, date, available_stands, available_bikes, status, {I.MOVED} FROM activity
    WINDOW w AS (PARTITION BY station_id ORDER BY date)"""
PROFILE = sql(
    f"""SELECT {ROUNDED}, {_cut_sql('mean', '(SELECT min(mean) FROM stats)', '(SELECT max(mean) FROM stats)')}
    AS profile_station_activity FROM stats""",
    "activity", regrid=REGRID, idle=I.idle_sql("regrid"), train=TRAIN, stats=STATS)


def breakpoints(spark, sf_dir):
    borders = profile.calculate_breakpoints(I.table(spark, sf_dir, "supplier"), "s_acctbal", 4)
    return borders.withColumn("breakpoint", rounded("breakpoint", 6))


BREAKPOINTS = f"""SELECT CAST(bin AS INTEGER) AS bin, {r('low + (high - low) / 4 * bin', 6)} AS breakpoint
    FROM (SELECT min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier), (SELECT unnest([1, 2, 3]) AS bin)"""


def cut_labels(spark, sf_dir):
    return profile.cut(I.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "label")


def monitored(spark, sf_dir):
    share = I.station_profile(spark, sf_dir)
    return filters.monitored_stations(share, 0.4, [1])


# -- detector -------------------------------------------------------------------------------------------------


def _counted(spark, sf_dir):
    return anomaly.count_combinations(anomaly.training_rows(I.idle_activity(spark, sf_dir), I.PERIOD, [], I.MAX_IDLE))


WAVES = """CAST(consecutive_no_transactions_out AS DOUBLE) AS f0,
    sin(2 * pi() / 4 * quarter(date)) AS f1, cos(2 * pi() / 4 * quarter(date)) AS f2,
    sin(2 * pi() / 7 * isodow(date)) AS f3, cos(2 * pi() / 7 * isodow(date)) AS f4,
    sin(2 * pi() / 24 * hour(date)) AS f5, cos(2 * pi() / 24 * hour(date)) AS f6"""
ENCODED = f"SELECT *, {WAVES} FROM train"


def scaling(spark, sf_dir):
    moments = anomaly.feature_moments(_counted(spark, sf_dir))
    scaled = moments.withColumn("_p", anomaly.principal_components("mean", "covariance", "rows"))
    pairs = F.arrays_zip(F.col("mean").alias("mean"), F.col("_p.scale").alias("scale"))
    return scaled.select("station_id", F.posexplode(pairs)).select(
        "station_id", F.col("pos").alias("feature"), rounded("col.mean", 6).alias("mean"),
        rounded("col.scale", 6).alias("scale"),
    )


SCALING = sql(
    " UNION ALL ".join(
        f"""SELECT station_id, {i} AS feature, {r(f'avg(f{i})', 6)} AS mean, {r(f'CASE WHEN stddev_pop(f{i}) < 1e-9 THEN 1e0 ELSE stddev_pop(f{i}) END', 6)}
        AS scale FROM encoded GROUP BY station_id""" for i in range(7)),
    "idle", train=TRAIN, encoded=ENCODED)


def covariances(spark, sf_dir):
    pairs = [(i, j) for i in range(7) for j in range(i, 7)]
    entries = F.array(*[
        F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col("covariance")[n].alias("cov"))
        for n, (i, j) in enumerate(pairs)
    ])
    moments = anomaly.feature_moments(_counted(spark, sf_dir))
    return moments.select("station_id", F.inline(entries)).withColumn("cov", rounded("cov", 6))


COVARIANCES = sql(
    " UNION ALL ".join(
        f"SELECT station_id, {i} AS a, {j} AS b, {r(f'covar_pop(f{i}, f{j})', 6)} AS cov FROM encoded GROUP BY station_id"
        for i in range(7) for j in range(i, 7)),
    "idle", train=TRAIN, encoded=ENCODED)


def standardised(spark, sf_dir):
    rows = process_data_cluster(anomaly.training_rows(I.idle_activity(spark, sf_dir), I.PERIOD, [], I.MAX_IDLE))
    scaled = anomaly.standardise(rows)
    return scaled.select("station_id", "date", *[rounded(f"z_{f}", 6).alias(f"z{i}") for i, f in enumerate(DETECTOR_FEATURES)])


def _z(i):
    w = "OVER (PARTITION BY station_id)"
    return r(f"(f{i} - avg(f{i}) {w}) / CASE WHEN stddev_pop(f{i}) {w} < 1e-12 THEN 1e0 ELSE stddev_pop(f{i}) {w} END", 6)


STANDARDISED = sql(
    f"SELECT station_id, date, {', '.join(f'{_z(i)} AS z{i}' for i in range(7))} FROM encoded",
    "idle", train=TRAIN, encoded=ENCODED)


def components(spark, sf_dir):
    """Loadings of the kept components, and the share of the variance each explains."""
    moments = anomaly.feature_moments(_counted(spark, sf_dir))
    parts = moments.select("station_id", anomaly.principal_components("mean", "covariance", "rows").alias("_p"))
    loadings = parts.select("station_id", "_p.explained", F.posexplode("_p.components").alias("place", "loading"))
    component = F.expr("place div 7").cast("int")
    return loadings.select(
        "station_id", component.alias("component"), (F.col("place") % 7).alias("feature"), rounded("loading", 6).alias("loading"),
        rounded(F.get("explained", component), 6).alias("explained"),
    )


COMPONENTS = components_sql(
    f"""SELECT station_id, CAST(k AS INTEGER) AS component, CAST(i AS INTEGER) AS feature, {r('v[i * 7 + axis + 1]', 6)} AS loading,
    {r('share', 6)} AS explained FROM axes JOIN solved USING (station_id), range(7) AS r(i) WHERE k < kept""", TRAIN)


PERCENTILE = f"""(sum(CASE WHEN x < lim THEN 1 ELSE 0 END) + sum(CASE WHEN x <= lim THEN 1 ELSE 0 END)
    + CASE WHEN sum(CASE WHEN x = lim THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END) * 50e0 / count(x)"""
LIMITED = """SELECT t.station_id, consecutive_no_transactions_out AS x, CASE p.profile_station_activity
    WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END AS lim FROM train t JOIN station_profile p ON p.station_id = t.station_id"""


def idle_percentiles(spark, sf_dir):
    rows = anomaly.training_rows(I.idle_activity(spark, sf_dir), I.PERIOD, [], I.MAX_IDLE)
    out = profile.idle_percentile(rows, F.lit(2))
    return out.withColumn("percentile", rounded("percentile"))


def contaminations(spark, sf_dir):
    out = anomaly.contamination(_counted(spark, sf_dir), I.station_profile(spark, sf_dir), rules=I.RULES)
    return out.withColumn("contamination", rounded("contamination"))


CONTAMINATIONS = sql(
    f"SELECT station_id, {r(f'1 - {PERCENTILE} / 100')} AS contamination FROM limited GROUP BY station_id",
    "idle", "station_profile", train=TRAIN, limited=LIMITED)


def _fleet(spark, sf_dir, target=None, rows=None):
    """Detectors of all stations; ``rows`` may hold the activity, with or without the idle run."""
    rows = I.stored_activity(spark, sf_dir) if rows is None else rows
    return learning.run_train_cluster(
        rows, I.station_profile(spark, sf_dir, rows), target, threshold=0.0, non_use_station_id=[], rules=I.RULES,
        **SETTINGS,
    )


def fleet_detectors(spark, sf_dir):
    return _fleet(spark, sf_dir).select(
        "station_id", "rows", "sample_rows", rounded("contamination").alias("contamination"),
        F.col("threshold").isNotNull().alias("has_threshold"), F.size("split_feature").alias("nodes"),
    )


FLEET = sql(
    f"""SELECT station_id, rows, CAST(least(rows, 256) AS INTEGER) AS sample_rows, {r('c')} AS contamination,
    c > 0 AND c <= 0.5 AS has_threshold, {anomaly.TREES} * (2 ** (CAST(ceil(log2(greatest(least(rows, 256), 2))) AS INTEGER) + 1) - 1)::INTEGER AS nodes
    FROM (SELECT station_id, count(*) AS rows, 1 - {PERCENTILE} / 100 AS c FROM limited GROUP BY station_id)""",
    "idle", "station_profile", train=TRAIN, limited=LIMITED)


def detector_status(spark, sf_dir):
    """Which stations get a threshold, where labels are missing, null or unknown and shares too large."""
    rows = I.stored_activity(spark, sf_dir)
    label = F.when(F.col("station_id") == 1, "unheard of").when(F.col("station_id") == 2, "low")
    labels = I.station_profile(spark, sf_dir, rows).where("station_id <> 0").withColumn("profile_station_activity", label)
    idle = get_consecutive_no_transactions_out(rows)
    made = anomaly.train_cluster_station(idle, profile=labels, rules=I.RULES | {"low": 1}, non_use_station_id=[], **SETTINGS)
    return made.select(
        "station_id", "rows", rounded("contamination").alias("contamination"), "reason",
        F.col("threshold").isNotNull().alias("has_threshold"),
    )


STATUS = sql(
    f"""SELECT station_id, rows, {r('c')} AS contamination, c IS NOT NULL AND c > 0 AND c <= 0.5 AS has_threshold,
    CASE WHEN c IS NULL THEN 'no limit for the station''s label' WHEN NOT (c > 0 AND c <= 0.5)
        THEN 'share of anomalies outside (0, 0.5]' END AS reason
    FROM (SELECT station_id, count(*) AS rows, CASE WHEN station_id = 2 THEN 1 - {PERCENTILE} / 100 END AS c
        FROM (SELECT station_id, consecutive_no_transactions_out AS x, 1 AS lim FROM train) GROUP BY station_id)""", "idle", train=TRAIN)


def stored_detector(spark, sf_dir):
    path = scratch_path(spark, "models")
    _fleet(spark, sf_dir, path)
    return writers.load_model(spark, path, station_id=2).select("station_id", "rows", rounded("contamination").alias("contamination"))


STORED = sql(
    f"SELECT station_id, count(*) AS rows, {r(f'1 - {PERCENTILE} / 100')} AS contamination FROM limited WHERE station_id = 2 GROUP BY station_id",
    "idle", "station_profile", train=TRAIN, limited=LIMITED)


def one_detector(spark, sf_dir):
    rows = I.idle_activity(spark, sf_dir)
    made = anomaly.train_cluster_station(
        rows, station_id=1, profile_station_activity="medium", rules=I.RULES, non_use_station_id=[], **SETTINGS
    )
    return made.select("station_id", "rows", rounded("contamination").alias("contamination"))


ONE_DETECTOR = sql(
    f"""SELECT station_id, count(*) AS rows, {r(f'1 - {PERCENTILE} / 100')} AS contamination
    FROM (SELECT station_id, consecutive_no_transactions_out AS x, 2 AS lim FROM train WHERE station_id = 1)
    GROUP BY station_id""", "idle", train=TRAIN)


def _scored(spark, sf_dir, with_score=False):
    rows = settle(I.idle_activity(spark, sf_dir))
    models = settle(_fleet(spark, sf_dir, rows=rows))
    return anomaly.predict_anomalies_station(rows, models, with_score=with_score), models


def anomaly_predictions(spark, sf_dir):
    return _scored(spark, sf_dir)[0].select("station_id", "date", anomaly.RUN, "anomaly")


def anomaly_scores(spark, sf_dir):
    scored = _scored(spark, sf_dir, with_score=True)[0]
    return scored.select("station_id", "date", rounded("decision", 6).alias("decision"), "anomaly", rounded("anomaly_score", 4).alias("anomaly_score"))


PREDICTIONS = detector_sql(f"SELECT station_id, date, {anomaly.RUN}, anomaly FROM flags", TRAIN, PERCENTILE)
SCORES = detector_sql(
    f"SELECT station_id, date, {r('decision', 6)} AS decision, anomaly, {r('100 / (1 + exp(20e0 * decision))', 4)} AS anomaly_score FROM flags", TRAIN, PERCENTILE)


def anomaly_share(spark, sf_dir):
    """Anomalies among the training rows, held against the contamination."""
    scored, models = _scored(spark, sf_dir)
    kept = anomaly.training_rows(scored, I.PERIOD, [], I.MAX_IDLE)
    share = kept.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("anomaly") == -1).cast("double")).alias("_share")
    )
    below = F.col("_share") <= F.col("contamination") + 1 / F.col("rows")
    return share.join(models.select("station_id", "contamination"), "station_id").select("station_id", "rows", below.alias("within_contamination"))


ANOMALY_SHARE = sql(
    f"""SELECT station_id, count(*) AS rows, CASE WHEN 1 - {PERCENTILE} / 100 > 0 AND 1 - {PERCENTILE} / 100 <= 0.5 THEN true END
    AS within_contamination FROM limited GROUP BY station_id""", "idle", "station_profile", train=TRAIN, limited=LIMITED)


def station_projection(spark, sf_dir):
    """Places of all rows along the first three components of their station."""
    rows = settle(I.idle_activity(spark, sf_dir))
    placed = anomaly.project_rows(rows, settle(_fleet(spark, sf_dir, rows=rows)), 3)
    return placed.select("station_id", "date", *[rounded(f"axis_{d}", 6).alias(f"axis_{d}") for d in (1, 2, 3)])


def _axis_sql(number):
    along = " + ".join(f"(x[{i + 1}] - mean[{i + 1}]) / scale[{i + 1}] * v[{i * 7} + axis + 1]" for i in range(7))
    return f"max(CASE WHEN k = {number - 1} AND k < kept THEN {r(f'round({along}, 9)', 6)} END) AS axis_{number}"


PROJECTION = components_sql(
    f"""SELECT station_id, date, {', '.join(map(_axis_sql, (1, 2, 3)))} FROM (SELECT station_id, date, [f0, f1, f2, f3, f4, f5, f6] AS x
    FROM (SELECT station_id, date, {WAVES} FROM idle)) JOIN axes USING (station_id) JOIN moments USING (station_id) JOIN solved USING (station_id)
    GROUP BY station_id, date""", TRAIN)


# -- forecast -------------------------------------------------------------------------------------------------


def forecast_features(spark, sf_dir):
    rows = I.stored_activity(spark, sf_dir).select("station_id", "date", "available_bikes")
    built = forecast.build_feat_for_regression(lookups.create_target(rows, "available_bikes", "1h"), "available_bikes")
    waves = [rounded(f).alias(f) for f in forecast.get_feature_to_use_for_model("available_bikes")[:6]]
    return built.select("station_id", "date", "target", *waves, *FORECAST_COLUMNS)


def _forecast_features_sql():
    rolling = FEATURES["lags_and_rolling"][1]
    waves = ", ".join(
        f"{r(f'{fn}(2 * pi() / {top} * {field}(f.date))')} AS {name}_{part}"
        for part, top, field in (("weekday", 7, "isodow"), ("hours", 24, "hour"), ("minutes", 6, "minute"))
        for name, fn in (("Sin", "sin"), ("Cos", "cos"))
    )
    body = rolling.replace("SELECT station_id, date, lag", "SELECT station_id, date, available_bikes AS own, lag", 1)
    return f"""WITH built AS MATERIALIZED ({body}) SELECT f.* EXCLUDE (own), b.own AS target, {waves} FROM built f
        LEFT JOIN built b ON b.station_id = f.station_id AND b.date = f.date + INTERVAL 1 HOUR"""


REQUEST = "target_station_id=2,target_col=available_bikes,horizon_prediction=30m"


def station_forecast(spark, sf_dir):
    """Answer to one request; the forecast lies within the values seen."""
    history = I.stored_activity(spark, sf_dir)
    answer = forecast.get_prediction_station(history, REQUEST)
    seen = history.where("station_id = 2").agg(
        F.min("available_bikes").alias("low"), F.max("available_bikes").alias("high")
    )
    low, high = seen.select("low").scalar(), seen.select("high").scalar()
    return answer.select("station_id", "date", F.col("y_pred").between(low, high).alias("plausible"))


def station_forecast_value(spark, sf_dir):
    return forecast.get_prediction_station(
        I.stored_activity(spark, sf_dir), "target_station_id=1, target_col=available_stands, horizon_prediction=2h10m"
    ).select("station_id", "date", "y_pred")


def fleet_forecast(spark, sf_dir):
    """The forecast of every station in one job."""
    return fleet_forecasts.forecast_all(I.stored_activity(spark, sf_dir), "available_bikes", "1h")


def fleet_forecast_inputs(spark, sf_dir):
    """What the forecast of every station rests on: the newest rows at the horizon, and the number of rows to learn from."""
    inputs = fleet_forecasts.forecast_inputs(I.stored_activity(spark, sf_dir), "available_bikes", "1h")
    learned = inputs.where("NOT asked").groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").alias("targets"))
    asked = inputs.where("asked").select("station_id", "date", *[F.col(c).cast("bigint").alias(c) for c in FORECAST_COLUMNS])
    return asked.join(learned.withColumn("targets", F.col("targets").cast("bigint")), "station_id")


def _fleet_inputs_sql():
    rolling = FEATURES["lags_and_rolling"][1]
    body = rolling.replace("SELECT station_id, date, lag", "SELECT station_id, date, available_bikes AS own, lag", 1)
    return f"""WITH built AS MATERIALIZED ({body}),
        learned AS (SELECT f.station_id, count(*) AS rows, CAST(sum(b.own) AS BIGINT) AS targets FROM built f
            JOIN built b ON b.station_id = f.station_id AND b.date = f.date + INTERVAL 1 HOUR WHERE b.own IS NOT NULL GROUP BY 1)
        SELECT f.* EXCLUDE (own) REPLACE (f.date + INTERVAL 1 HOUR AS date), rows, targets FROM built f JOIN learned USING (station_id)
        WHERE f.date = (SELECT max(date) FROM built m WHERE m.station_id = f.station_id)"""


def _forest_rows(spark, sf_dir):
    inputs = fleet_forecasts.forecast_inputs(I.stored_activity(spark, sf_dir), "available_bikes", "1h")
    return settle(forests.prepared(inputs, forecast.get_feature_to_use_for_model("available_bikes")))


def forest_histogram(spark, sf_dir):
    """The first level's histograms of all stations' forests."""
    counted = forests.level_histogram(_forest_rows(spark, sf_dir), 0, 17)
    return counted.select("station_id", "tree", "feature", "bin", F.col("n").cast("bigint").alias("n"), F.col("s").cast("bigint").alias("s"))


def forest_splits(spark, sf_dir):
    """The cuts chosen on the first two levels."""
    rows = _forest_rows(spark, sf_dir)
    root = settle(forests.best_splits(forests.level_histogram(rows, 0, 17)))
    second = forests.best_splits(forests.level_histogram(settle(forests.next_level(rows, root, 0)), 1, 17))
    return root.unionByName(second).select("station_id", "tree", "node", "feature", "cut", rounded("gain", 3).alias("gain"))


def _forest_sql(levels: int, select: str) -> str:
    """The forest's rows, and ``levels`` levels of histograms (``h0``, ``h1``, ...), cuts (``p0``, ...) and rows in nodes (``n1``, ...)."""
    waves = [
        (fn, top, field) for part, top, field in (("weekday", 7, "isodow"), ("hours", 24, "hour"), ("minutes", 6, "minute")) for fn in ("sin", "cos")
    ]
    body = FEATURES["lags_and_rolling"][1].replace("SELECT station_id, date, lag", "SELECT station_id, date, available_bikes AS own, lag", 1)

    def x(date):
        values = [f"{fn}(2 * pi() / {top} * {field}({date}))" for fn, top, field in waves] + [f"CAST(f.{c} AS DOUBLE)" for c in FORECAST_COLUMNS]
        return f"[{', '.join(values)}]"

    top = forests.BINS - 1
    digits = " || ".join(f"md5('{SEED}:' || station_id || ':' || sec || ':{g}')" for g in range(-(-forests.TREES // 8)))
    drawn = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in forests.POISSON)
    parts = [
        f"""built AS MATERIALIZED ({body})""",
        f"""facts AS MATERIALIZED (SELECT f.station_id, CAST(epoch(f.date) AS BIGINT) AS sec, f.date, CAST(b.own AS DOUBLE) AS target, false AS asked, {x('f.date')} AS x
            FROM built f JOIN built b ON b.station_id = f.station_id AND b.date = f.date + INTERVAL 1 HOUR WHERE b.own IS NOT NULL
            UNION ALL SELECT f.station_id, CAST(epoch(f.date + INTERVAL 1 HOUR) AS BIGINT), f.date + INTERVAL 1 HOUR, NULL, true, {x('(f.date + INTERVAL 1 HOUR)')}
            FROM built f WHERE f.date = (SELECT max(date) FROM built m WHERE m.station_id = f.station_id))""",
        """cells AS (SELECT station_id, sec, asked, unnest(range(17)) AS feature, unnest(x) AS v FROM facts)""",
        """ends AS (SELECT station_id, feature, min(v) AS low, max(v) AS high FROM cells WHERE NOT asked GROUP BY ALL)""",
        f"""bins AS MATERIALIZED (SELECT station_id, sec, asked, feature, CAST(CASE WHEN v IS NULL THEN 0 WHEN high > low
            THEN greatest(0, least({top}, floor(round((v - low) * {top} / (high - low), 6)))) + 1 ELSE 1 END AS INTEGER) AS bin
            FROM cells JOIN ends USING (station_id, feature))""",
        f"""drawn AS (SELECT station_id, sec, asked, target, tree, CAST('0x' || substr(digits, 4 * tree + 1, 4) AS INTEGER) AS u FROM
            (SELECT *, unnest(range({forests.TREES})) AS tree FROM (SELECT *, {digits} AS digits FROM facts)))""",
        f"""n0 AS MATERIALIZED (SELECT station_id, sec, asked, target, CAST(tree AS INTEGER) AS tree, times, 0 AS node FROM (SELECT *, {drawn} AS times FROM drawn) WHERE asked OR times > 0)""",
    ]
    for level in range(levels):
        parts += [
            f"""h{level} AS MATERIALIZED (SELECT station_id, tree, node, feature, bin, CAST(sum(times) AS BIGINT) AS n, sum(times * target) AS s
                FROM n{level} JOIN bins USING (station_id, sec, asked) WHERE NOT asked AND node >= {2**level - 1}
                AND CAST('0x' || substr(md5('{SEED}:' || tree || ':' || node || ':' || feature), 1, 2) AS INTEGER) % 4 <> 0 GROUP BY ALL)""",
            f"""c{level} AS (SELECT station_id, tree, node, feature, bin, sum(n) OVER r AS n_l, sum(s) OVER r AS s_l, sum(n) OVER a AS n_all, sum(s) OVER a AS s_all
                FROM h{level} WINDOW a AS (PARTITION BY station_id, tree, node, feature), r AS (a ORDER BY bin ROWS UNBOUNDED PRECEDING))""",
            f"""p{level} AS MATERIALIZED (SELECT station_id, tree, node, feature, bin AS cut, gain FROM (SELECT *,
                round(s_l * s_l / n_l + (s_all - s_l) * (s_all - s_l) / (n_all - n_l) - s_all * s_all / n_all, 6) AS gain FROM c{level} WHERE n_l < n_all)
                WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY station_id, tree, node ORDER BY gain DESC, feature, cut) = 1)""",
            f"""n{level + 1} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN p.cut IS NULL THEN n.node ELSE 2 * n.node + 1 + CASE WHEN b.bin > p.cut THEN 1 ELSE 0 END END AS node)
                FROM n{level} n LEFT JOIN p{level} p ON p.station_id = n.station_id AND p.tree = n.tree AND p.node = n.node
                LEFT JOIN bins b ON b.station_id = n.station_id AND b.sec = n.sec AND b.asked = n.asked AND b.feature = p.feature)""",
        ]
    return f"WITH {', '.join(parts)} {select}"


_DEEPEST = f"n{forests.DEPTH}"
FLEET_FORECAST = _forest_sql(forests.DEPTH, f"""SELECT f.station_id, f.date, CAST(floor(round(avg(m.mean), 6) + 0.5) AS INTEGER) AS y_pred
    FROM facts f JOIN {_DEEPEST} a ON a.asked AND a.station_id = f.station_id JOIN (SELECT station_id, tree, node, sum(times * target) / sum(times) AS mean
        FROM {_DEEPEST} WHERE NOT asked GROUP BY ALL) m ON m.station_id = a.station_id AND m.tree = a.tree AND m.node = a.node
    WHERE f.asked GROUP BY ALL""")
FOREST_HISTOGRAM = _forest_sql(1, "SELECT station_id, tree, CAST(feature AS INTEGER) AS feature, bin, n, CAST(s AS BIGINT) AS s FROM h0")
FOREST_SPLITS = _forest_sql(2, f"""SELECT station_id, tree, node, CAST(feature AS INTEGER) AS feature, cut, {r('gain', 3)} AS gain
    FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1)""")


QUERIES = {
    "fleet_forecast": (fleet_forecast, FLEET_FORECAST),
    "forest_histogram": (forest_histogram, FOREST_HISTOGRAM),
    "forest_splits": (forest_splits, FOREST_SPLITS),
    "fleet_forecast_inputs": (fleet_forecast_inputs, _fleet_inputs_sql()),
    "activity_statistics": (activity_statistics, sql(f"SELECT {ROUNDED} FROM stats", "idle", train=TRAIN, stats=STATS)),
    "station_profile": (station_profile, PROFILE),
    "breakpoints": (breakpoints, BREAKPOINTS),
    "cut_labels": (cut_labels, f"SELECT s_suppkey, s_acctbal, {_cut_sql('s_acctbal', 'low', 'high')} AS label FROM supplier, (SELECT min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier)"),
    "monitored_stations": (monitored, sql("SELECT station_id FROM station_profile WHERE mean >= 0.4 AND station_id NOT IN (1)", "station_profile")),
    "detector_scaling": (scaling, SCALING),
    "detector_covariances": (covariances, COVARIANCES),
    "standardised_features": (standardised, STANDARDISED),
    "detector_components": (components, COMPONENTS),
    "idle_percentile": (idle_percentiles, sql(f"""SELECT station_id, count(x) AS rows, {r(PERCENTILE)} AS percentile
        FROM (SELECT station_id, consecutive_no_transactions_out AS x, 2 AS lim FROM train) GROUP BY station_id""", "idle", train=TRAIN)),
    "contamination": (contaminations, CONTAMINATIONS),
    "fleet_detectors": (fleet_detectors, FLEET),
    "detector_status": (detector_status, STATUS),
    "stored_detector": (stored_detector, STORED),
    "one_detector": (one_detector, ONE_DETECTOR),
    "anomaly_predictions": (anomaly_predictions, PREDICTIONS),
    "anomaly_scores": (anomaly_scores, SCORES),
    "station_projection": (station_projection, PROJECTION),
    "anomaly_share": (anomaly_share, ANOMALY_SHARE),
    "forecast_features": (forecast_features, _forecast_features_sql()),
    "station_forecast": (station_forecast, sql("SELECT station_id, max(date) + INTERVAL '30 minutes' AS date, true AS plausible FROM activity WHERE station_id = 2 GROUP BY station_id", "activity")),
    "station_forecast_value": (station_forecast_value, None),
}
