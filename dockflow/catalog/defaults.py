"""Queries over all stations with the library's own limits, where idle runs are long enough to matter.

Every user of ``events`` stands in for a station. The grid is filled forward between polls, which are hours apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.catalog import inputs as I
from dockflow.catalog.features import r, rounded
from dockflow.catalog.inputs import sql
from dockflow.catalog.models import PERCENTILE, REGRID, ROUNDED, STATS, _cut_sql
from dockflow.models import anomaly
from dockflow.operators.grid import count_steps, deduplicate, polls_to_grid, upsample
from dockflow.operators.movement import get_consecutive_no_transactions_out
from dockflow.operators.timeline import forward_fill
from dockflow.plans.learning import create_station_profilage_activity
from dockflow.schemas import ACTIVITY_COLUMNS, CLOSED_PERIOD, IDLE_LIMITS, MAX_IDLE_STEPS, PROFILE_LABELS, UNUSED_STATIONS
from dockflow.session import settle, spread

LEVELS = ("available_stands", "available_bikes", "status")
STEPS = "steps"


def all_stations_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = I.polls(spark, sf_dir).drop("station_id")
    users = I.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("station_id"))
    return polls_to_grid(deduplicate(polls.join(users, "event_id"), order=["event_id"])).select(*ACTIVITY_COLUMNS)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with levels filled forward, each row with the number of steps it stands for; these are added where they are read."""
    grid = all_stations_grid(spark, sf_dir).where("date IS NOT NULL")
    return settle(count_steps(forward_fill(grid, LEVELS), name=STEPS))


def _idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = get_consecutive_no_transactions_out(_held(spark, sf_dir), steps=STEPS)
    return upsample(spread(runs, "station_id"), steps=STEPS)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label, and none for each fifth station."""
    kind = F.col("station_id") % 5
    label = F.when(kind < 4, F.element_at(F.array(*[F.lit(x) for x in PROFILE_LABELS]), (kind + 1).cast("int")))
    users = I.table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("station_id")).distinct()
    return users.withColumn("profile_station_activity", label)


def all_stations_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = create_station_profilage_activity(_held(spark, sf_dir), steps=STEPS)
    return made.withColumns({"mean": rounded("mean"), "std": rounded("std")})


def all_stations_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = anomaly.count_combinations(anomaly.training_rows(_idle(spark, sf_dir)))
    out = anomaly.contamination(counted, _labels(spark, sf_dir))
    return out.withColumn("contamination", rounded("contamination"))


def all_stations_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = anomaly.train_cluster_station(_idle(spark, sf_dir), profile=_labels(spark, sf_dir))
    return made.select(
        "station_id", "rows", "sample_rows", rounded("contamination").alias("contamination"), "reason",
        F.col("threshold").isNotNull().alias("has_threshold"),
    )


_POLLS = I.CTES["polls"].replace("CAST(user_id % 4 AS INTEGER)", "CAST(user_id AS INTEGER)")
_GRID = {
    "user_polls": _POLLS,
    "user_unique": I.CTES["unique_polls"].replace("FROM polls)", "FROM user_polls)"),
    "user_moves": I.moves_sql("user_unique"),
    "activity": I.grid_sql("user_moves"),
}
_FILLED = {
    "steps": """SELECT station_id, unnest(generate_series(min(date), max(date), INTERVAL '10 minutes')) AS date
        FROM activity GROUP BY station_id""",
    "filled": """SELECT s.station_id, s.date, last_value(available_stands IGNORE NULLS) OVER w AS available_stands,
        last_value(available_bikes IGNORE NULLS) OVER w AS available_bikes, last_value(status IGNORE NULLS) OVER w AS status,
        coalesce(transactions_out, 0) AS transactions_out
        FROM steps s LEFT JOIN activity a ON a.station_id = s.station_id AND a.date = s.date
        WINDOW w AS (PARTITION BY s.station_id ORDER BY s.date ROWS UNBOUNDED PRECEDING)""",
}
_TRAIN = f"""SELECT * FROM idle WHERE NOT (date BETWEEN TIMESTAMP '{CLOSED_PERIOD[0]}' AND TIMESTAMP '{CLOSED_PERIOD[1]}')
    AND station_id NOT IN ({', '.join(map(str, UNUSED_STATIONS))})
    AND status = 1 AND consecutive_no_transactions_out <= {MAX_IDLE_STEPS}"""
_LIMITS = " ".join(f"WHEN {k} THEN {IDLE_LIMITS[label]}" for k, label in enumerate(PROFILE_LABELS))
_SHARES = f"""SELECT station_id, count(*) AS rows, CASE WHEN any_value(lim) IS NOT NULL THEN 1 - {PERCENTILE} / 100 END AS c
    FROM (SELECT station_id, consecutive_no_transactions_out AS x, CASE station_id % 5 {_LIMITS} END AS lim FROM train)
    GROUP BY station_id"""

QUERIES = {
    "all_stations_grid": (all_stations_grid, sql(f"SELECT {', '.join(ACTIVITY_COLUMNS)} FROM activity", **_GRID)),
    "all_stations_profile": (all_stations_profile, sql(
        f"""SELECT {ROUNDED}, {_cut_sql('mean', '(SELECT min(mean) FROM stats)', '(SELECT max(mean) FROM stats)')}
        AS profile_station_activity FROM stats""",
        **_GRID, **_FILLED, regrid=REGRID.replace("FROM activity", "FROM filled"), idle=I.idle_sql("regrid"), train=_TRAIN,
        stats=STATS)),
    "all_stations_contamination": (all_stations_contamination, sql(
        f"SELECT station_id, {r('c')} AS contamination FROM shares",
        **_GRID, **_FILLED, idle=I.idle_sql("filled"), train=_TRAIN, shares=_SHARES)),
    "all_stations_detectors": (all_stations_detectors, sql(
        f"""SELECT station_id, rows, CAST(least(rows, 256) AS INTEGER) AS sample_rows, {r('c')} AS contamination,
        CASE WHEN c IS NULL THEN 'no limit for the station''s label' WHEN NOT (c > 0 AND c <= 0.5)
            THEN 'share of anomalies outside (0, 0.5]' END AS reason, c IS NOT NULL AND c > 0 AND c <= 0.5 AS has_threshold
        FROM shares""",
        **_GRID, **_FILLED, idle=I.idle_sql("filled"), train=_TRAIN, shares=_SHARES)),
}
