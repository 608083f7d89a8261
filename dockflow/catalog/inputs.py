"""The library's inputs derived from the given tables, and the same derivations as SQL.

``events`` stands in for station polls (four stations), ``supplier`` for the station list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.functions.calendar import iso_weekday
from dockflow.operators.grid import deduplicate, polls_to_grid
from dockflow.operators.movement import get_consecutive_no_transactions_out
from dockflow.schemas import ACTIVITY_COLUMNS
from dockflow.session import settle

#: Idle runs of the stand-in data are short, so limits and caps are scaled down.
RULES = {"very high": 1, "hight": 1, "medium": 2, "low": 3}
MAX_IDLE = 3
PERIOD = ("2024-01-10 00:00:00", "2024-01-12 00:00:00")
#: Chunk of the dense raw feed.
RAW = "10m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _levels() -> dict:
    bikes = F.floor("value").cast("bigint") % 41
    return {"available_bikes": bikes, "available_stands": 40 - bikes}


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw polls: one row per event."""
    levels = _levels()
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("int").alias("station_id"),
        F.col("ts").alias("date"),
        "event_id",
        levels["available_bikes"].alias("available_bikes"),
        levels["available_stands"].alias("available_stands"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("status"),
    )


def unique_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls with one row per station and date: of copies the first event stays."""
    return deduplicate(polls(spark, sf_dir), order=["event_id"])


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity on the ten-minute grid."""
    return polls_to_grid(unique_polls(spark, sf_dir))


def stored_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as a written table, as the learning dataset is: later steps read it more than once."""
    return settle(activity(spark, sf_dir))


def idle_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_consecutive_no_transactions_out(stored_activity(spark, sf_dir))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity with an anomaly flag: idle for two steps or longer."""
    run = F.col("consecutive_no_transactions_out")
    return idle_activity(spark, sf_dir).withColumn("anomaly", F.when(run >= 2, -1).otherwise(1))


def open_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station list as the open-data portal gives it."""
    k = F.col("s_suppkey")
    lat = F.concat(F.lit("44."), (800 + k % 97).cast("string"))
    lon = F.concat(F.lit("-0."), (511 + k % 89).cast("string"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(lat, F.lit(","), lon).alias("Geo Point"),
        F.concat(F.lit('{"type": "Point", "coordinates": ['), lon, F.lit(", "), lat, F.lit("]}")).alias("Geo Shape"),
        F.concat(F.lit("Commune "), F.col("s_nationkey").cast("string")).alias("commune"),
        k.cast("int").alias("IDENT"),
        F.lit("VLS").alias("TYPE"),
        F.col("s_name").alias("NOM"),
        (k % 31).cast("int").alias("NBPLACES"),
        F.col("s_nationkey").cast("int").alias("NBVELOS"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of stations with coordinates and levels."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.cast("int").alias("station_id"),
        F.col("s_name").alias("station_name"),
        F.concat(F.lit("44."), (800 + k % 97).cast("string")).cast("double").alias("lat"),
        F.concat(F.lit("-0."), (511 + k % 89).cast("string")).cast("double").alias("lon"),
        (k % 31).cast("int").alias("available_stands"),
        F.col("s_nationkey").cast("int").alias("available_bikes"),
        F.when(k % 7 == 0, -1).otherwise(1).alias("anomaly"),
    )


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station control table of the map."""
    k = F.col("s_suppkey")
    ill = (k % 7 == 0).cast("int")
    since = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.cast("int").alias("station_id"),
        ((k % 20) / F.lit(100.0)).alias("mean_activity"),
        ill.alias("is_anomaly"),
        (k % 11 == 0).cast("int").alias("is_inactive"),
        F.col("s_nationkey").cast("int").alias("available_bikes"),
        F.concat(F.lit("44."), (800 + k % 97).cast("string")).cast("double").alias("lat"),
        F.concat(F.lit("-0."), (511 + k % 89).cast("string")).cast("double").alias("lon"),
        F.col("s_name").alias("NOM"),
        F.when(ill == 1, since).alias("last_date_anomaly"),
        F.when(ill == 1, since).alias("anomaly_since"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather: an aggregate of the events of the same hour one day before, so the first day has none."""
    hour = F.window("ts", "1 hour").start
    return (
        table(spark, sf_dir, "events")
        .groupBy(hour.alias("_hour"))
        .agg(F.max("value").alias("temperature"), F.min("value").alias("wind_speed"), F.count("*").alias("humidity"))
        .select((F.col("_hour") + F.make_dt_interval(F.lit(1))).alias("date"), "temperature", "wind_speed", "humidity")
    )


def station_profile(spark: SparkSession, sf_dir: str, grid: DataFrame | None = None) -> DataFrame:
    """Profile labels of the four stations, from the share of rows with a departure."""
    share = F.avg(F.when(F.col("transactions_out") >= 1, 1.0).otherwise(0.0))
    label = F.when(F.col("station_id") % 2 == 0, "medium").otherwise("low")
    rows = activity(spark, sf_dir) if grid is None else grid
    return rows.groupBy("station_id").agg(share.alias("mean")).withColumn(
        "profile_station_activity", label
    )


def calendar_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"quarter": F.quarter("date"), "weekday": iso_weekday(), "hours": F.hour("date")})


def offset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records as the GeoJSON feed gives them; the same instant is written with one of two offsets."""
    levels = _levels()
    even = F.col("event_id") % 2 == 0
    second = F.window("ts", "1 second").start
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    local = F.when(even, F.col("_second")).otherwise(F.col("_second") + hour)
    text = F.concat(
        F.replace(F.substring(local.cast("string"), 1, 19), F.lit(" "), F.lit("T")),
        F.when(even, "+00:00").otherwise("+01:00"),
    )
    state = (
        F.when(F.col("event_type") == "error", "DECONNECTEE")
        .when(F.col("event_type") == "view", "MAINTENANCE")
        .when(F.col("event_type") == "signup", "AUTRE CHOSE ???")
        .otherwise("CONNECTEE")
    )
    events = table(spark, sf_dir, "events").withColumn("_second", second)
    return events.select(
        "event_id",
        F.col("ts").alias("_ts"),
        text.alias("time"),
        F.col("event_id").alias("gid"),
        (F.col("user_id") % 4).alias("ident"),
        F.concat(F.lit("Station "), (F.col("user_id") % 4).cast("string")).alias("nom"),
        state.alias("etat"),
        levels["available_stands"].alias("nbplaces"),
        levels["available_bikes"].alias("nbvelos"),
    )


def geojson_text(records: DataFrame) -> DataFrame:
    """FeatureCollections of at most 500 features as JSON text: ``json``."""
    properties = F.struct("time", "gid", "ident", "nom", "etat", "nbplaces", "nbvelos").alias("properties")
    feature = F.struct(F.lit("Feature").alias("type"), properties)
    docs = records.groupBy(F.floor(F.col("event_id") / 500).alias("_doc")).agg(F.collect_list(feature).alias("features"))
    return docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("json"))


def array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with parallel arrays per station, at most 500 polls each: ``json``."""
    levels = _levels()
    second = F.replace(F.substring(F.col("_second").cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    word = F.when(F.col("event_type") == "error", "closed").when(F.col("event_type") == "view", "halted").otherwise("open")
    poll = F.struct(
        levels["available_bikes"].alias("available_bikes"), levels["available_stands"].alias("available_stands"),
        word.alias("status"), second.alias("ts"),
    )
    events = table(spark, sf_dir, "events").withColumn("_second", F.window("ts", "1 second").start)
    listed = events.groupBy(
        (F.col("user_id") % 4).cast("string").alias("id"), F.floor(F.col("event_id") / 500).alias("_doc")
    ).agg(F.collect_list(poll).alias("_p"))
    names = ("available_bikes", "available_stands", "status", "ts")
    station = F.struct("id", *[F.col(f"_p.{n}").alias(n) for n in names])
    docs = listed.groupBy("_doc").agg(F.collect_list(station).alias("data"))
    return docs.select(F.to_json(F.struct("data")).alias("json"))


# ---- the same as SQL ----------------------------------------------------------------------------------------

MOVED = """
    CASE WHEN available_bikes - coalesce(lag(available_bikes) OVER w, available_bikes) < 0 THEN 0
         ELSE available_bikes - coalesce(lag(available_bikes) OVER w, available_bikes) END AS transactions_in,
    CASE WHEN available_stands - coalesce(lag(available_stands) OVER w, available_stands) < 0 THEN 0
         ELSE available_stands - coalesce(lag(available_stands) OVER w, available_stands) END AS transactions_out,
    abs(available_bikes - coalesce(lag(available_bikes) OVER w, available_bikes)) AS transactions_all"""

IS_IDLE = """CASE WHEN transactions_out >= 1 OR status = 0 OR available_bikes <= 2 OR available_stands IS NULL
    THEN 0 ELSE 1 END"""


def moves_sql(source: str, order: str = "date") -> str:
    return f"SELECT *, {MOVED} FROM {source} WINDOW w AS (PARTITION BY station_id ORDER BY {order})"


def grid_sql(source: str) -> str:
    return f"""SELECT station_id, time_bucket(INTERVAL '10 minutes', date) + INTERVAL '10 minutes' AS date,
        last(available_stands ORDER BY date) AS available_stands,
        last(available_bikes ORDER BY date) AS available_bikes,
        CAST(max(status) AS INTEGER) AS status,
        CAST(sum(transactions_in) AS BIGINT) AS transactions_in,
        CAST(sum(transactions_out) AS BIGINT) AS transactions_out,
        CAST(sum(transactions_all) AS BIGINT) AS transactions_all
    FROM {source} GROUP BY station_id, time_bucket(INTERVAL '10 minutes', {source}.date) + INTERVAL '10 minutes'"""


def idle_sql(source: str, order: str = "date") -> str:
    return f"""SELECT * EXCLUDE (idle_flag, island), CAST(sum(idle_flag) OVER (PARTITION BY station_id, island
            ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_no_transactions_out
        FROM (SELECT *, sum(1 - idle_flag) OVER (PARTITION BY station_id ORDER BY {order} ROWS UNBOUNDED PRECEDING)
                AS island
            FROM (SELECT *, {IS_IDLE} AS idle_flag FROM {source}))"""


CTES = {
    "polls": """SELECT CAST(user_id % 4 AS INTEGER) AS station_id, ts AS date, event_id,
        CAST(floor(value) AS BIGINT) % 41 AS available_bikes, 40 - CAST(floor(value) AS BIGINT) % 41 AS available_stands,
        CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status FROM events""",
    "unique_polls": """SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY station_id, date
        ORDER BY event_id) AS copy FROM polls) WHERE copy = 1""",
    "moves": moves_sql("unique_polls"),
    "activity": grid_sql("moves"),
    "idle": idle_sql("activity"),
    "flagged": "SELECT *, CASE WHEN consecutive_no_transactions_out >= 2 THEN -1 ELSE 1 END AS anomaly FROM idle",
    "open_data": """SELECT '44.' || (800 + s_suppkey % 97) || ',-0.' || (511 + s_suppkey % 89) AS "Geo Point",
        '{"type": "Point", "coordinates": [-0.' || (511 + s_suppkey % 89) || ', 44.' || (800 + s_suppkey % 97) || ']}'
            AS "Geo Shape",
        'Commune ' || s_nationkey AS commune, CAST(s_suppkey AS INTEGER) AS "IDENT", 'VLS' AS "TYPE", s_name AS "NOM",
        CAST(s_suppkey % 31 AS INTEGER) AS "NBPLACES", CAST(s_nationkey AS INTEGER) AS "NBVELOS" FROM supplier""",
    "stations": """SELECT CAST(s_suppkey AS INTEGER) AS station_id, s_name AS station_name,
        CAST('44.' || (800 + s_suppkey % 97) AS DOUBLE) AS lat, CAST('-0.' || (511 + s_suppkey % 89) AS DOUBLE) AS lon,
        CAST(s_suppkey % 31 AS INTEGER) AS available_stands, CAST(s_nationkey AS INTEGER) AS available_bikes,
        CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE 1 END AS anomaly FROM supplier""",
    "control": """SELECT CAST(s_suppkey AS INTEGER) AS station_id, (s_suppkey % 20) / 100e0 AS mean_activity,
        CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS is_anomaly,
        CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS is_inactive, CAST(s_nationkey AS INTEGER) AS available_bikes,
        CAST('44.' || (800 + s_suppkey % 97) AS DOUBLE) AS lat, CAST('-0.' || (511 + s_suppkey % 89) AS DOUBLE) AS lon,
        s_name AS "NOM",
        CASE WHEN s_suppkey % 7 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(s_suppkey) END AS anomaly_since
        FROM supplier""",
    "weather": """SELECT date_trunc('hour', ts) + INTERVAL 1 DAY AS date, max(value) AS temperature,
        min(value) AS wind_speed, count(*) AS humidity FROM events GROUP BY 1""",
    "station_profile": """SELECT station_id, avg(CASE WHEN transactions_out >= 1 THEN 1e0 ELSE 0e0 END) AS mean,
        CASE WHEN station_id % 2 = 0 THEN 'medium' ELSE 'low' END AS profile_station_activity
        FROM activity GROUP BY station_id""",
    "feed": """SELECT event_id, ts, date_trunc('second', ts) + INTERVAL 1 HOUR AS date,
        CAST(user_id % 4 AS INTEGER) AS station_id, 40 - CAST(floor(value) AS BIGINT) % 41 AS available_stands,
        CAST(floor(value) AS BIGINT) % 41 AS available_bikes,
        CASE WHEN event_type IN ('error', 'view', 'signup') THEN 0 ELSE 1 END AS status FROM events""",
    "feed_polls": """SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY station_id, date
        ORDER BY available_stands, available_bikes, status) AS copy FROM feed) WHERE copy = 1""",
    "feed_moves": moves_sql("feed_polls"),
    "feed_grid": grid_sql("feed_moves"),
}

#: What each derivation is built on.
NEEDS = {
    "unique_polls": ["polls"], "moves": ["unique_polls"], "activity": ["moves"], "idle": ["activity"], "flagged": ["idle"],
    "station_profile": ["activity"], "feed_polls": ["feed"], "feed_moves": ["feed_polls"], "feed_grid": ["feed_moves"],
}


def sql(select: str, *names: str, **extra: str) -> str:
    """``select`` preceded by the named derivations, what those need, and ``extra`` ones in their order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS MATERIALIZED ({text})" for n, text in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


GRID_COLUMNS = ", ".join(ACTIVITY_COLUMNS)
