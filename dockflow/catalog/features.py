"""Queries: scalar functions, filters, movements, windows and forecast features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dockflow.catalog import inputs as I
from dockflow.catalog.inputs import GRID_COLUMNS, sql
from dockflow.functions.calendar import display_date, process_data_cluster, process_temporal_feat, zone_wall_clock
from dockflow.functions.durations import offset_by
from dockflow.functions.geo import geodesic_km, get_distance, ride_minutes
from dockflow.functions.scalars import (
    activity_bit,
    anomaly_probability,
    capacity,
    hover_text,
    parameter_map,
    point_part,
    station_state,
    state_colour,
    state_rank,
    status_flag,
)
from dockflow.models.forecast import get_feature_to_use_for_model
from dockflow.operators import filters, lookups
from dockflow.operators.completeness import hourly_problems
from dockflow.operators.grid import deduplicate, hourly_totals, resample_activity, upsample
from dockflow.operators.movement import (
    add_movements,
    add_movements_and_idle,
    get_transactions_all,
    get_transactions_in,
    get_transactions_out,
    smooth_status,
)
from dockflow.operators.rolling import WINDOWS, build_feat_for_regression
from dockflow.operators.timeline import forward_fill, running_sum
from dockflow.schemas import GEOJSON_STATUS

TIE = {"ties": ["event_id"], "chunk": I.RAW}
MOVE_KEYS = ("station_id", "date", "event_id")


def rounded(column, places=9):
    return F.round(column, places) + 0.0


def r(expression, places=9):
    return f"(round({expression}, {places}) + 0.0)"


# -- movements ------------------------------------------------------------------------------------------------


def movement_query(function, name):
    def build(spark, sf_dir):
        return function(I.polls(spark, sf_dir), **TIE).select(*MOVE_KEYS, name)

    return build, sql(f"SELECT station_id, date, event_id, {name} FROM m", "polls", m=I.moves_sql("polls", "date, event_id"))


def idle_run(spark, sf_dir):
    moved = add_movements_and_idle(I.polls(spark, sf_dir), ["transactions_out"], **TIE)
    return moved.select(*MOVE_KEYS, "transactions_out", "consecutive_no_transactions_out")


IDLE_RUN = sql(
    "SELECT station_id, date, event_id, transactions_out, consecutive_no_transactions_out FROM i",
    "polls", m=I.moves_sql("polls", "date, event_id"), i=I.idle_sql("m", "date, event_id"),
)


def forward_filled(spark, sf_dir):
    holes = I.polls(spark, sf_dir).withColumn(
        "available_bikes", F.when(F.col("status") == 1, F.col("available_bikes"))
    )
    return forward_fill(holes, "available_bikes", ties=["event_id"], chunk=I.RAW).select(*MOVE_KEYS, "available_bikes")


FORWARD_FILLED = sql(
    """SELECT station_id, date, event_id, last_value(CASE WHEN status = 1 THEN available_bikes END IGNORE NULLS) OVER
    (PARTITION BY station_id ORDER BY date, event_id ROWS UNBOUNDED PRECEDING) AS available_bikes FROM polls""", "polls")


def smoothed_status(spark, sf_dir):
    return smooth_status(I.polls(spark, sf_dir), **TIE).select(*MOVE_KEYS, "status")


SMOOTHED_STATUS = sql(
    """SELECT station_id, date, event_id, CAST(CASE WHEN status <> 0 THEN status WHEN lead(status) OVER (PARTITION BY
    station_id ORDER BY date, event_id) = 1 THEN 1 ELSE 0 END AS INTEGER) AS status FROM polls""", "polls")


def normal_rows_so_far(spark, sf_dir):
    normal = F.when(F.col("status") == 1, 1).otherwise(0)
    out = running_sum(I.polls(spark, sf_dir), normal, "anomaly_grp", "station_id", "date", **TIE)
    return out.select(*MOVE_KEYS, "anomaly_grp")


NORMAL_ROWS = sql(
    """SELECT station_id, date, event_id, CAST(sum(CASE WHEN status = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY
    station_id ORDER BY date, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS anomaly_grp FROM polls""", "polls")


# -- grid -----------------------------------------------------------------------------------------------------


def grid_from_polls(spark, sf_dir):
    return I.activity(spark, sf_dir)


def grid_from_movements(spark, sf_dir):
    return resample_activity(add_movements(I.unique_polls(spark, sf_dir), chunk=I.RAW))


GRID = sql(f"SELECT {GRID_COLUMNS} FROM activity", "activity")


def minute_polls(spark, sf_dir):
    return I.polls(spark, sf_dir).withColumn("date", F.window("date", "1 minute").start)


def deduplicated(spark, sf_dir):
    return deduplicate(minute_polls(spark, sf_dir), order=["event_id"])


DEDUPLICATED = sql(
    """SELECT * EXCLUDE (copy) FROM (SELECT * REPLACE (date_trunc('minute', date) AS date), row_number() OVER
    (PARTITION BY station_id, date_trunc('minute', date) ORDER BY event_id) AS copy FROM polls) WHERE copy = 1""", "polls")


def upsampled(spark, sf_dir):
    return upsample(I.activity(spark, sf_dir))


UPSAMPLED = sql(
    """SELECT s.station_id, s.date, available_stands, available_bikes, status,
        coalesce(transactions_in, 0) AS transactions_in, coalesce(transactions_out, 0) AS transactions_out,
        coalesce(transactions_all, 0) AS transactions_all
    FROM (SELECT station_id, unnest(generate_series(min(date), max(date), INTERVAL '10 minutes')) AS date
          FROM activity GROUP BY station_id) s LEFT JOIN activity a ON a.station_id = s.station_id AND a.date = s.date""",
    "activity")


def hourly(spark, sf_dir):
    return hourly_totals(I.activity(spark, sf_dir), "transactions_all")


HOURLY_TOTALS = """SELECT station_id, date_trunc('hour', date) + INTERVAL 1 HOUR AS date,
    CAST(sum(transactions_all) AS BIGINT) AS transactions_all FROM activity WHERE status = 1
    GROUP BY station_id, date_trunc('hour', activity.date) + INTERVAL 1 HOUR"""
HOURLY_GRID = """SELECT h.station_id, h.date, coalesce(t.transactions_all, 0) AS transactions_all
    FROM (SELECT station_id, unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date
          FROM totals GROUP BY station_id) h LEFT JOIN totals t ON t.station_id = h.station_id AND t.date = h.date"""
HOURLY = sql("SELECT * FROM hourly", "activity", totals=HOURLY_TOTALS, hourly=HOURLY_GRID)


# -- scalars --------------------------------------------------------------------------------------------------


def renamed(spark, sf_dir):
    raw = I.table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "station_id", "ts": "date"})
    return raw.drop("props", "value").select("station_id", "date", "event_id", "event_type")


def status_flags(spark, sf_dir):
    return I.offset_times(spark, sf_dir).select("event_id", status_flag("etat", GEOJSON_STATUS).alias("status"))


def casts(spark, sf_dir):
    events = I.table(spark, sf_dir, "events").withColumn("_s", F.window("ts", "1 second").start)
    text = F.replace(F.substring(F.col("_s").cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    typed = events.select("event_id", F.col("user_id").cast("string").alias("id"), text.alias("ts"))
    return typed.select(
        "event_id", F.col("id").cast("int").alias("station_id"),
        F.to_timestamp_ntz("ts", F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("date"),
    )


def station_capacity(spark, sf_dir):
    return I.open_data(spark, sf_dir).select("IDENT", capacity().alias("total_stand"))


def activity_bits(spark, sf_dir):
    return I.activity(spark, sf_dir).select("station_id", "date", activity_bit().alias("transactions_out_bool"))


def states(spark, sf_dir):
    return I.control(spark, sf_dir).select("station_id", station_state().alias("etat")).withColumns(
        {"colour": state_colour(), "etat_id_sort": state_rank()}
    )


STATE = """CASE WHEN is_inactive = 1 THEN 'inactive' WHEN is_anomaly = 1 THEN 'anomaly'
    WHEN mean_activity < 0.06 THEN 'non surveillée' ELSE 'normal' END"""
COLOUR = """CASE etat WHEN 'anomaly' THEN '#EB4D50' WHEN 'inactive' THEN '#5E9BE6' WHEN 'normal' THEN '#6DDE75'
    WHEN 'non surveillée' THEN '#696A6A' END"""
RANK = """CASE etat WHEN 'non surveillée' THEN 0 WHEN 'normal' THEN 1 WHEN 'anomaly' THEN 2
    WHEN 'inactive' THEN 3 END"""


def display_fill(spark, sf_dir):
    return I.control(spark, sf_dir).select("station_id", F.coalesce(display_date("anomaly_since"), F.lit("-")).alias("since"))


def hover_texts(spark, sf_dir):
    control = I.control(spark, sf_dir).withColumn(
        "anomaly_since_str", F.coalesce(display_date("anomaly_since"), F.lit("-"))
    )
    return control.select("station_id", hover_text().alias("text"))


def point_parts(spark, sf_dir):
    return I.open_data(spark, sf_dir).select(
        "IDENT", point_part("`Geo Point`", 0).alias("lat"), point_part("`Geo Point`", 1).alias("lon")
    )


def requests(spark, sf_dir):
    text = F.concat(
        F.lit("target_station_id="), F.col("s_suppkey").cast("string"), F.lit(", target_col = "),
        F.when(F.col("s_suppkey") % 2 == 0, "available_bikes").otherwise("available_stands"),
        F.lit(" ,horizon_prediction="), (F.col("s_nationkey") + 10).cast("string"), F.lit("m"),
    )
    asked = I.table(spark, sf_dir, "supplier").select("s_suppkey", parameter_map(text).alias("p"))
    return asked.select(
        "s_suppkey", F.col("p")["target_station_id"].cast("int").alias("target_station_id"),
        F.col("p")["target_col"].alias("target_col"), F.col("p")["horizon_prediction"].alias("horizon_prediction"),
    )


def paris_time(spark, sf_dir):
    return I.offset_times(spark, sf_dir).select("event_id", zone_wall_clock("time").alias("date"))


def calendar_fields(spark, sf_dir):
    return I.polls(spark, sf_dir).select(
        "event_id", F.quarter("date").alias("quarter"), (F.weekday("date") + 1).alias("weekday"),
        F.hour("date").alias("hours"), F.minute("date").alias("minutes"), F.month("date").alias("month"),
    )


def offset_dates(spark, sf_dir):
    polls = I.polls(spark, sf_dir)
    return polls.select(
        "event_id", offset_by("date", "30m").alias("plus_30m"), offset_by("date", "2h10m").alias("plus_2h10m"),
        offset_by("date", "1mo").alias("plus_1mo"), offset_by("date", "1w").alias("plus_1w"),
    )


def display_dates(spark, sf_dir):
    return I.polls(spark, sf_dir).select("event_id", display_date("date").alias("shown"))


def _waves(df, parts):
    return df.select(
        "event_id", *[rounded(F.col(f"{w}_{p}")).alias(f"{w.lower()}_{p}") for p in parts for w in ("Sin", "Cos")]
    )


def detector_calendar(spark, sf_dir):
    return _waves(process_data_cluster(I.polls(spark, sf_dir)), ("quarter", "weekday", "hours"))


def forecast_calendar(spark, sf_dir):
    return _waves(process_temporal_feat(I.polls(spark, sf_dir)), ("weekday", "hours", "minutes"))


FIELD = {"quarter": "quarter(date)", "weekday": "isodow(date)", "hours": "hour(date)", "minutes": "minute(date)"}


def wave_sql(parts: dict) -> str:
    cols = [
        f"{r(f'{w}({2 * math.pi / top!r}::DOUBLE * {FIELD[p]})')} AS {w}_{p}" for p, top in parts.items() for w in ("sin", "cos")
    ]
    return sql(f"SELECT event_id, {', '.join(cols)} FROM polls", "polls")


def probabilities(spark, sf_dir):
    decision = (F.floor("value") % 41 - 20) / F.lit(100.0)
    return I.table(spark, sf_dir, "events").select(
        "event_id", rounded(anomaly_probability(decision) * 100, 6).alias("anomaly_score")
    )


def rounded_forecast(spark, sf_dir):
    half = F.floor(F.col("value") * 2) / F.lit(2.0)
    return I.table(spark, sf_dir, "events").select("event_id", F.round(half).cast("int").alias("y_pred"))


# -- distances ------------------------------------------------------------------------------------------------

POINT = (44.8404215, -0.5704848)


def haversine(spark, sf_dir):
    return I.stations(spark, sf_dir).select("station_id", rounded(get_distance(*POINT, "lat", "lon"), 6).alias("km"))


HAVERSINE = """2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"""
HAVERSINE_H = f"""pow(sin((radians(lat) - radians({POINT[0]}::DOUBLE)) / 2), 2) + cos(radians({POINT[0]}::DOUBLE))
    * cos(radians(lat)) * pow(sin((radians(lon) - radians({POINT[1]}::DOUBLE)) / 2), 2)"""


def geodesic(spark, sf_dir):
    return I.stations(spark, sf_dir).select("station_id", rounded(geodesic_km(*POINT, "lat", "lon"), 6).alias("km"))


def _geodesic_steps() -> dict[str, str]:
    """The ellipsoid iteration written out: one materialised step per round, then ``g`` with the distance."""
    f, a = "(1 / 298.257223563::DOUBLE)", "6378.137::DOUBLE"
    b = f"({a} * (1 - {f}))"
    u1, u2 = f"atan((1 - {f}) * tan(radians({POINT[0]}::DOUBLE)))", f"atan((1 - {f}) * tan(radians(lat)))"
    steps = {
        "round_0": f"""SELECT *, radians(lon) - radians({POINT[1]}::DOUBLE) AS dl,
            radians(lon) - radians({POINT[1]}::DOUBLE) AS lam, sin({u1}) AS s1, cos({u1}) AS c1, sin({u2}) AS s2,
            cos({u2}) AS c2, 0e0 AS ss, 0e0 AS cs, 0e0 AS sg, 0e0 AS ca, 0e0 AS md FROM stations"""
    }
    rounds = 8
    for i in range(rounds):
        sides = f"""SELECT * REPLACE (sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss,
            s1 * s2 + c1 * c2 * cos(lam) AS cs) FROM round_{i}"""
        angle = f"SELECT * REPLACE (atan2(ss, cs) AS sg), c1 * c2 * sin(lam) / ss AS sa FROM ({sides})"
        middle = f"SELECT * REPLACE (1 - sa * sa AS ca, cs - 2 * s1 * s2 / (1 - sa * sa) AS md) FROM ({angle})"
        factor = f"SELECT *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS cc FROM ({middle})"
        steps[f"round_{i + 1}"] = f"""SELECT * EXCLUDE (sa, cc) REPLACE (dl + (1 - cc) * {f} * sa * (sg + cc * ss *
            (md + cc * cs * (2 * md * md - 1))) AS lam) FROM ({factor})"""
    squared = f"SELECT *, ca * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS k2 FROM round_{rounds}"
    series = f"""SELECT *, 1 + k2 / 16384 * (4096 + k2 * (k2 * (320 - 175 * k2) - 768)) AS aa,
        k2 / 1024 * (256 + k2 * (k2 * (74 - 47 * k2) - 128)) AS bb FROM ({squared})"""
    shift = """bb * ss * (md + bb / 4 * (cs * (2 * md * md - 1) - bb / 6 * md * (4 * ss * ss - 3) *
        (4 * md * md - 3)))"""
    steps["g"] = f"SELECT *, {b} * aa * (sg - {shift}) AS distance FROM ({series})"
    return steps


GEODESIC = _geodesic_steps()


def ride_times(spark, sf_dir):
    return I.stations(spark, sf_dir).select(
        "station_id", rounded(ride_minutes(get_distance(*POINT, "lat", "lon")), 6).alias("minutes")
    )


def nearest(spark, sf_dir):
    near = lookups.find_nearest_stations(I.stations(spark, sf_dir), *POINT, nombre_station_proche=5)
    return near.select("station_id", "station_name", rounded("distance", 6).alias("distance"))


def nearest_haversine(spark, sf_dir):
    near = lookups.find_nearest_stations(I.stations(spark, sf_dir), *POINT, 5, method="haversine")
    return near.select("station_id", "station_name", rounded("distance", 6).alias("distance"))


# -- filters and snapshots ------------------------------------------------------------------------------------


def open_period(spark, sf_dir):
    return filters.filter_periode(I.activity(spark, sf_dir), [2], I.PERIOD)


OUTSIDE = f"NOT (date BETWEEN TIMESTAMP '{I.PERIOD[0]}' AND TIMESTAMP '{I.PERIOD[1]}')"


def usable(spark, sf_dir):
    return filters.usable_rows(I.idle_activity(spark, sf_dir), I.MAX_IDLE)


def one_station(spark, sf_dir):
    return I.activity(spark, sf_dir).where(F.col("station_id") == 3)


def sliced(spark, sf_dir):
    return filters.date_slice(I.activity(spark, sf_dir), "2024-01-05 00:10:00", "2024-01-20 00:00:00")


def guarded_station(spark, sf_dir):
    rows = I.activity(spark, sf_dir)
    filters.require_station(rows, 1)
    return rows.where(F.col("station_id") == 1).select("station_id", "date", "available_stands")


def no_such_station(spark, sf_dir):
    return I.idle_activity(spark, sf_dir).where(F.col("station_id") == -5)


def newest_overall(spark, sf_dir):
    return filters.latest_rows(I.activity(spark, sf_dir))


def newest_per_station(spark, sf_dir):
    return filters.latest_rows(I.activity(spark, sf_dir), scope="station")


def named_exactly(spark, sf_dir):
    return filters.named_stations(I.stations(spark, sf_dir), "Supplier#000000007")


def named_like(spark, sf_dir):
    return filters.named_stations(I.stations(spark, sf_dir), "suppLIER#00000000", exact=False)


def in_anomaly(spark, sf_dir):
    return filters.stations_in_anomaly(I.stations(spark, sf_dir))


def most_bikes(spark, sf_dir):
    return lookups.extreme_stations(I.stations(spark, sf_dir))


def fewest_bikes(spark, sf_dir):
    return lookups.extreme_stations(I.stations(spark, sf_dir), most=False)


def station_count(spark, sf_dir):
    return I.polls(spark, sf_dir).agg(F.countDistinct("station_id").alias("stations"))


def last_forecast_row(spark, sf_dir):
    return filters.latest_rows(I.activity(spark, sf_dir)).orderBy(F.desc("station_id")).limit(1).select(
        "station_id", "date", "available_bikes"
    )


def focus(spark, sf_dir):
    return filters.map_focus(I.stations(spark, sf_dir), station_id=7)


def tilted_focus(spark, sf_dir):
    """The focus of the tilted map on the fullest station, nearer than that of the flat map."""
    fullest = lookups.extreme_stations(I.stations(spark, sf_dir), "available_bikes", most=True).first()["station_id"]
    return filters.map_focus(I.stations(spark, sf_dir), fullest, zoom=15.3)


def without_listed(spark, sf_dir):
    listed = I.stations(spark, sf_dir).where(F.col("anomaly") == -1).select("station_id")
    return filters.without_stations(I.stations(spark, sf_dir), listed)


# -- joins and forecast features --------------------------------------------------------------------------------


def future_target(spark, sf_dir):
    return lookups.create_target(I.stored_activity(spark, sf_dir), "available_bikes", "30m").select(
        "station_id", "date", "available_bikes", "target"
    )


FUTURE = """SELECT a.station_id, a.date, a.available_bikes, b.available_bikes AS target FROM activity a
    LEFT JOIN activity b ON b.station_id = a.station_id AND b.date = a.date + INTERVAL '30 minutes'"""


def labelled(spark, sf_dir):
    return filters.labelled_rows(future_target(spark, sf_dir))


def with_weather(spark, sf_dir):
    return lookups.get_meteo(I.polls(spark, sf_dir), I.weather(spark, sf_dir)).select(
        "event_id", "temperature", "wind_speed", "humidity"
    )


def with_profiles(spark, sf_dir):
    rows = I.activity(spark, sf_dir).select("station_id", "date")
    return lookups.with_profile(rows, I.station_profile(spark, sf_dir))


FORECAST_COLUMNS = get_feature_to_use_for_model("available_bikes")[6:]


def lags_and_rolling(spark, sf_dir):
    built = build_feat_for_regression(I.stored_activity(spark, sf_dir).select("station_id", "date", "available_bikes"), "available_bikes")
    return built.select("station_id", "date", *FORECAST_COLUMNS)


def hourly_completeness(spark, sf_dir):
    """Missing, doubled and unordered hours of each station's polls, in the order of their events."""
    return hourly_problems(I.polls(spark, sf_dir).select("station_id", "date", "event_id"), "event_id")


HOURLY_COMPLETENESS = sql("""SELECT c.station_id, h AS hour, 'missing' AS problem, CAST(0 AS BIGINT) AS n FROM (SELECT station_id,
        unnest(range(min(hour), max(hour) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM hours GROUP BY station_id) c
        ANTI JOIN hours ON hours.station_id = c.station_id AND hours.hour = h
    UNION ALL SELECT station_id, hour, 'doubled', count(*) FROM hours GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT station_id, hour, 'unordered', count(*) FROM (SELECT *, lag(hour) OVER (PARTITION BY station_id ORDER BY event_id) AS before FROM hours)
        WHERE hour < before GROUP BY ALL""", "polls", hours="SELECT station_id, date_trunc('hour', date) AS hour, event_id FROM polls")


def _rolling_sql() -> str:
    cols = [f"lag(available_bikes, {n}) OVER w AS available_bikes_lag_{n}" for n in (1, 2, 3)]
    for side in ("max", "min"):
        for suffix, rows in WINDOWS.items():
            frame = f"(PARTITION BY station_id ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
            cols.append(
                f"CASE WHEN count(available_bikes) OVER {frame} = {rows} THEN {side}(available_bikes) OVER {frame} END "
                f"AS available_bikes_rolling_{side}_{suffix}"
            )
    return sql(
        f"SELECT station_id, date, {', '.join(cols)} FROM activity WINDOW w AS (PARTITION BY station_id ORDER BY date)",
        "activity",
    )


QUERIES = {
    "transactions_out": movement_query(get_transactions_out, "transactions_out"),
    "transactions_in": movement_query(get_transactions_in, "transactions_in"),
    "transactions_all": movement_query(get_transactions_all, "transactions_all"),
    "idle_run": (idle_run, IDLE_RUN),
    "forward_fill": (forward_filled, FORWARD_FILLED),
    "smoothed_status": (smoothed_status, SMOOTHED_STATUS),
    "normal_rows_so_far": (normal_rows_so_far, NORMAL_ROWS),
    "grid_from_polls": (grid_from_polls, GRID),
    "grid_from_movements": (grid_from_movements, GRID),
    "deduplicated_polls": (deduplicated, DEDUPLICATED),
    "upsampled_grid": (upsampled, UPSAMPLED),
    "hourly_totals": (hourly, HOURLY),
    "sorted_activity": (lambda s, d: I.activity(s, d).orderBy("station_id", "date"), GRID),
    "renamed_columns": (renamed, "SELECT user_id AS station_id, ts AS date, event_id, event_type FROM events"),
    "status_flags": (status_flags, sql("SELECT event_id, status FROM feed", "feed")),
    "typed_columns": (casts, "SELECT event_id, CAST(user_id AS INTEGER) AS station_id, date_trunc('second', ts) AS date FROM events"),
    "station_capacity": (station_capacity, sql('SELECT "IDENT", "NBPLACES" + "NBVELOS" AS total_stand FROM open_data', "open_data")),
    "activity_bit": (activity_bits, sql("SELECT station_id, date, least(greatest(transactions_out, 0), 1) AS transactions_out_bool FROM activity", "activity")),
    "station_states": (states, sql(f"SELECT station_id, etat, {COLOUR} AS colour, {RANK} AS etat_id_sort FROM (SELECT station_id, {STATE} AS etat FROM control)", "control")),
    "display_fill": (display_fill, sql("SELECT station_id, coalesce(strftime(anomaly_since, '%Y-%m-%d %H:%M'), '-') AS since FROM control", "control")),
    "hover_text": (hover_texts, sql("""SELECT station_id, "NOM" || ' <br />station N° : ' || station_id || ' <br />Nombre de vélo dispo : '
        || available_bikes || ' <br />Activité suspecte depuis : ' || coalesce(strftime(anomaly_since, '%Y-%m-%d %H:%M'), '-') AS text FROM control""", "control")),
    "point_split": (point_parts, sql("""SELECT "IDENT", CAST(split_part("Geo Point", ',', 1) AS DOUBLE) AS lat, CAST(split_part("Geo Point", ',', 2) AS DOUBLE) AS lon FROM open_data""", "open_data")),
    "request_parameters": (requests, """SELECT s_suppkey, CAST(s_suppkey AS INTEGER) AS target_station_id, CASE WHEN s_suppkey % 2 = 0
        THEN 'available_bikes' ELSE 'available_stands' END AS target_col, (s_nationkey + 10) || 'm' AS horizon_prediction FROM supplier"""),
    "paris_wall_clock": (paris_time, sql("SELECT event_id, date FROM feed", "feed")),
    "calendar_fields": (calendar_fields, sql("""SELECT event_id, CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) AS INTEGER) AS weekday,
        CAST(hour(date) AS INTEGER) AS hours, CAST(minute(date) AS INTEGER) AS minutes, CAST(month(date) AS INTEGER) AS month FROM polls""", "polls")),
    "offset_dates": (offset_dates, sql("""SELECT event_id, date + INTERVAL '30 minutes' AS plus_30m, date + INTERVAL '130 minutes' AS plus_2h10m,
        date + INTERVAL '1 month' AS plus_1mo, date + INTERVAL '7 days' AS plus_1w FROM polls""", "polls")),
    "display_dates": (display_dates, sql("SELECT event_id, strftime(date, '%Y-%m-%d %H:%M') AS shown FROM polls", "polls")),
    "detector_calendar": (detector_calendar, wave_sql({"quarter": 4, "weekday": 7, "hours": 24})),
    "forecast_calendar": (forecast_calendar, wave_sql({"weekday": 7, "hours": 24, "minutes": 6})),
    "anomaly_probability": (probabilities, f"SELECT event_id, {r('100 / (1 + exp(20 * ((CAST(floor(value) AS BIGINT) % 41 - 20) / 100e0)))', 6)} AS anomaly_score FROM events"),
    "rounded_forecast": (rounded_forecast, "SELECT event_id, CAST(round(CAST(floor(value * 2) AS DOUBLE) / 2e0) AS INTEGER) AS y_pred FROM events"),
    "haversine_distance": (haversine, sql(f"SELECT station_id, {r(HAVERSINE, 6)} AS km FROM (SELECT *, {HAVERSINE_H} AS h FROM stations)", "stations")),
    "geodesic_distance": (geodesic, sql(f"SELECT station_id, {r('distance', 6)} AS km FROM g", "stations", **GEODESIC)),
    "ride_time": (ride_times, sql(f"SELECT station_id, {r(HAVERSINE + ' / 15 * 60', 6)} AS minutes FROM (SELECT *, {HAVERSINE_H} AS h FROM stations)", "stations")),
    "nearest_stations": (nearest, sql(f"SELECT station_id, station_name, {r('distance', 6)} AS distance FROM g ORDER BY g.distance, station_id LIMIT 5", "stations", **GEODESIC)),
    "nearest_stations_great_circle": (nearest_haversine, sql(f"""SELECT station_id, station_name, {r('km', 6)} AS distance FROM (SELECT *, {HAVERSINE} AS km
        FROM (SELECT *, {HAVERSINE_H} AS h FROM stations)) ORDER BY km, station_id LIMIT 5""", "stations")),
    "open_period_rows": (open_period, sql(f"SELECT {GRID_COLUMNS} FROM activity WHERE {OUTSIDE} AND station_id NOT IN (2)", "activity")),
    "usable_rows": (usable, sql(f"SELECT * FROM idle WHERE status = 1 AND consecutive_no_transactions_out <= {I.MAX_IDLE}", "idle")),
    "one_station": (one_station, sql(f"SELECT {GRID_COLUMNS} FROM activity WHERE station_id = 3", "activity")),
    "date_slice": (sliced, sql(f"SELECT {GRID_COLUMNS} FROM activity WHERE date >= TIMESTAMP '2024-01-05 00:10:00' AND date <= TIMESTAMP '2024-01-20 00:00:00'", "activity")),
    "guarded_station": (guarded_station, sql("SELECT station_id, date, available_stands FROM activity WHERE station_id = 1", "activity")),
    "unknown_station_is_empty": (no_such_station, sql("SELECT * FROM idle WHERE station_id = -5", "idle")),
    "newest_rows": (newest_overall, sql(f"SELECT {GRID_COLUMNS} FROM activity WHERE date = (SELECT max(date) FROM activity)", "activity")),
    "newest_rows_per_station": (newest_per_station, sql(f"SELECT {GRID_COLUMNS} FROM activity QUALIFY date = max(date) OVER (PARTITION BY station_id)", "activity")),
    "station_by_name": (named_exactly, sql("SELECT * FROM stations WHERE station_name = 'Supplier#000000007'", "stations")),
    "stations_by_text": (named_like, sql("SELECT * FROM stations WHERE contains(lower(station_name), 'supplier#00000000')", "stations")),
    "stations_in_anomaly": (in_anomaly, sql("SELECT * FROM stations WHERE anomaly = -1", "stations")),
    "station_with_most_bikes": (most_bikes, sql("SELECT * FROM stations ORDER BY available_bikes DESC, station_id LIMIT 1", "stations")),
    "station_with_fewest_bikes": (fewest_bikes, sql("SELECT * FROM stations ORDER BY available_bikes, station_id LIMIT 1", "stations")),
    "station_count": (station_count, sql("SELECT count(DISTINCT station_id) AS stations FROM polls", "polls")),
    "last_row": (last_forecast_row, sql("SELECT station_id, date, available_bikes FROM activity WHERE date = (SELECT max(date) FROM activity) ORDER BY station_id DESC LIMIT 1", "activity")),
    "map_focus": (focus, sql("SELECT lat, lon, 15e0 AS zoom FROM stations WHERE station_id = 7", "stations")),
    "map_focus_tilted": (tilted_focus, sql("SELECT lat, lon, 15.3e0 AS zoom FROM stations ORDER BY available_bikes DESC, station_id LIMIT 1", "stations")),
    "stations_not_listed": (without_listed, sql("SELECT * FROM stations WHERE anomaly <> -1", "stations")),
    "future_target": (future_target, sql(FUTURE, "activity")),
    "labelled_rows": (labelled, sql(f"SELECT * FROM ({FUTURE}) WHERE target IS NOT NULL", "activity")),
    "weather_of_the_hour": (with_weather, sql("""SELECT event_id, temperature, wind_speed, humidity FROM polls
        LEFT JOIN weather ON date_trunc('hour', polls.date) = weather.date""", "polls", "weather")),
    "profile_lookup": (with_profiles, sql("SELECT a.station_id, a.date, profile_station_activity FROM activity a LEFT JOIN station_profile p ON p.station_id = a.station_id", "station_profile")),
    "hourly_completeness": (hourly_completeness, HOURLY_COMPLETENESS),
    "lags_and_rolling": (lags_and_rolling, _rolling_sql()),
}
