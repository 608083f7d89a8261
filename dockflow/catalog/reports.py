"""Queries: the tables behind activity, anomaly and map reports."""

from __future__ import annotations

from dockflow.catalog import inputs as I
from dockflow.catalog.features import COLOUR, RANK, STATE, r, rounded
from dockflow.catalog.inputs import sql
from dockflow.catalog.detector_sql import detector_sql, regrid
from dockflow.catalog.models import PERCENTILE, TRAIN, _fleet
from dockflow.catalog.features import HOURLY_GRID, HOURLY_TOTALS
from dockflow.plans import reports
from dockflow.schemas import LEGEND_STATIONS
from dockflow.session import settle


def station_series(spark, sf_dir):
    return reports.station_activity(
        I.activity(spark, sf_dir), 2, ["available_stands", "transactions_all"], "2024-01-03", "2024-01-21"
    )


def heatmap(spark, sf_dir):
    out = reports.activity_heatmap(I.activity(spark, sf_dir), "transactions_all")
    return out.withColumn("value", rounded("value", 6))


def heatmap_median(spark, sf_dir):
    out = reports.activity_heatmap(I.activity(spark, sf_dir), "transactions_all", aggfunc="median")
    return out.withColumn("value", rounded("value", 6))


def heatmap_wide(spark, sf_dir):
    out = reports.activity_heatmap(
        I.activity(spark, sf_dir), "transactions_all", station_id=3, filter_data=True, non_use_station_id=[],
        period=I.PERIOD, wide=True,
    )
    return out.select("station_id", "weekday", *[rounded(f"`{h}`", 6).alias(f"h{h}") for h in range(24)])


HEAT = "SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(hour(date) AS INTEGER) AS hours FROM hourly"
OPEN = f"SELECT * FROM activity WHERE NOT (date BETWEEN TIMESTAMP '{I.PERIOD[0]}' AND TIMESTAMP '{I.PERIOD[1]}')"


def heat_sql(function):
    return sql(
        f"SELECT station_id, weekday, hours, {r(f'{function}(transactions_all)', 6)} AS value FROM heat GROUP BY ALL",
        "activity", totals=HOURLY_TOTALS, hourly=HOURLY_GRID, heat=HEAT)


HEAT_WIDE = sql(
    f"""SELECT station_id, weekday, {', '.join(f"{r(f'avg(transactions_all) FILTER (hours = {h})', 6)} AS h{h}" for h in range(24))}
    FROM heat WHERE station_id = 3 GROUP BY station_id, weekday""",
    "activity", opened=OPEN, totals=HOURLY_TOTALS.replace("activity", "opened"), hourly=HOURLY_GRID, heat=HEAT)


def groups(spark, sf_dir):
    return reports.anomaly_groups(I.flagged(spark, sf_dir)).select("station_id", "date", "anomaly", "anomaly_grp")


GROUPED = """SELECT *, CAST(sum(CASE WHEN anomaly = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY date
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS anomaly_grp FROM flagged"""


def episodes(spark, sf_dir):
    return reports.anomaly_episodes(I.flagged(spark, sf_dir))


EPISODES = sql(
    """SELECT g.station_id, anomaly_grp, min(date) AS min, max(date) AS max, any_value(h.max_value) AS max_value
    FROM grouped g JOIN (SELECT station_id, max(available_bikes) AS max_value FROM flagged GROUP BY station_id) h
    ON h.station_id = g.station_id WHERE anomaly = -1 GROUP BY g.station_id, anomaly_grp""", "flagged", grouped=GROUPED)


def series(spark, sf_dir):
    shown = reports.anomaly_series(I.flagged(spark, sf_dir), "2024-01-02", "2024-01-25")
    return shown.select("station_id", "date", "available_bikes", "consecutive_no_transactions_out", "anomaly", "ano_hover_text")


def extents(spark, sf_dir):
    return reports.series_extent(I.activity(spark, sf_dir))


def _report(spark, sf_dir):
    rows = I.stored_activity(spark, sf_dir)
    models = settle(_fleet(spark, sf_dir, rows=rows))
    return reports.station_anomaly_report(rows, models, with_score=True)


def report_series(spark, sf_dir):
    shown = _report(spark, sf_dir)[0]
    return shown.select("station_id", "date", "anomaly", rounded("anomaly_score", 4).alias("anomaly_score"), "ano_hover_text")


def report_episodes(spark, sf_dir):
    return _report(spark, sf_dir)[1]


#: The report derives movements and idle runs from the levels it is given.
REPORT_SERIES = detector_sql(
    f"""SELECT station_id, date, anomaly, {r('100 / (1 + exp(20e0 * decision))', 4)} AS anomaly_score,
    CASE WHEN anomaly = -1 THEN available_bikes END AS ano_hover_text FROM flags""", TRAIN, PERCENTILE, "again_idle", **regrid(I.MOVED))
REPORT_EPISODES = detector_sql(
    """SELECT g.station_id, anomaly_grp, min(date) AS min, max(date) AS max, any_value(h.max_value) AS max_value FROM
    (SELECT *, CAST(sum(CASE WHEN anomaly = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT)
        AS anomaly_grp FROM flags) g JOIN (SELECT station_id, max(available_bikes) AS max_value FROM flags GROUP BY station_id) h
    ON h.station_id = g.station_id WHERE anomaly = -1 GROUP BY g.station_id, anomaly_grp""", TRAIN, PERCENTILE, "again_idle", **regrid(I.MOVED))


def station_map(spark, sf_dir):
    return reports.station_map(I.control(spark, sf_dir)).drop("last_date_anomaly")


MAP = sql(
    f"""SELECT *, {COLOUR} AS colour, "NOM" || ' <br />station N° : ' || station_id || ' <br />Nombre de vélo dispo : ' ||
    available_bikes || ' <br />Activité suspecte depuis : ' || anomaly_since_str AS text
    FROM (SELECT *, {STATE} AS etat, coalesce(strftime(anomaly_since, '%Y-%m-%d %H:%M'), '-') AS anomaly_since_str
          FROM control)""", "control")


def station_layers(spark, sf_dir):
    return reports.station_map_layers(I.control(spark, sf_dir))


def _literal(value):
    return f"'{value}'" if isinstance(value, str) else f"{value}::DOUBLE" if isinstance(value, float) else str(value)


LAYERS = sql(
    f"""SELECT *, {RANK} AS etat_id_sort FROM (SELECT station_id, mean_activity, is_anomaly, is_inactive, available_bikes,
    lat, lon, "NOM", {STATE} AS etat, coalesce(strftime(anomaly_since, '%Y-%m-%d %H:%M'), '') AS anomaly_since_str
    FROM control UNION ALL VALUES {', '.join('(' + ', '.join(_literal(v) for v in row) + ')' for row in LEGEND_STATIONS)})""",
    "control")


QUERIES = {
    "station_activity": (station_series, sql("""SELECT station_id, date, available_stands, transactions_all FROM activity WHERE station_id = 2
        AND date >= TIMESTAMP '2024-01-03' AND date <= TIMESTAMP '2024-01-21'""", "activity")),
    "activity_heatmap": (heatmap, heat_sql("avg")),
    "activity_heatmap_median": (heatmap_median, heat_sql("median")),
    "activity_heatmap_wide": (heatmap_wide, HEAT_WIDE),
    "anomaly_groups": (groups, sql("SELECT station_id, date, anomaly, anomaly_grp FROM grouped", "flagged", grouped=GROUPED)),
    "anomaly_episodes": (episodes, EPISODES),
    "anomaly_series": (series, sql("""SELECT station_id, date, available_bikes, consecutive_no_transactions_out, anomaly,
        CASE WHEN anomaly = -1 THEN available_bikes END AS ano_hover_text FROM flagged
        WHERE date >= TIMESTAMP '2024-01-02' AND date <= TIMESTAMP '2024-01-25'""", "flagged")),
    "series_extent": (extents, sql("SELECT station_id, min(date) AS min_date, max(date) AS max_date, max(available_bikes) AS max_bikes FROM activity GROUP BY station_id", "activity")),
    "anomaly_report_series": (report_series, REPORT_SERIES),
    "anomaly_report_episodes": (report_episodes, REPORT_EPISODES),
    "station_map": (station_map, MAP),
    "station_map_layers": (station_layers, LAYERS),
}
