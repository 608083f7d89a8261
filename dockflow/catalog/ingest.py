"""Queries: sources, sinks, request plans and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockflow.catalog import inputs as I
from dockflow.catalog.inputs import GRID_COLUMNS, sql
from dockflow.operators.grid import deduplicate, source_steps
from dockflow.plans import ingest, requests
from dockflow.session import scratch_path
from dockflow.sources import readers, writers
from dockflow.streaming import activity as streams

ATTRIBUTES = """"Geo Point", "Geo Shape", commune AS "COMMUNE", "NBPLACES" + "NBVELOS" AS total_stand, "NOM",
    "TYPE" AS "TYPEA", "IDENT" AS station_id, CAST(split_part("Geo Point", ',', 1) AS DOUBLE) AS lat,
    CAST(split_part("Geo Point", ',', 2) AS DOUBLE) AS lon"""


def open_data_projection(spark, sf_dir):
    """The portal's file has more columns than the eight that are read."""
    path = scratch_path(spark, "open-data")
    full = I.open_data(spark, sf_dir).withColumn("GEOM_ERR", F.lit("")).withColumn("ETAT", F.lit("CONNECTEE"))
    columns = ["GEOM_ERR", "IDENT", "Geo Point", "Geo Shape", "commune", "TYPE", "NOM", "ETAT", "NBPLACES", "NBVELOS"]
    writers.write_csv(full.select(*columns), path, sep=";")
    return readers.read_station_open_data(spark, path)


def station_attributes(spark, sf_dir):
    return ingest.create_station_attribute(I.open_data(spark, sf_dir))


def station_attributes_file(spark, sf_dir):
    path = scratch_path(spark, "attributes")
    ingest.create_station_attribute(I.open_data(spark, sf_dir), path)
    return readers.read_stations_attributes(spark, path)


def profile_file(spark, sf_dir):
    path = scratch_path(spark, "profile")
    base = I.stations(spark, sf_dir)
    bikes = F.col("available_bikes")
    table = base.select(
        "station_id", bikes.cast("bigint").alias("total_point"), (bikes / F.lit(32.0)).alias("mean"),
        F.lit(0.0).alias("median"), F.when(bikes > 3, bikes / F.lit(64.0)).alias("std"), F.lit(0.0).alias("95%"),
        F.lit(1.0).alias("98%"), F.lit(1.0).alias("99%"), F.lit(1).cast("bigint").alias("max"),
        F.when(bikes > 12, "hight").otherwise("very high").alias("profile_station_activity"),
    )
    writers.write_csv(table, path)
    return readers.read_station_profile(spark, path)


PROFILE_FILE = sql(
    """SELECT station_id, CAST(available_bikes AS BIGINT) AS total_point, available_bikes / 32e0 AS mean, 0e0 AS median,
    CASE WHEN available_bikes > 3 THEN available_bikes / 64e0 END AS std, 0e0 AS "95%", 1e0 AS "98%", 1e0 AS "99%",
    CAST(1 AS BIGINT) AS max, CASE WHEN available_bikes > 12 THEN 'hight' ELSE 'very high' END
    AS profile_station_activity FROM stations""", "stations")


def learning_dataset_file(spark, sf_dir):
    path = scratch_path(spark, "learning")
    writers.write_activity(I.activity(spark, sf_dir), path)
    return readers.read_learning_dataset(spark, path)


def smoothed_time_series(spark, sf_dir):
    path = scratch_path(spark, "series")
    writers.write_activity(I.activity(spark, sf_dir), path)
    return readers.read_time_serie_activity(spark, path)


SMOOTHED_SERIES = sql(
    """SELECT * REPLACE (CAST(CASE WHEN status <> 0 THEN status WHEN lead(status) OVER (PARTITION BY station_id
    ORDER BY date) = 1 THEN 1 ELSE 0 END AS INTEGER) AS status) FROM activity""", "activity")


def raw_activity_file(spark, sf_dir):
    path = scratch_path(spark, "raw-activity")
    events = I.table(spark, sf_dir, "events").withColumn("_second", F.window("ts", "1 second").start)
    state = F.when(F.col("event_type") == "error", "DECONNECTEE").when(
        F.col("event_type") == "view", "MAINTENANCE").otherwise("CONNECTEE")
    rows = events.select(
        F.col("event_id").cast("int").alias("gid"), (F.col("user_id") % 4).cast("int").alias("ident"),
        F.lit("VLS").alias("type"), F.lit("Meriadeck").alias("name"), state.alias("state"),
        (40 - F.floor("value") % 41).cast("int").alias("available_stands"),
        (F.floor("value") % 41).cast("int").alias("available_bikes"), F.col("_second").alias("ts"),
    )
    writers.write_csv(rows, path)
    return readers.read_raw_activity(spark, path)


RAW_ACTIVITY = """SELECT CAST(event_id AS INTEGER) AS gid, CAST(user_id % 4 AS INTEGER) AS station_id, 'VLS' AS type,
    'Meriadeck' AS name, CASE event_type WHEN 'error' THEN '0' WHEN 'view' THEN 'MAINTENANCE' ELSE '1' END AS state,
    CAST(40 - CAST(floor(value) AS BIGINT) % 41 AS INTEGER) AS available_stands,
    CAST(CAST(floor(value) AS BIGINT) % 41 AS INTEGER) AS available_bikes, date_trunc('second', ts) AS date FROM events"""


def _station_files(spark, sf_dir):
    """Two folders of station CSV, ``<root>/city-*.csv``."""
    root = scratch_path(spark, "cities")
    events = I.table(spark, sf_dir, "events").withColumn("_second", F.window("ts", "1 second").start)
    rows = events.select(
        "event_id", (F.col("user_id") % 4).cast("int").alias("id"), F.col("_second").alias("timestamp"),
        F.when(F.col("event_type") == "error", "closed").otherwise("open").alias("status"),
        (40 - F.floor("value") % 41).cast("int").alias("available_stands"),
        (F.floor("value") % 41).cast("int").alias("available_bikes"),
    )
    for part in (0, 1):
        writers.write_csv(rows.where(F.col("event_id") % 2 == part).drop("event_id"), f"{root}/city-{part}.csv")
    return f"{root}/city-*.csv"


def station_files(spark, sf_dir):
    return readers.read_station_files(spark, _station_files(spark, sf_dir))


def permuted_station_files(spark, sf_dir):
    """Station CSV with its columns in another order and others among them."""
    path = scratch_path(spark, "permuted")
    rows = station_files(spark, sf_dir)
    note = F.concat(F.lit('say "'), F.col("status"), F.lit('", then go'))
    writers.write_csv(rows.select("available_bikes", note.alias("note"), "status", "available_stands", "timestamp", "id"), path)
    return readers.read_station_files(spark, path)


STATION_FILES = """SELECT CAST(user_id % 4 AS INTEGER) AS id, date_trunc('second', ts) AS timestamp,
    CASE WHEN event_type = 'error' THEN 'closed' ELSE 'open' END AS status,
    CAST(40 - CAST(floor(value) AS BIGINT) % 41 AS INTEGER) AS available_stands,
    CAST(CAST(floor(value) AS BIGINT) % 41 AS INTEGER) AS available_bikes FROM events"""


def activity_time_series(spark, sf_dir):
    return ingest.create_activity_time_series(spark, _station_files(spark, sf_dir), scratch_path(spark, "series"))


FILE_POLLS = f"""SELECT * EXCLUDE (copy) FROM (SELECT id AS station_id, timestamp AS date,
    CAST(available_stands AS BIGINT) AS available_stands, CAST(available_bikes AS BIGINT) AS available_bikes,
    CASE status WHEN 'open' THEN 1 ELSE 0 END AS status, row_number() OVER (PARTITION BY id, timestamp
    ORDER BY available_stands, available_bikes, CASE status WHEN 'open' THEN 1 ELSE 0 END) AS copy
    FROM ({STATION_FILES})) WHERE copy = 1"""
TIME_SERIES = sql(
    f"SELECT {GRID_COLUMNS} FROM grid", file_polls=FILE_POLLS, file_moves=I.moves_sql("file_polls"),
    grid=I.grid_sql("file_moves"))


def geojson_features(spark, sf_dir):
    path = scratch_path(spark, "geojson")
    I.geojson_text(I.offset_times(spark, sf_dir)).write.text(path)
    return ingest.flatten_geojson(readers.read_geojson(spark, path)).select(
        F.col("ident").alias("station_id"), F.col("etat"), "nbplaces", "nbvelos",
        F.to_timestamp_ntz(F.substring("time", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("local"),
    )


GEOJSON = """SELECT user_id % 4 AS station_id, CASE event_type WHEN 'error' THEN 'DECONNECTEE' WHEN 'view' THEN 'MAINTENANCE'
    WHEN 'signup' THEN 'AUTRE CHOSE ???' ELSE 'CONNECTEE' END AS etat, 40 - CAST(floor(value) AS BIGINT) % 41 AS nbplaces,
    CAST(floor(value) AS BIGINT) % 41 AS nbvelos, date_trunc('second', ts) + CASE WHEN event_id % 2 = 0 THEN INTERVAL 0 HOUR
    ELSE INTERVAL 1 HOUR END AS local FROM events"""


def array_rows(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    I.array_text(spark, sf_dir).write.text(path)
    return ingest.flatten_arrays(readers.read_array_json(spark, path))


ARRAYS = """SELECT CAST(user_id % 4 AS VARCHAR) AS id, CAST(floor(value) AS BIGINT) % 41 AS available_bikes,
    40 - CAST(floor(value) AS BIGINT) % 41 AS available_stands, CASE event_type WHEN 'error' THEN 'closed'
    WHEN 'view' THEN 'halted' ELSE 'open' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events"""


def geojson_activity(spark, sf_dir):
    docs = readers.parse_geojson(I.geojson_text(I.offset_times(spark, sf_dir)))
    return ingest.geojson_to_activity(docs)


def _streamed(spark, sf_dir, build):
    """Results of a stream over the landed documents; a document of a much later day closes what is open."""
    landed, target, checkpoint = (scratch_path(spark, n) for n in ("landed", "streamed", "progress"))
    I.geojson_text(I.offset_times(spark, sf_dir)).write.text(landed)
    stream = build(streams.ordered_polls(streams.landed_geojson(spark, landed)))
    streams.write_landed(stream, target, checkpoint)
    last = """{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"time": "2999-01-01T00:00:00+00:00", "ident": -1}}]}"""
    spark.createDataFrame([(last,)], "json string").write.mode("append").text(landed)
    streams.write_landed(stream, target, checkpoint)
    return spark.read.parquet(target).where("station_id >= 0")


def streamed_activity(spark, sf_dir):
    """The feed as a stream: grid activity with the idle run."""
    return _streamed(spark, sf_dir, streams.stream_activity)


def streamed_movements(spark, sf_dir):
    """The feed as a stream: movement counts of every poll."""
    return _streamed(spark, sf_dir, streams.stream_movements)


def array_activity(spark, sf_dir):
    return ingest.arrays_to_activity(readers.parse_array_json(I.array_text(spark, sf_dir)))


ARRAY_POLLS = """SELECT * EXCLUDE (copy) FROM (SELECT CAST(user_id % 4 AS INTEGER) AS station_id,
    date_trunc('second', ts) AS date, 40 - CAST(floor(value) AS BIGINT) % 41 AS available_stands,
    CAST(floor(value) AS BIGINT) % 41 AS available_bikes, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END
    AS status, row_number() OVER (PARTITION BY user_id % 4, date_trunc('second', ts)
    ORDER BY 40 - CAST(floor(value) AS BIGINT) % 41, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END) AS copy
    FROM events) WHERE copy = 1"""
ARRAY_ACTIVITY = sql(
    """SELECT s.station_id, s.date, available_stands, available_bikes, status,
        coalesce(transactions_in, 0) AS transactions_in, coalesce(transactions_out, 0) AS transactions_out,
        coalesce(transactions_all, 0) AS transactions_all
    FROM (SELECT station_id, unnest(generate_series(min(date), max(date), INTERVAL '10 minutes')) AS date
          FROM grid GROUP BY station_id) s LEFT JOIN grid a ON a.station_id = s.station_id AND a.date = s.date""",
    array_polls=ARRAY_POLLS, array_moves=I.moves_sql("array_polls"), grid=I.grid_sql("array_moves"))


def learning_dataset(spark, sf_dir):
    """Two landed responses that share a day."""
    root = scratch_path(spark, "landed")
    records = I.offset_times(spark, sf_dir)
    day = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    nights = F.make_dt_interval(F.lit(1))
    for name, part in (("a", F.col("_ts") < day + nights), ("b", F.col("_ts") >= day)):
        I.geojson_text(records.where(part)).write.text(f"{root}/{name}")
    return ingest.create_learning_dataset(spark, [f"{root}/a", f"{root}/b"], scratch_path(spark, "dataset"))


def union_of_chunks(spark, sf_dir):
    """Neighbouring parts that share a day, one after the other, copies removed."""
    polls = I.polls(spark, sf_dir)
    day = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    nights = F.make_dt_interval(F.lit(1))
    parts = [polls.where(F.col("date") < day + nights), polls.where(F.col("date") >= day)]
    return deduplicate(ingest.union_sources(parts), order=["event_id"])


UNION_OF_CHUNKS = sql("SELECT * FROM unique_polls", "unique_polls")


def five_minute_source(spark, sf_dir):
    records = I.table(spark, sf_dir, "events").select(
        F.col("ts").alias("time"), (F.col("user_id") % 4).cast("int").alias("ident"),
        F.concat(F.lit("name "), (F.col("user_id") % 3).cast("string")).alias("nom"), F.col("event_type").alias("etat"),
        (40 - F.floor("value") % 41).alias("nbplaces"), (F.floor("value") % 41).alias("nbvelos"),
    )
    return source_steps(records, "2024-01-03 00:00:00", "2024-01-27 00:00:00", [0, 1, 3])


def _mode(column):
    return f"""SELECT time, ident, {column} FROM (SELECT time, ident, {column}, row_number() OVER (PARTITION BY time, ident
        ORDER BY count(*) DESC, {column}) AS place FROM src GROUP BY time, ident, {column}) WHERE place = 1"""


FIVE_MINUTES = sql(
    "SELECT time, ident, nom, etat, nbplaces, nbvelos FROM top JOIN names USING (time, ident) JOIN words USING (time, ident)",
    src="""SELECT time_bucket(INTERVAL '5 minutes', ts) AS time, CAST(user_id % 4 AS INTEGER) AS ident,
        'name ' || (user_id % 3) AS nom, event_type AS etat, 40 - CAST(floor(value) AS BIGINT) % 41 AS nbplaces,
        CAST(floor(value) AS BIGINT) % 41 AS nbvelos FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00'
        AND ts < TIMESTAMP '2024-01-27 00:00:00' AND user_id % 4 IN (0, 1, 3)""",
    top="SELECT time, ident, max(nbplaces) AS nbplaces, max(nbvelos) AS nbvelos FROM src GROUP BY time, ident",
    names=_mode("nom"), words=_mode("etat"))


def station_intervals(spark, sf_dir):
    ids = I.stations(spark, sf_dir).select("station_id")
    return requests.add_date_intervals(ids, "2024-01-01", "2024-03-15", chunk_days=7)


SLOTS = """SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01',
    TIMESTAMP '2024-03-14', INTERVAL '{days} days')) AS d)"""
SLOT_TEXTS = """strftime(d, '%Y-%m-%d') AS start_date,
    strftime(least(d + INTERVAL '{days} days', TIMESTAMP '2024-03-15'), '%Y-%m-%d') AS stop_date"""
CHUNKS = """SELECT CAST((rn - 1) // 25 AS BIGINT) AS chunk, list(station_id ORDER BY station_id) AS station_ids
    FROM (SELECT station_id, row_number() OVER (ORDER BY station_id) AS rn FROM stations) GROUP BY 1"""


def station_chunks(spark, sf_dir):
    return requests.chunk_list(I.stations(spark, sf_dir), 25, span=300).select(
        "chunk", F.array_join(F.transform("station_ids", lambda v: v.cast("string")), ",").alias("ids")
    )


def request_plan(spark, sf_dir):
    plan = requests.request_plan(I.stations(spark, sf_dir), "2024-01-01", "2024-03-15")
    return plan.select("chunk", F.size("station_ids").alias("n_ids"), F.element_at("station_ids", 1).alias("first_id"),
                       "start_date", "stop_date")


QUERIES = {
    "station_open_data_file": (open_data_projection, sql("SELECT * FROM open_data", "open_data")),
    "station_attributes": (station_attributes, sql(f"SELECT {ATTRIBUTES} FROM open_data", "open_data")),
    "station_attributes_file": (station_attributes_file, sql(f"SELECT {ATTRIBUTES} FROM open_data", "open_data")),
    "station_profile_file": (profile_file, PROFILE_FILE),
    "learning_dataset_file": (learning_dataset_file, sql(f"SELECT {GRID_COLUMNS} FROM activity", "activity")),
    "smoothed_time_series": (smoothed_time_series, SMOOTHED_SERIES),
    "raw_activity_file": (raw_activity_file, RAW_ACTIVITY),
    "station_files": (station_files, STATION_FILES),
    "permuted_station_files": (permuted_station_files, STATION_FILES),
    "activity_time_series": (activity_time_series, TIME_SERIES),
    "geojson_features": (geojson_features, GEOJSON),
    "array_rows": (array_rows, ARRAYS),
    "streamed_activity": (streamed_activity, sql(f"SELECT {GRID_COLUMNS}, consecutive_no_transactions_out FROM feed_idle", "feed_grid", feed_idle=I.idle_sql("feed_grid"))),
    "streamed_movements": (streamed_movements, sql("""SELECT station_id, date, available_stands, available_bikes, status, transactions_in, transactions_out,
        transactions_all FROM feed_moves""", "feed_moves")),
    "geojson_activity": (geojson_activity, sql(f"SELECT {GRID_COLUMNS} FROM feed_grid", "feed_grid")),
    "array_activity": (array_activity, ARRAY_ACTIVITY),
    "learning_dataset": (learning_dataset, sql(f"SELECT {GRID_COLUMNS} FROM feed_grid", "feed_grid")),
    "union_of_chunks": (union_of_chunks, UNION_OF_CHUNKS),
    "five_minute_source": (five_minute_source, FIVE_MINUTES),
    "station_intervals": (station_intervals, sql(
        f"SELECT station_id, {SLOT_TEXTS.format(days=7)} FROM stations, slots", "stations", slots=SLOTS.format(days=7))),
    "station_chunks": (station_chunks, sql(
        "SELECT chunk, array_to_string(station_ids, ',') AS ids FROM chunks", "stations", chunks=CHUNKS)),
    "request_plan": (request_plan, sql(
        f"""SELECT chunk, CAST(len(station_ids) AS INTEGER) AS n_ids, station_ids[1] AS first_id,
        {SLOT_TEXTS.format(days=4)} FROM chunks, slots""", "stations", chunks=CHUNKS, slots=SLOTS.format(days=4))),
}
