"""Schemas of the sources and the fixed values of the domain."""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------------------------
SEED = 2020

#: Closed period left out of learning, both ends included.
CLOSED_PERIOD = ("2020-03-17 00:00:00", "2020-05-13 00:00:00")

#: Stations the public does not use.
UNUSED_STATIONS: tuple[int, ...] = ()

#: Detector input, in this order.
DETECTOR_FEATURES = (
    "consecutive_no_transactions_out",
    "Sin_quarter",
    "Cos_quarter",
    "Sin_weekday",
    "Cos_weekday",
    "Sin_hours",
    "Cos_hours",
)

#: Activity labels from least to most active (the third spelling is a lookup key, keep it).
PROFILE_LABELS = ("low", "medium", "hight", "very high")

#: Idle steps of ten minutes that count as suspicious, by activity label.
IDLE_LIMITS = {"very high": 36, "hight": 54, "medium": 72, "low": 144}

#: Stations with a lower mean activity are not monitored.
MONITORED_MEAN = 0.06

#: Longest idle run used for learning, in steps of ten minutes (one day).
MAX_IDLE_STEPS = 144

#: Status words of the two poll formats; every other word means 0.
GEOJSON_STATUS = {"CONNECTEE": 1, "DECONNECTEE": 0, "MAINTENANCE": 0}
ARRAY_STATUS = {"open": 1, "closed": 0}

#: Station states, their colours and their order on the map.
STATE_COLOURS = {
    "anomaly": "#EB4D50",
    "inactive": "#5E9BE6",
    "normal": "#6DDE75",
    "non surveillée": "#696A6A",
}
STATE_ORDER = {"non surveillée": 0, "normal": 1, "anomaly": 2, "inactive": 3}

#: Default centre and zoom of the map; zoom on one station (flat map, tilted map).
MAP_CENTRE = (44.837794, -0.581662, 11.0)
STATION_ZOOM = 15.0
STATION_ZOOM_TILTED = 15.3

#: One placeholder station per state, so that the map legend always shows all four.
LEGEND_STATIONS = (
    (990, 0.4, 1, 0, 35, 60.9616624, -39.1527227, "Station fake anomaly", "anomaly", "2021-04-07 09:00"),
    (991, 0.42, 1, 0, 21, 60.9616624, -39.1527227, "Station fake normal", "normal", "-"),
    (992, 0.36, 0, 1, 22, 60.9616624, -39.1527227, "Station fake inactive", "inactive", "-"),
    (993, 0.0, 0, 0, 22, 60.9616624, -39.1527227, "Station non surveillée", "non surveillée", "-"),
)

EARTH_RADIUS_KM = 6371.0
RIDE_SPEED_KMH = 15.0
# ---- end of fixed values ------------------------------------------------------------------------------------

ACTIVITY_COLUMNS = (
    "station_id",
    "date",
    "available_stands",
    "available_bikes",
    "status",
    "transactions_in",
    "transactions_out",
    "transactions_all",
)


# Schemas, as DDL.
ACTIVITY = (
    "station_id int, date timestamp_ntz, available_stands bigint, available_bikes bigint, status int, "
    "transactions_in bigint, transactions_out bigint, transactions_all bigint"
)

#: One FeatureCollection per document.
GEOJSON_POLLS = (
    "type string, features array<struct<type: string, properties: struct<time: string, gid: bigint, "
    "ident: bigint, nom: string, etat: string, nbplaces: bigint, nbvelos: bigint>>>"
)

#: One document holding parallel arrays per station.
ARRAY_POLLS = (
    "data array<struct<id: string, available_bikes: array<bigint>, available_stands: array<bigint>, "
    "status: array<string>, ts: array<string>>>"
)

STATION_OPEN_DATA = (
    "`Geo Point` string, `Geo Shape` string, commune string, IDENT int, TYPE string, NOM string, "
    "NBPLACES int, NBVELOS int"
)

STATION_ATTRIBUTES = (
    "`Geo Point` string, `Geo Shape` string, COMMUNE string, total_stand int, NOM string, TYPEA string, "
    "station_id int, lat double, lon double"
)

STATION_PROFILE = (
    "station_id int, total_point bigint, mean double, median double, std double, `95%` double, `98%` double, "
    "`99%` double, max bigint, profile_station_activity string"
)

RAW_ACTIVITY_CSV = (
    "gid int, ident int, type string, name string, state string, available_stands int, available_bikes int, "
    "ts timestamp_ntz"
)

RAW_STATION_CSV = (
    "id int, timestamp timestamp_ntz, status string, available_stands int, available_bikes int"
)
