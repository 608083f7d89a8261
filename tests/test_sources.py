import json
from datetime import datetime

import pytest

from dockflow.plans.ingest import (
    array_polls,
    arrays_to_activity,
    create_activity_time_series,
    create_learning_dataset,
    create_station_attribute,
    geojson_polls,
    geojson_to_activity,
)
from dockflow.schemas import ACTIVITY_COLUMNS
from dockflow.sources import readers
from dockflow.sources.readers import (
    parse_array_json,
    parse_geojson,
    read_geojson,
    read_raw_activity,
    read_station_open_data,
    read_stations_attributes,
    read_time_serie_activity,
)
from dockflow.sources.writers import write_csv

# Three stations as the open-data portal and the attribute file give them.
OPEN_DATA = """
Geo Point;Geo Shape;commune;IDENT;TYPE;NOM;NBPLACES;NBVELOS
44.83803,-0.58437;{"coordinates": [-0.58437, 44.83803], "type": "Point"};Bordeaux;1;VLS;Meriadeck;29;14
44.83784,-0.59028;{"coordinates": [-0.59028, 44.83784], "type": "Point"};Bordeaux;2;VLS;St Bruno;18;2
44.840813,-0.593233;{"coordinates": [-0.593233, 44.840813], "type": "Point"};Bordeaux;3;VLS;Piscine Judaique;21;5
"""
ATTRIBUTES = """
Geo Point;Geo Shape;COMMUNE;total_stand;NOM;TYPEA;station_id;lat;lon
44.83803,-0.58437;{"coordinates": [-0.58437, 44.83803], "type": "Point"};Bordeaux;43;Meriadeck;VLS;1;44.83803;-0.58437
44.83784,-0.59028;{"coordinates": [-0.59028, 44.83784], "type": "Point"};Bordeaux;20;St Bruno;VLS;2;44.83784;-0.59028
44.840813,-0.593233;{"coordinates": [-0.593233, 44.840813], "type": "Point"};Bordeaux;26;Piscine Judaique;VLS;3;44.840813;-0.593233
"""


def test_station_attributes(spark, tmp_path):
    made = create_station_attribute(read_station_open_data(spark, "", OPEN_DATA), str(tmp_path / "a"))
    wanted = read_stations_attributes(spark, "", ATTRIBUTES)
    assert made.columns == wanted.columns
    assert sorted(made.collect()) == sorted(wanted.collect())
    assert sorted(read_stations_attributes(spark, str(tmp_path / "a")).collect()) == sorted(wanted.collect())


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [("a,b", 'say "x"', "c", 1, "t", "n;m", 1, 2)]
    names = ["Geo Point", "Geo Shape", "commune", "IDENT", "TYPE", "NOM", "NBPLACES", "NBVELOS"]
    df = spark.createDataFrame(rows, names)
    write_csv(df, str(tmp_path / "x"), sep=";")
    back = read_station_open_data(spark, str(tmp_path / "x"))
    assert [tuple(r) for r in back.collect()] == rows


def feature(time, state, places=1, bikes=0, ident=15):
    return {"type": "Feature", "properties": {"time": time, "gid": 14, "ident": ident, "nom": "Capdeville", "etat": state,
                                              "nbplaces": places, "nbvelos": bikes}}


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def test_unknown_status_words_are_closed(spark):
    doc = collection(*[feature(f"2024-05-06T12:{m}:00+02:00", s) for m, s in
                       (("20", "DECONNECTEE"), ("25", "CONNECTEE"), ("30", "MAINTENANCE"), ("35", "AUTRE CHOSE ???"))])
    grid = geojson_to_activity(parse_geojson(spark.createDataFrame([(doc,)], "json string")))
    assert tuple(grid.columns) == ACTIVITY_COLUMNS
    rows = grid.orderBy("date").collect()
    assert [(r.date, r.status) for r in rows] == [(datetime(2024, 5, 6, 12, 30), 1), (datetime(2024, 5, 6, 12, 40), 0)]


def test_repeated_hour_keeps_the_earlier_instant(spark):
    doc = collection(feature("2024-10-27T02:30:00+01:00", "CONNECTEE", 9), feature("2024-10-27T02:30:00+02:00", "CONNECTEE", 4))
    rows = geojson_polls(parse_geojson(spark.createDataFrame([(doc,)], "json string"))).collect()
    assert [(r.date, r.available_stands) for r in rows] == [(datetime(2024, 10, 27, 2, 30), 4)]


def test_landed_files_share_a_border(spark, tmp_path):
    first = collection(feature("2024-05-06T12:00:00+02:00", "CONNECTEE", 5, 5), feature("2024-05-06T12:10:00+02:00", "CONNECTEE", 7, 3))
    second = collection(feature("2024-05-06T12:10:00+02:00", "CONNECTEE", 7, 3), feature("2024-05-06T12:20:00+02:00", "CONNECTEE", 6, 4))
    for name, text in (("a", first), ("b", second)):
        (tmp_path / f"{name}.json").write_text(json.dumps(json.loads(text), indent=1))
    out = create_learning_dataset(spark, str(tmp_path / "*.json"), str(tmp_path / "out"), multi_line=True)
    rows = out.orderBy("date").collect()
    assert [(r.transactions_in, r.transactions_out, r.transactions_all) for r in rows] == [(0, 0, 0), (0, 2, 2), (1, 0, 1)]
    sliced = create_learning_dataset(
        spark, str(tmp_path / "*.json"), str(tmp_path / "cut"), "2024-05-06 12:05:00", "2024-05-06 12:15:00", multi_line=True)
    assert sliced.count() == 1


def test_broken_document_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text("{broken")
    with pytest.raises(Exception):
        read_geojson(spark, str(tmp_path / "x.json")).collect()


def test_array_documents(spark):
    doc = json.dumps({"data": [
        {"id": "19", "available_bikes": [5, 4, 9], "available_stands": [5, 6, 1], "status": ["open", "closed", "odd"],
         "ts": ["2020-10-14T00:00:00", "2020-10-14T00:05:00", "2020-10-14T00:40:00"]},
        {"id": "2", "available_bikes": [1], "available_stands": [2], "status": ["open"], "ts": ["2020-10-14T01:00:00"]}]})
    docs = parse_array_json(spark.createDataFrame([(doc,)], "json string"))
    assert array_polls(docs).count() == 4
    rows = arrays_to_activity(docs).where("station_id = 19").orderBy("date").collect()
    assert [r.date.minute for r in rows] == [10, 20, 30, 40, 50]
    assert [r.status for r in rows] == [1, None, None, None, 0]
    assert [r.transactions_in for r in rows] == [0, 0, 0, 0, 5]
    assert [r.transactions_out for r in rows] == [1, 0, 0, 0, 0]


def test_station_files(spark, tmp_path):
    (tmp_path / "city-1.csv").write_text("id,timestamp,status,available_stands,available_bikes\n1,2020-01-01 00:00:00,open,3,4\n")
    (tmp_path / "city-2.csv").write_text("id,timestamp,status,available_stands,available_bikes\n1,2020-01-01 00:05:00,closed,5,2\n"
                                         "1,2020-01-01 00:00:00,open,3,4\n")
    out = create_activity_time_series(spark, str(tmp_path / "city-*.csv"), str(tmp_path / "out"))
    assert [tuple(r) for r in out.collect()] == [(1, datetime(2020, 1, 1, 0, 10), 5, 2, 1, 0, 2, 2)]
    smooth = read_time_serie_activity(spark, str(tmp_path / "out"))
    assert smooth.collect()[0].status == 1


def test_raw_activity(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "gid,ident,type,name,state,available_stands,available_bikes,ts\n"
        "51,4,VLS,Corner,CONNECTEE,8,12,2024-03-05 06:00:00\n51,4,VLS,Corner,MAINTENANCE,8,12,2024-03-05 06:05:00\n")
    rows = read_raw_activity(spark, str(tmp_path / "x.csv")).orderBy("date").collect()
    assert [r.state for r in rows] == ["1", "MAINTENANCE"]
    assert rows[0].station_id == 4 and rows[0].date == datetime(2024, 3, 5, 6)


def test_columns_are_found_by_name(spark, tmp_path):
    """Any order, others among them, quotes; all four readers."""
    (tmp_path / "city.csv").write_text('available_bikes,note,available_stands,status,timestamp,id\n3,"a,b",40,open,2024-01-01 00:00:00,7\n')
    row = readers.read_station_files(spark, str(tmp_path / "city.csv")).collect()[0]
    assert (row.id, row.available_bikes, row.available_stands, row.status) == (7, 3, 40, "open")
    raw = tmp_path / "raw.csv"
    raw.write_text("ts,available_bikes,available_stands,state,name,type,ident,gid,x\n2024-01-01 00:00:00,3,40,CONNECTEE,N,VLS,7,1,9\n")
    row = readers.read_raw_activity(spark, str(raw)).collect()[0]
    assert (row.station_id, row.gid, row.available_bikes, row.available_stands, row.state) == (7, 1, 3, 40, "1")
    profile = tmp_path / "profile.csv"
    profile.write_text("profile_station_activity,max,mean,median,std,95%,98%,99%,total_point,station_id\nlow,1,0.5,0,0.1,1,1,1,12,7\n")
    row = readers.read_station_profile(spark, str(profile)).collect()[0]
    assert (row.station_id, row.total_point, row["mean"], row.profile_station_activity) == (7, 12, 0.5, "low")
    text = 'NOM;lon;lat;station_id;TYPEA;total_stand;COMMUNE;"Geo Shape";extra;"Geo Point"\nA "B";-0.5;44.8;43;VLS;20;C;"{""a"": 1; ""b"": 2}";x;"44.8, -0.5"\n'
    (tmp_path / "stations.csv").write_text(text)
    by_path = readers.read_stations_attributes(spark, str(tmp_path / "stations.csv")).collect()
    by_text = readers.read_stations_attributes(spark, "", text=text).collect()
    assert by_path == by_text
    assert (by_text[0].station_id, by_text[0]["Geo Shape"], by_text[0].total_stand) == (43, '{"a": 1; "b": 2}', 20)


def test_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "city-1.csv").write_text("id,timestamp,status,available_stands,available_bikes\n1,2024-01-01 00:00:00,open,1,2\n")
    (tmp_path / "city-2.csv").write_text("id,timestamp,status,available_bikes,available_stands\n1,2024-01-01 00:10:00,open,1,2\n")
    with pytest.raises(Exception, match="(?i)header|column"):
        readers.read_station_files(spark, str(tmp_path / "city-*.csv")).collect()
    (tmp_path / "short.csv").write_text("id,status\n1,open\n")
    with pytest.raises(Exception, match="timestamp"):
        readers.read_station_files(spark, str(tmp_path / "short.csv")).collect()
