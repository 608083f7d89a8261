"""Readers. Every source has a declared schema, so nothing is inferred from data."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.functions.scalars import state_code
from dockflow.operators.movement import smooth_status
from dockflow.schemas import (
    ACTIVITY,
    ARRAY_POLLS,
    GEOJSON_POLLS,
    RAW_ACTIVITY_CSV,
    RAW_STATION_CSV,
    STATION_ATTRIBUTES,
    STATION_OPEN_DATA,
    STATION_PROFILE,
)


def fields_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _csv(spark: SparkSession, path: str, ddl: str, sep: str = ",") -> DataFrame:
    """The columns of ``ddl``, found by header name among any others and in any order.

    A value that can't be read as its type is null. All files under ``path`` must have the same header; one that
    differs is an error, as is a missing column.
    """
    table = spark.read.csv(path, sep=sep, header=True, escape='"', enforceSchema=False)
    return _typed(table, ddl)


def _typed(table: DataFrame, ddl: str) -> DataFrame:
    return table.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields_of(ddl)])


def _from_text(spark: SparkSession, text: str, ddl: str) -> DataFrame:
    """As ``_csv`` for a ``;`` separated text with a header; quoted values may hold the separator and line ends."""
    header, *lines = [line for line in csv.reader(io.StringIO(text.strip()), delimiter=";") if line]
    rows = [[value or None for value in line] for line in lines]
    names = ", ".join(f"`{name}` string" for name in header)
    return _typed(spark.createDataFrame(rows, names), ddl)


def read_stations_attributes(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """Station attributes, ``;`` separated. ``text`` gives the content instead of a path (small inputs)."""
    return _csv(spark, path, STATION_ATTRIBUTES, ";") if text is None else _from_text(spark, text, STATION_ATTRIBUTES)


def read_station_open_data(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """Open-data station list: the eight columns used."""
    return _csv(spark, path, STATION_OPEN_DATA, ";") if text is None else _from_text(spark, text, STATION_OPEN_DATA)


def read_station_profile(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, STATION_PROFILE)


def read_learning_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Activity on the ten-minute grid."""
    return spark.read.schema(ACTIVITY).parquet(path)


def read_raw_activity(spark: SparkSession, path: str) -> DataFrame:
    """Raw activity CSV; known state words become their digit, others stay."""
    table = _csv(spark, path, RAW_ACTIVITY_CSV)
    words = {"CONNECTEE": 1, "DECONNECTEE": 0}
    return table.withColumn("state", state_code("state", words)).withColumnsRenamed(
        {"ident": "station_id", "ts": "date"}
    )


def read_time_serie_activity(spark: SparkSession, path: str, post_processing_status: bool = True) -> DataFrame:
    """Activity on the grid, by default with single closed rows smoothed away."""
    table = spark.read.schema(ACTIVITY).parquet(path)
    return smooth_status(table) if post_processing_status else table


def read_station_files(spark: SparkSession, path: str) -> DataFrame:
    """Station CSV files, e.g. ``folder/city-*.csv``: one scan over all of them."""
    return _csv(spark, path, RAW_STATION_CSV)


def read_geojson(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """FeatureCollections, one document per line or, with ``multi_line``, one per file."""
    return spark.read.json(path, schema=GEOJSON_POLLS, multiLine=multi_line, mode="FAILFAST")


def read_array_json(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Documents with parallel arrays per station."""
    return spark.read.json(path, schema=ARRAY_POLLS, multiLine=multi_line, mode="FAILFAST")


def parse_geojson(df: DataFrame, column: str = "json") -> DataFrame:
    """FeatureCollections held as text in a column."""
    return df.select(F.from_json(column, GEOJSON_POLLS, {"mode": "FAILFAST"}).alias("_doc")).select("_doc.*")


def parse_array_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.from_json(column, ARRAY_POLLS, {"mode": "FAILFAST"}).alias("_doc")).select("_doc.*")
