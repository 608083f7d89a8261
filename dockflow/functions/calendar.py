"""Dates: parsing, formatting, calendar fields and their cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[XXX][XX]"
NAIVE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def naive_timestamp(column: str, fmt: str = NAIVE_FORMAT) -> Column:
    """An ISO text without offset as a wall-clock timestamp."""
    return F.to_timestamp_ntz(F.col(column), F.lit(fmt))


def offset_instant(column: str) -> Column:
    """An ISO text with offset as seconds since 1970 in UTC: the order of real instants."""
    return F.unix_seconds(F.to_timestamp(F.col(column), OFFSET_FORMAT))


def zone_wall_clock(column: str, zone: str = "Europe/Paris") -> Column:
    """An ISO text with offset as wall clock of ``zone``. The repeated autumn hour maps onto itself."""
    seconds = offset_instant(column).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def display_date(column: str) -> Column:
    """A wall-clock timestamp as ``yyyy-MM-dd HH:mm``."""
    return F.substring(F.col(column).cast("timestamp_ntz").cast("string"), 1, 16)


def iso_weekday(column: str = "date") -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(F.col(column)) + 1


def get_encoding_time(df: DataFrame, col_date: str, max_val: int) -> DataFrame:
    """Add ``Sin_<col>`` and ``Cos_<col>``: position of the value on a circle of ``max_val`` steps."""
    angle = F.lit(2 * math.pi / max_val) * F.col(col_date)
    return df.withColumns({f"Sin_{col_date}": F.sin(angle), f"Cos_{col_date}": F.cos(angle)})


def process_data_cluster(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar features of the anomaly detector: quarter, ISO weekday and hour, with encodings."""
    df = df.withColumns({"quarter": F.quarter(date), "weekday": iso_weekday(date), "hours": F.hour(date)})
    return (
        df.transform(get_encoding_time, "quarter", max_val=4)
        .transform(get_encoding_time, "weekday", max_val=7)
        .transform(get_encoding_time, "hours", max_val=24)
    )


def process_temporal_feat(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar features of the forecast. Minutes turn once per *six*, which is how the features are defined."""
    df = df.withColumns({"weekday": iso_weekday(date), "hours": F.hour(date), "minutes": F.minute(date)})
    return (
        df.transform(get_encoding_time, "weekday", max_val=7)
        .transform(get_encoding_time, "hours", max_val=24)
        .transform(get_encoding_time, "minutes", max_val=6)
    )
