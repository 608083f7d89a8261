"""Small fixtures shared by the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd


def values(df, column, order=("station_id", "date")):
    return [row[column] for row in df.orderBy(*order).select(column).collect()]


def seeded_history():
    """Two stations, 432 steps of ten minutes, uniform levels."""
    rng = np.random.default_rng(42)
    dates = [datetime(2025, 3, 1) + timedelta(minutes=10 * i) for i in range(432)]
    parts = []
    for station in (101, 102):
        stands = rng.integers(0, 20, size=432)
        bikes = rng.integers(0, 20, size=432)
        parts.append(
            pd.DataFrame({"station_id": station, "date": dates, "available_stands": stands, "available_bikes": bikes})
        )
    return pd.concat(parts, ignore_index=True)


def _plain(value, whole):
    if pd.isna(value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    value = value.item() if hasattr(value, "item") else value
    return int(value) if whole and isinstance(value, float) else value


def frame(spark, pdf, schema):
    """A pandas table as DataFrame; nulls stay nulls, whole numbers stay whole unless the schema has doubles."""
    whole = "double" not in schema
    rows = [tuple(_plain(v, whole) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)
