"""Ordered operators with null stations and null dates, against a plain walk over the rows."""

import random
from datetime import datetime, timedelta

import pytest

from dockflow.operators import movement, rolling, timeline

SCHEMA = "id long, station_id int, date timestamp_ntz, available_stands long, available_bikes long, status int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = []
    for i in range(400):
        date = None if rng.random() < 0.1 else datetime(2024, 5, 1) + timedelta(minutes=rng.randrange(3000))
        level = rng.choice([None, 0, 1, 5, 9, 20])
        out.append((i, rng.choice([None, None, 1, 2]), date, level, rng.choice([None, 3, 8, 14]), rng.choice([None, 0, 1, 1])))
    return out


def by_station(rows):
    """The rows of each station, those without a date first."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    return [sorted(g, key=lambda r: (r[2] is not None, r[2] or datetime.min, r[0])) for g in groups.values()]


def walked(rows, step):
    """id -> what ``step`` gives for a station's ordered rows."""
    return {row[0]: value for group in by_station(rows) for row, value in zip(group, step(group))}


def got(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def change(now, before):
    return None if now is None else now - (now if before is None else before)


def taken(group):
    out = []
    for k, row in enumerate(group):
        diff = change(row[3], group[k - 1][3] if k else None)
        out.append(None if diff is None else max(diff, 0))
    return out


def idle(group):
    out, run = [], 0
    for row, departures in zip(group, taken(group)):
        breaks = (departures or 0) >= 1 or row[5] == 0 or (row[4] is not None and row[4] <= 2) or row[3] is None
        run = 0 if breaks else run + 1
        out.append(run)
    return out


def smoothed(group):
    after = [r[5] for r in group[1:]] + [None]
    return [r[5] if (r[5] or 0) != 0 else 1 if n == 1 else 0 for r, n in zip(group, after)]


def filled(group):
    out, last = [], None
    for row in group:
        last = row[3] if row[3] is not None else last
        out.append(last)
    return out


def running(group):
    out, total = [], 0
    for row in group:
        total += row[4] or 0
        out.append(total)
    return out


def lag(n):
    return lambda group: [group[k - n][4] if k >= n else None for k in range(len(group))]


@pytest.mark.parametrize("chunk", ["20m", "7d"])
def test_null_stations_and_dates(spark, rows, chunk):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    options = {"ties": ["id"], "chunk": chunk}
    assert got(movement.get_transactions_out(df, **options), "transactions_out") == walked(rows, taken)
    both = movement.add_movements_and_idle(df, ["transactions_out"], **options)
    assert got(both, "consecutive_no_transactions_out") == walked(rows, idle)
    assert got(movement.smooth_status(df, **options), "status") == walked(rows, smoothed)
    assert got(timeline.forward_fill(df, "available_stands", **options), "available_stands") == walked(rows, filled)
    summed = timeline.running_sum(df, df["available_bikes"], "total", "station_id", "date", **options)
    assert got(summed, "total") == walked(rows, running)
    numbered = timeline.with_row_number(df, "station_id", "date", **options)
    assert got(numbered, "_rn") == walked(rows, lambda g: range(1, len(g) + 1))
    lags = rolling.build_lag_and_rolling_feat(df, "available_bikes", **options)
    for n in (1, 3):
        assert got(lags, f"available_bikes_lag_{n}") == walked(rows, lag(n))
