"""The stream of polls against the batch results."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from dockflow.operators.movement import add_movements, get_consecutive_no_transactions_out
from dockflow.plans.ingest import geojson_polls, geojson_to_activity
from dockflow.sources.readers import read_geojson
from dockflow.streaming import activity as st

ZONE = "UTC"


def feature(station, at, bikes, stands, state="CONNECTEE"):
    return {"type": "Feature", "properties": {
        "time": at.strftime("%Y-%m-%dT%H:%M:%S+00:00"), "gid": 1, "ident": station, "nom": "x", "etat": state, "nbplaces": stands, "nbvelos": bikes}}


def polls(seed=3, hours=5):
    rng = random.Random(seed)
    out, start = [], datetime(2024, 3, 1)
    for station in (1, 2, 22):
        bikes = 9
        for i in range(hours * 12):
            if station == 22 and 20 < i < 50:
                continue  # falls silent
            at = start + timedelta(minutes=5 * i, seconds=rng.randint(0, 250))
            bikes = min(20, max(0, bikes + rng.choice([-1, 0, 0, 0, 1])))
            level = None if rng.random() < 0.03 else bikes
            out.append((at, feature(station, at, level, 20 - bikes, rng.choice(["CONNECTEE"] * 9 + ["MAINTENANCE"]))))
            if rng.random() < 0.1:
                out.append((at, feature(station, at, bikes + 1, 20 - bikes)))  # a copy
    return sorted(out, key=lambda p: p[0])


def land(folder, number, features):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{number:04}.json", "w") as f:
        f.write(json.dumps({"type": "FeatureCollection", "features": features}) + "\n")
    os.utime(f"{folder}/{number:04}.json", (1_700_000_000 + number, 1_700_000_000 + number))


CLOSING = [feature(-1, datetime(2025, 1, 1), 1, 1)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.where("station_id > 0").select("station_id", "date", *columns).collect()), key=str)


def wanted(spark, folder):
    docs = read_geojson(spark, folder)
    grid = get_consecutive_no_transactions_out(geojson_to_activity(docs, ZONE))
    return grid, add_movements(geojson_polls(docs, ZONE))


GRID = ["available_stands", "available_bikes", "status", "transactions_in", "transactions_out", "transactions_all"]
STREAMS = {"grid": (st.stream_activity, [*GRID, "consecutive_no_transactions_out"]), "moves": (st.stream_movements, GRID)}


@pytest.mark.parametrize("kind", sorted(STREAMS))
def test_stream_equals_batch_in_any_order_within_the_delay(spark, tmp_path, kind):
    """Documents arrive permuted within the delay, in many triggers and two runs of the query from one checkpoint."""
    build, columns = STREAMS[kind]
    landed, target, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "state"))
    rng = random.Random(1)
    arrival = sorted(polls(), key=lambda p: p[0] + timedelta(minutes=rng.uniform(0, 14)))
    parts = [[f for _, f in arrival[i : i + 60]] for i in range(0, len(arrival), 60)]

    def run():
        docs = st.landed_geojson(spark, landed, max_files=1)
        return st.write_landed(build(st.ordered_polls(docs, "20 minutes", ZONE)), target, checkpoint)

    for i, part in enumerate(parts[:2]):
        land(landed, i, part)
    first = run()
    given = spark.read.parquet(target).count()
    for i, part in enumerate(parts[2:], 2):
        land(landed, i, part)
    land(landed, 99, CLOSING)
    second = run()
    assert first["documents"] == 2 and first["late"] == second["late"] == 0 and given > 0
    batch = wanted(spark, landed)[kind == "moves"]
    got = spark.read.parquet(target)
    assert rows(got, *columns) == rows(batch, *columns)
    assert got.where("station_id > 0").count() > given


def test_late_polls_are_dropped_and_counted(spark, tmp_path):
    landed, target, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "state"))
    start = datetime(2024, 3, 1)
    land(landed, 0, [feature(1, start, 5, 15), feature(1, start + timedelta(hours=3), 6, 14)])
    land(landed, 1, [feature(1, start + timedelta(hours=3, minutes=1), 6, 14)])
    land(landed, 2, [feature(1, start + timedelta(minutes=30), 9, 11), feature(1, start + timedelta(hours=2, minutes=50), 4, 16)])
    land(landed, 3, CLOSING)
    docs = st.landed_geojson(spark, landed, max_files=1)
    done = st.write_landed(st.stream_activity(st.ordered_polls(docs, "20 minutes", ZONE)), target, checkpoint)
    assert done == {"documents": 4, "late": 1}
    got = spark.read.parquet(target).where("station_id = 1").orderBy("date").collect()
    assert [(r.date, r.available_bikes, r.transactions_all) for r in got] == [
        (start + timedelta(minutes=10), 5, 0), (start + timedelta(hours=3), 4, 1), (start + timedelta(hours=3, minutes=10), 6, 2)]


def test_a_silent_station_is_closed_by_its_timer(spark, tmp_path):
    landed, target, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "state"))
    start = datetime(2024, 3, 1)
    land(landed, 0, [feature(1, start, 5, 15), feature(2, start, 5, 15)])
    land(landed, 1, [feature(2, start + timedelta(hours=1), 6, 14)])
    land(landed, 2, [feature(2, start + timedelta(hours=2), 6, 14)])
    docs = st.landed_geojson(spark, landed, max_files=1)
    st.write_landed(st.stream_activity(st.ordered_polls(docs, "20 minutes", ZONE)), target, checkpoint)
    got = spark.read.parquet(target).where("station_id = 1").collect()
    assert [(r.date, r.consecutive_no_transactions_out) for r in got] == [(start + timedelta(minutes=10), 1)]


class Held:
    """A state value by itself."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def getValueState(self, *_):  # noqa: N802
        return Held()

    def registerTimer(self, _):  # noqa: N802
        pass


class Watermark:
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


@pytest.mark.parametrize("processor", [st.MovementProcessor(), st.ActivityProcessor(600_000_000)])
def test_many_polls_of_a_station_take_little_memory(processor):
    """One trigger with all polls: the processor's own memory is some ten numbers a poll."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, part = 400_000, 10_000
    order = np.random.default_rng(1).permutation(n)

    def batches():
        for i in range(0, n, part):
            at = order[i : i + part]
            yield pd.DataFrame({
                "micros": at * 1_000_000, "available_stands": (at % 7).astype(float), "available_bikes": at % 11, "status": 1})

    processor.init(Handle())
    tracemalloc.start()
    try:
        made = sum(len(out) for out in processor.handleInputRows((5,), batches(), Watermark()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made == (n if isinstance(processor, st.MovementProcessor) else n // 600)
    assert peak < 150 * n


def test_movements_over_slices_and_triggers(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(st, "SLICE_POLLS", 2)
    made = st.MovementProcessor()
    made.init(Handle())
    first = pd.DataFrame({"micros": [3, 1, 2, 4], "available_stands": [None, 5, 7, None], "available_bikes": [4, 9, 2, 2], "status": [1, None, 0, 1]})
    second = pd.DataFrame({"micros": [5, 6], "available_stands": [3, 8], "available_bikes": [5, None], "status": [1, 1]})
    out = pd.concat([f for p in (first, second) for f in made.handleInputRows((5,), iter([p]), Watermark())])
    columns = ["available_stands", "available_bikes", "status", "transactions_in", "transactions_out", "transactions_all"]
    rows = [tuple(None if v is pd.NA else int(v) for v in r) for r in out[columns].itertuples(index=False, name=None)]
    assert rows == [
        (5, 9, None, 0, 0, 0), (7, 2, 0, 0, 2, 7), (None, 4, 1, 2, None, 2), (None, 2, 1, 0, None, 2), (3, 5, 1, 3, 0, 3), (8, None, 1, None, 5, None)]
