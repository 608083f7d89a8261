"""Polls as a stream: from landed documents to movements, grid activity and idle runs, equal to the batch results.

The stream of polls is put in order by its watermark: a poll is passed on when the watermark has reached it, and of copies of (station,
date) the one the batch keeps. Polls that come later than the watermark are dropped and counted by Spark
(``numRowsDroppedByWatermark``). What follows sees each station's polls in the order of their dates, so a state of a few numbers per
station suffices: the previous levels, the open step and the length of the idle run. A timer closes the step of a station that
has fallen silent. State and progress live in the checkpoint: a restarted query goes on where it stopped.

A station's polls of one trigger are put in order together, as arrays of numbers, and worked on a slice at a time; ``max_files``
bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dockflow.functions.durations import duration_seconds, wall_seconds
from dockflow.operators.grid import STEP, deduplicate
from dockflow.plans.ingest import typed_geojson_polls
from dockflow.schemas import GEOJSON_POLLS

DELAY = "20 minutes"
#: Polls of a station that are worked on at once.
SLICE_POLLS = 50_000
_LEVELS = ["available_stands", "available_bikes", "status"]
_POLLS = "station_id int, date timestamp_ntz, available_stands bigint, available_bikes bigint, status int"
_COUNTS = "transactions_in bigint, transactions_out bigint, transactions_all bigint"
_RUN = "consecutive_no_transactions_out"


def landed_geojson(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of the GeoJSON documents, one per line, that land in a folder."""
    reader = spark.readStream.schema(GEOJSON_POLLS).option("mode", "FAILFAST")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def ordered_polls(docs: DataFrame, delay: str = DELAY, zone: str = "Europe/Paris") -> DataFrame:
    """Stream of typed polls, unique per station and date, passed on as the watermark reaches them.

    ``polled_at`` is the date as an instant, which watermarks need, ``micros`` the same as a number.
    """
    typed = typed_geojson_polls(docs, zone)
    timed = typed.withColumn("polled_at", F.timestamp_micros((wall_seconds("date") * 1_000_000).cast("bigint"))).drop("date")
    unique = deduplicate(timed.withWatermark("polled_at", delay), by=("station_id", "polled_at"), order=["_instant"])
    return unique.withColumn("micros", F.unix_micros("polled_at")).drop("_instant")


def _ordered(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A station's polls of a trigger, in order: dates, levels by column (0 where null), and where these are null.

    Arrays of numbers: some 35 bytes a poll, where objects would take many hundred.
    """
    dates, levels, nulls = [], [], []
    for part in batches:
        missing = np.stack([part[c].isna().to_numpy() for c in _LEVELS])
        dates.append(part["micros"].to_numpy(dtype=np.int64))
        levels.append(np.stack([part[c].mask(gone, 0).to_numpy(dtype=np.int64) for c, gone in zip(_LEVELS, missing)]))
        nulls.append(missing)
    if not dates:
        return np.zeros(0, dtype=np.int64), np.zeros((3, 0), dtype=np.int64), np.zeros((3, 0), dtype=bool)
    micros = np.concatenate(dates)
    order = np.argsort(micros, kind="stable")
    return micros[order], np.concatenate(levels, axis=1)[:, order], np.concatenate(nulls, axis=1)[:, order]


def _slices(polls: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    micros, levels, nulls = polls
    for i in range(0, len(micros), SLICE_POLLS):
        part = slice(i, i + SLICE_POLLS)
        yield micros[part], levels[:, part], nulls[:, part]


def _tuples(polls: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """Date and levels of the polls, one at a time."""
    for micros, levels, nulls in _slices(polls):
        columns = [[None if gone else v for v, gone in zip(c, n)] for c, n in zip(levels.tolist(), nulls.tolist())]
        yield from zip(micros.tolist(), *columns)


def _changes(now: np.ndarray, null: np.ndarray, before: int | None) -> np.ndarray:
    """Differences to the previous value; 0 where that is missing."""
    change = np.diff(now, prepend=0)
    change[np.concatenate([[before is None], null[:-1]])] = 0
    if before is not None:
        change[0] = now[0] - before
    return change


def _rise(now: int | None, before: int | None) -> int | None:
    return None if now is None else max(now - (now if before is None else before), 0)


def _moved(stands, bikes, before_stands, before_bikes) -> tuple:
    change = None if bikes is None else abs(bikes - (bikes if before_bikes is None else before_bikes))
    return _rise(bikes, before_bikes), _rise(stands, before_stands), change


def _frame(station, micros: np.ndarray, values: Sequence[np.ndarray], nulls: Sequence[np.ndarray], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({
        "station_id": pd.array([station] * len(micros), dtype="Int32"),
        "date": pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us"),
    })
    for column, value, gone in zip(columns, values, nulls):
        out[column] = pd.arrays.IntegerArray(value.astype(np.int32 if column == "status" else np.int64), gone.copy())
    return out


def _rows_frame(station, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """The same from rows: a date and the columns."""
    by_column = [[r[i] for r in rows] for i in range(len(columns) + 1)]
    values = [np.array([v or 0 for v in c], dtype=np.int64) for c in by_column]
    nulls = [np.array([v is None for v in c], dtype=bool) for c in by_column]
    return _frame(station, values[0], values[1:], nulls[1:], columns)


class MovementProcessor(StatefulProcessor):
    """Movement counts of every poll against the previous one of its station, which is the state."""

    columns = [*_LEVELS, "transactions_in", "transactions_out", "transactions_all"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._before = handle.getValueState("before", "stands bigint, bikes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._before.get() if self._before.exists() else (None, None)
        for micros, levels, nulls in _slices(_ordered(rows)):
            stands, bikes = (_changes(levels[i], nulls[i], before[i]) for i in (0, 1))
            before = tuple(None if nulls[i, -1] else int(levels[i, -1]) for i in (0, 1))
            values = [*levels, np.maximum(bikes, 0), np.maximum(stands, 0), np.abs(bikes)]
            yield _frame(key[0], micros, values, [*nulls, nulls[1], nulls[0], nulls[1]], self.columns)
        self._before.update(tuple(before))

    def close(self) -> None:
        pass


def stream_movements(polls: DataFrame) -> DataFrame:
    """Polls with the three movement counts."""
    return polls.groupBy("station_id").transformWithStateInPandas(MovementProcessor(), f"{_POLLS}, {_COUNTS}", "Append", "None")


class _Step:
    """The open step of a station: its end, the newest levels, the highest status, the summed movements."""

    def __init__(self, end: int):
        self.end, self.stands, self.bikes, self.status, self.counts = end, None, None, None, [0, 0, 0]

    def add(self, stands, bikes, status, moved) -> None:
        self.stands, self.bikes = stands, bikes
        if status is not None:
            self.status = status if self.status is None else max(self.status, status)
        self.counts = [a + (b or 0) for a, b in zip(self.counts, moved)]

    def closed(self, run: int) -> tuple[tuple, int]:
        """The grid row and the idle run it ends with."""
        breaks = self.counts[1] >= 1 or self.status == 0 or self.stands is None or (self.bikes is not None and self.bikes <= 2)
        run = 0 if breaks else run + 1
        return (self.end, self.stands, self.bikes, self.status, *self.counts, run), run


class ActivityProcessor(StatefulProcessor):
    """Grid steps and idle runs; the state is the previous levels, the idle run, and the open step with a timer at its end."""

    columns = [*MovementProcessor.columns, _RUN]

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._levels = handle.getValueState("levels", "stands bigint, bikes bigint, run bigint")
        self._open = handle.getValueState(
            "open", "end_micros bigint, stands bigint, bikes bigint, status int, moved_in bigint, moved_out bigint, moved_all bigint")

    def _load(self) -> tuple[tuple, int, _Step | None]:
        *before, run = self._levels.get() if self._levels.exists() else (None, None, 0)
        step = None
        if self._open.exists():
            end, stands, bikes, status, *counts = self._open.get()
            step = _Step(end)
            step.stands, step.bikes, step.status, step.counts = stands, bikes, status, counts
        return before, run, step

    def _store(self, before, run: int, step: _Step | None, out: list, watermark_ms: int) -> list:
        """Close the step if the watermark is past its end, else wait for it; keep the rest. The rows to give out."""
        if step is not None and step.end <= watermark_ms * 1_000:
            row, run = step.closed(run)
            out.append(row)
            step = None
        self._levels.update((*before, run))
        if step is None:
            self._open.clear()
        else:
            self._open.update((step.end, step.stands, step.bikes, step.status, *step.counts))
            self._handle.registerTimer(step.end // 1_000)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, run, step = self._load()
        out = []
        for micros, stands, bikes, status in _tuples(_ordered(rows)):
            end = (micros // self.width + 1) * self.width
            if step is not None and step.end < end:
                row, run = step.closed(run)
                out.append(row)
                step = None
            step = step or _Step(end)
            step.add(stands, bikes, status, _moved(stands, bikes, *before))
            before = stands, bikes
        yield _rows_frame(key[0], self._store(before, run, step, out, timerValues.getCurrentWatermarkInMs()), self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, run, step = self._load()
        yield _rows_frame(key[0], self._store(before, run, step, [], timerValues.getCurrentWatermarkInMs()), self.columns)

    def close(self) -> None:
        pass


def stream_activity(polls: DataFrame, every: str = STEP) -> DataFrame:
    """Activity on the grid with the idle run, each step given out once its end is behind the watermark or a later poll is there."""
    processor = ActivityProcessor(int(duration_seconds(every) * 1_000_000))
    return polls.groupBy("station_id").transformWithStateInPandas(processor, f"{_POLLS}, {_COUNTS}, {_RUN} bigint", "Append", "EventTime")


def write_landed(stream: DataFrame, target: str, checkpoint: str) -> dict[str, int]:
    """Handle all that has landed, append the results to Parquet, and stop. Gives the polls read and those dropped as too late."""
    spark = stream.sparkSession
    setting, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting)
    spark.conf.set(setting, store)  # what states with timers need
    try:
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        query = query.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    done = query.recentProgress
    late = sum(int(s["numRowsDroppedByWatermark"]) for p in done for s in p["stateOperators"])
    return {"documents": sum(int(p["numInputRows"]) for p in done), "late": late}
