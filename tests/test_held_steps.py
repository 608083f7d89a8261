"""Grid rows that stand for all steps up to the next one, against the steps themselves."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dockflow.catalog import defaults
from dockflow.operators.grid import count_steps, upsample
from dockflow.operators.movement import RUN, get_consecutive_no_transactions_out
from dockflow.operators.timeline import forward_fill
from dockflow.plans.learning import create_station_profilage_activity
from dockflow.schemas import ACTIVITY

LEVELS = ("available_stands", "available_bikes", "status")
NEVER = ("1999-01-01 00:00:00", "1999-01-02 00:00:00")


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(11)

    def some(value, share=0.2):
        return None if rng.random() < share else value

    rows = []
    for station in (1, 2, 3, None):
        at = datetime(2024, 1, 1)
        for _ in range(60):
            at += timedelta(minutes=10 * rng.choice([1, 1, 2, 7, 60]))
            moves = [some(rng.choice([0, 0, 0, 2])) for _ in range(3)]
            rows.append((station, at, some(rng.randint(0, 9)), some(rng.randint(0, 9)), some(rng.choice([1, 1, 1, 0])), *moves))
    return spark.createDataFrame(rows, ACTIVITY)


def got(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("chunk", ["1h", "7d"])
def test_held_steps_are_the_filled_ones(grid, chunk):
    filled = upsample(grid)
    for level in LEVELS:
        filled = forward_fill(filled, level, chunk=chunk)
    wanted = get_consecutive_no_transactions_out(filled, chunk=chunk)
    held = count_steps(forward_fill(grid, LEVELS, chunk=chunk), chunk=chunk)
    made = upsample(get_consecutive_no_transactions_out(held, chunk=chunk, steps="steps"), steps="steps")
    assert made.columns == wanted.columns and made.select(F.max(RUN)).scalar() is not None
    assert got(made) == got(wanted)
    assert wanted.where(f"{RUN} > 20").count() > 0
    again = {"non_use_station_id": [], "period": NEVER, "chunk": chunk}
    profile = create_station_profilage_activity(held, steps="steps", **again)
    assert got(profile) == got(create_station_profilage_activity(filled, **again))


def test_steps_are_added_after_the_last_shuffle(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=5 * i), i % 3, "click", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(str(tmp_path / "events.parquet"))
    counted = defaults._idle(spark, str(tmp_path)).groupBy("station_id", RUN).count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Exchange" not in plan[: plan.index("Generate explode")]
