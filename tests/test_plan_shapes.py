"""Plans of the main steps: what is read, what is shuffled, what a window holds."""

import re
from datetime import datetime, timedelta

import pytest

from dockflow.models.anomaly import count_combinations, training_rows
from dockflow.operators import filters
from dockflow.operators.grid import deduplicate, hourly_totals, polls_to_grid, upsample
from dockflow.operators.movement import (
    add_movements,
    add_movements_and_idle,
    get_consecutive_no_transactions_out,
    get_transactions_out,
    smooth_status,
)
from dockflow.operators.rolling import build_lag_and_rolling_feat
from dockflow.operators.timeline import forward_fill
from dockflow.plans.reports import activity_heatmap

SCHEMA = "station_id int, date timestamp_ntz, available_stands bigint, available_bikes bigint, status int, gid int"


@pytest.fixture(scope="module")
def polls(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "polls")
    rows = [(i % 3, datetime(2024, 1, 1) + timedelta(minutes=i), i % 9, 9 - i % 9, 1, i) for i in range(500)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True)
def plain_plans(spark):
    """Plans as they are for large inputs: nothing small enough to broadcast, no adaptive wrapper."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan_of(df)))


def window_keys(df):
    """Partition columns of every window, without expression ids."""
    found = re.findall(r"Window \[.*\], \[([^\]]*)\], \[[^\]]*\]", plan_of(df))
    return {tuple(re.sub(r"#\d+L?", "", part).split(", ")) for part in found}


def test_grid_shuffles_rows_once_and_steps_once(polls):
    grid = polls_to_grid(polls)
    # rows, the summary of the chunks, its windows, and the steps, which are summed before
    assert window_keys(grid) == {("_key", "_chunk"), ("_key",)}
    plan = plan_of(grid)
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1 and "partial_sum" in plan
    assert "gid" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_filling_reads_the_source_once(polls):
    activity = add_movements(polls, chunk="1h")
    df = upsample(polls.drop("gid"))
    assert plan_of(df).count("FileScan") == 1 and "ReusedExchange" in plan_of(df)
    assert window_keys(df) == {("_key", "_chunk"), ("_key",)}
    # hours are aggregated first: one shuffle for the totals, one for the hour that follows, which serves the heatmap as well
    for df, shuffles in ((hourly_totals(polls, "available_bikes"), 2), (activity_heatmap(polls, "available_bikes"), 2)):
        plan = plan_of(df)
        assert plan.count("FileScan") == 1 and len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) == shuffles
        assert window_keys(df) == {("station_id",)}
    assert plan_of(activity).count("FileScan") == 1


def test_copies_meet_before_the_shuffle(polls):
    plan = plan_of(deduplicate(polls.drop("gid")))
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning(station_id")


def test_row_windows_stay_in_chunks(polls):
    moved = add_movements(polls, ["transactions_out"], chunk="1h")
    # _key wraps the station; the window over whole stations works on the summary of one row per chunk
    assert window_keys(moved) == {("_key", "_chunk"), ("_key",)}
    plan = plan_of(moved)
    assert "partial_max_by" in plan
    # of the rows, named once more where it is reused, and of the summary
    assert len(re.findall(r"Exchange hashpartitioning\(_key#\d+, _chunk#\d+L", plan)) == 3
    assert plan.count("ReusedExchange") == 1


def test_chunked_operators_read_the_source_once(polls):
    """Extra columns included: the summary and the rows share one shuffle."""
    moved = add_movements(polls, chunk="1h")
    for df in (
        moved, get_transactions_out(polls), get_consecutive_no_transactions_out(moved, chunk="1h"), smooth_status(polls),
        forward_fill(polls, "status"), add_movements_and_idle(polls),
    ):
        plan = plan_of(df)
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_idle_windows(polls):
    idle = get_consecutive_no_transactions_out(add_movements(polls, chunk="1h"), chunk="1h")
    assert window_keys(idle) <= {("_key", "_chunk"), ("_key",), ("_key", "_stretch")}


def test_rolling_windows_stay_in_blocks(polls):
    built = build_lag_and_rolling_feat(polls.select("station_id", "date", "available_bikes"), "available_bikes")
    assert window_keys(built) == {("_key", "_chunk"), ("_key",), ("station_id", "_block")}
    # one sort serves all windows of a block
    assert len(re.findall(r"Sort \[station_id#\d+ ASC NULLS FIRST, _block", plan_of(built))) == 1


def test_filters_reach_the_scan(polls):
    plan = plan_of(filters.date_slice(polls, "2024-01-01", "2024-01-02").where("station_id = 2"))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "EqualTo(station_id,2)" in pushed and "GreaterThanOrEqual(date" in pushed and "LessThanOrEqual(date" in pushed


def test_training_counts_before_the_shuffle(polls):
    ready = polls.selectExpr("*", "1L AS consecutive_no_transactions_out")
    plan = plan_of(count_combinations(training_rows(ready)))
    assert "partial_count" in plan and plan.count("Exchange") == 1
    assert re.search(r"ReadSchema: (\S+)", plan).group(1) == "struct<station_id:int,date:timestamp_ntz,status:int>"


def test_movements_and_idle_share_one_shuffle_of_the_rows(polls):
    needed = polls.drop("gid").where("station_id IS NOT NULL")
    plan = plan_of(add_movements_and_idle(needed, ["transactions_out"]))
    assert re.search(r"ReusedExchange \[station_id#\d+, date#\d+, available_stands#\d+L", plan)
    assert len(re.findall(r"FileScan parquet \[station_id#\d+,date#\d+,available_stands#\d+L,available_bikes", plan)) == 1
