import pytest

from dockflow.plans.requests import chunk_list, generate_date_intervals, request_plan

CASES = [
    ("2025-01-01", "2025-01-10", 4, [("2025-01-01", "2025-01-05"), ("2025-01-05", "2025-01-09"), ("2025-01-09", "2025-01-10")]),
    ("2025-01-01", "2025-01-02", 4, [("2025-01-01", "2025-01-02")]),
    ("2025-01-01", "2025-01-15", 7, [("2025-01-01", "2025-01-08"), ("2025-01-08", "2025-01-15")]),
    ("2025-01-01", "2025-01-20", 10, [("2025-01-01", "2025-01-11"), ("2025-01-11", "2025-01-20")]),
    ("2025-01-01", "2025-01-01", 4, []),
]


@pytest.mark.parametrize("start, stop, days, expected", CASES)
def test_intervals(spark, start, stop, days, expected):
    out = generate_date_intervals(spark, start, stop, days).orderBy("start_date")
    assert [tuple(r) for r in out.collect()] == expected


def test_reversed_dates(spark):
    with pytest.raises(ValueError):
        generate_date_intervals(spark, "2025-01-02", "2025-01-01")


@pytest.mark.parametrize(
    "ids, size, expected",
    [(range(1, 11), 3, [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]), (range(1, 6), 2, [[1, 2], [3, 4], [5]]),
     (range(1, 4), 1, [[1], [2], [3]]), (range(1, 6), 5, [[1, 2, 3, 4, 5]]), ([], 3, [])],
)
@pytest.mark.parametrize("span", [2, 4, 1000])
def test_chunks(spark, ids, size, expected, span):
    df = spark.createDataFrame([(i,) for i in ids], "station_id int")
    assert [r.station_ids for r in chunk_list(df, size, span=span).orderBy("chunk").collect()] == expected


def test_plan(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "station_id int")
    plan = request_plan(df, "2025-01-01", "2025-01-10", 4, 3)
    assert plan.count() == 9
    assert {tuple(r.station_ids) for r in plan.collect()} == {(0, 1, 2), (3, 4, 5), (6,)}
