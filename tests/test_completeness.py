"""Missing, doubled and unordered hours."""

from datetime import datetime, timedelta

import pytest

from dockflow.operators.completeness import hourly_problems

START = datetime(2024, 5, 1)


@pytest.mark.parametrize("rows", [2, 3, 4096])
def test_problems_by_hand(spark, rows):
    hours = {1: [0, 1, 1, 4, 3, 5, 2], None: [0, 2], 7: [3], 8: [None], 9: [0, 1, 2]}
    table = [
        (station, 10 * p, None if h is None else START + timedelta(hours=h, minutes=5 * p)) for station, hs in hours.items() for p, h in enumerate(hs)
    ]
    df = spark.createDataFrame(table, "station_id int, place long, date timestamp_ntz").repartition(3)
    got = sorted(((r.station_id, (r.hour - START).seconds // 3600, r.problem, r.n) for r in hourly_problems(df, "place", rows=rows * 10).collect()), key=str)
    assert got == sorted([(1, 1, "doubled", 2), (1, 3, "unordered", 1), (1, 2, "unordered", 1), (None, 1, "missing", 0)], key=str)
    assert hourly_problems(df.limit(0), "place").count() == 0
