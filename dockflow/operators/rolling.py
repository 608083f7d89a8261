"""Lag and rolling features of the forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.functions.calendar import process_temporal_feat
from dockflow.operators.timeline import GRID_CHUNK, with_row_number

LAGS = (1, 2, 3)
#: Rolling window sizes in rows, by the ending of the column name.
WINDOWS = {"6": 6, "12": 12, "1d": 144, "7d": 1008}
#: Rows per block. With the history of the longest window a block stays below the 4096 rows that Spark's window operator
#: holds in memory before it turns to its spillable buffer.
BLOCK = 3 * 1008


def build_lag_and_rolling_feat(
    df: DataFrame, target_col: str, key: str = "station_id", date: str = "date", ties: Sequence[str] = (),
    block: int = BLOCK, chunk: str = GRID_CHUNK,
) -> DataFrame:
    """Add lags 1-3 and rolling max / min over 6, 12, 144 and 1008 rows.

    A rolling value is null until its window is full and when the window holds a null.

    Rows are numbered per station and cut into blocks of ``block`` rows; the last 1007 rows of a block are also sent
    to the next one, where they only serve as history. So no window partition exceeds ``block + 1007`` rows.
    Within it the maximum over 2k rows comes from two maxima over k rows, which takes ten passes of one sort
    instead of a thousand comparisons per row.
    """
    longest = max([*WINDOWS.values(), *(n + 1 for n in LAGS)])
    if block < longest:
        raise ValueError(f"block must hold at least {longest} rows")
    number = F.col("_rn") - 1
    own = F.floor(number / block)
    tail = number % block >= block - (longest - 1)
    placed = with_row_number(df, key, date, ties, chunk=chunk).withColumns(
        {
            "_own": own,
            "_block": F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))),
            "_seen": F.col(target_col).isNotNull().cast("int"),
        }
    )
    w = Window.partitionBy(key, "_block").orderBy("_rn")
    d = placed.withColumns(
        {f"{target_col}_lag_{n}": F.lag(target_col, n).over(w) for n in LAGS}
        | {
            "_filled": F.sum("_seen").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_max": F.col(target_col),
            "_min": F.col(target_col),
        }
    )
    # _max and _min cover `size` rows; a window of size..2*size-1 rows is two of them, shifted
    picks = {"max": F.greatest, "min": F.least}
    size = 1
    while size <= longest:
        step = {}
        for suffix, rows in WINDOWS.items():
            if size <= rows < 2 * size:
                for side, pick in picks.items():
                    step[f"_roll_{side}_{suffix}"] = pick(f"_{side}", F.lag(f"_{side}", rows - size).over(w))
                step[f"_filled_{suffix}"] = F.col("_filled") - F.coalesce(F.lag("_filled", rows).over(w), F.lit(0))
        if 2 * size <= longest:
            for side, pick in picks.items():
                step[f"_{side}"] = pick(f"_{side}", F.lag(f"_{side}", size).over(w))
        d = d.withColumns(step)
        size *= 2
    kept = d.where(F.col("_block") == F.col("_own"))
    lags = [F.col(f"{target_col}_lag_{n}") for n in LAGS]
    rolls = [
        F.when(F.col(f"_filled_{suffix}") == rows, F.col(f"_roll_{side}_{suffix}")).alias(
            f"{target_col}_rolling_{side}_{suffix}"
        )
        for side in ("max", "min")
        for suffix, rows in WINDOWS.items()
    ]
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], *lags, *rolls)


def build_feat_for_regression(df: DataFrame, target_col: str, **options) -> DataFrame:
    """Calendar features plus lag and rolling features."""
    return build_lag_and_rolling_feat(process_temporal_feat(df), target_col, **options)
