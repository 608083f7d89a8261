"""Activity profile of stations: statistics of the activity bit and the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.schemas import PROFILE_LABELS


def _bit_quantile(q: float) -> Column:
    """Nearest-rank quantile of a 0/1 column from its count and sum: no sort, no percentile sketch.

    Position ``round((n - 1) * q)`` of the sorted bits is a 1 when it falls among the last ``sum`` rows.
    """
    n, ones = F.col("total_point"), F.col("_ones")
    position = F.floor((n - 1) * q + 0.5)
    return F.when(n > 0, F.when(position >= n - ones, 1.0).otherwise(0.0))


def activity_statistics(df: DataFrame, bit: str = "transactions_out_bool", key: str = "station_id") -> DataFrame:
    """Per station: count, mean, median, standard deviation, high quantiles and maximum of a 0/1 column.

    Everything follows from a handful of sums, which combine before the shuffle.
    """
    base = df.groupBy(key).agg(
        F.count(bit).alias("total_point"),
        F.avg(bit).alias("mean"),
        F.stddev_samp(bit).alias("std"),
        F.max(bit).alias("max"),
        F.sum(bit).alias("_ones"),
    )
    n, ones = F.col("total_point"), F.col("_ones")
    zeros = n - ones
    low, high = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    median = F.when(
        n > 0, (F.when(low >= zeros, 1.0).otherwise(0.0) + F.when(high >= zeros, 1.0).otherwise(0.0)) / 2
    )
    return base.select(
        key,
        "total_point",
        "mean",
        median.alias("median"),
        "std",
        _bit_quantile(0.95).alias("95%"),
        _bit_quantile(0.98).alias("98%"),
        _bit_quantile(0.99).alias("99%"),
        "max",
    )


def calculate_breakpoints(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Inner borders of ``bins`` equally wide bins between the smallest and largest value: ``bin, breakpoint``."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    borders = [
        F.struct(F.lit(i).alias("bin"), (F.col("_low") + (F.col("_high") - F.col("_low")) / bins * i).alias("breakpoint"))
        for i in range(1, bins)
    ]
    return ends.select(F.inline(F.array(*borders)))


def cut(
    df: DataFrame, column: str, name: str = "profile_station_activity", labels: Sequence[str] = PROFILE_LABELS
) -> DataFrame:
    """Label rows by equally wide bins of ``column``; a value on a border belongs to the lower bin."""
    bins = len(labels)
    low, high = (df.select(f(column)).scalar() for f in (F.min, F.max))
    label = F.when(F.col(column).isNull(), F.lit(None).cast("string"))
    for i, text in enumerate(labels[:-1], start=1):
        label = label.when(F.col(column) <= low + (high - low) / bins * i, text)
    return df.withColumn(name, label.otherwise(labels[-1]))


def idle_percentile(
    df: DataFrame, limit: Column, column: str = "consecutive_no_transactions_out", key: str = "station_id",
    weight: str | None = None,
) -> DataFrame:
    """Share, in percent, of a station's values below its ``limit``; equal values count half. Null without a limit.

    With ``weight`` the rows are already counted groups of equal values.
    """
    w = F.col(weight) if weight else F.lit(1)
    value = F.col(column)

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition & value.isNotNull(), w).otherwise(0))

    out = df.groupBy(key).agg(
        counted(value.isNotNull()).alias("_n"),
        counted(value < limit).alias("_below"),
        counted(value <= limit).alias("_upto"),
        F.max(limit.isNotNull()).alias("_limited"),
    )
    tie = F.when(F.col("_upto") > F.col("_below"), 1).otherwise(0)
    percent = (F.col("_below") + F.col("_upto") + tie) * 50.0 / F.col("_n")
    return out.select(key, F.col("_n").alias("rows"), F.when(F.col("_limited"), percent).alias("percentile"))
