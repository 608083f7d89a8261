"""One anomaly detector per station, fitted and applied for the whole fleet at once.

The detector sees only (idle run, quarter, weekday, hour). So a station's rows are first counted per combination, which
combines before the shuffle and leaves at most ``(max_idle + 1) * 4 * 7 * 24`` rows per station (97,440 by default)
however long its history. Scaling, components, trees and the threshold are computed from these counts, which
gives the same result as from the rows. All is column expressions and aggregates but the drawing of rows, the growth of the trees
and the scores behind the threshold, which are made in Python station by station, in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.functions.calendar import get_encoding_time, iso_weekday, process_data_cluster
from dockflow.functions.scalars import anomaly_probability
from dockflow.models.components import coordinates, principal_components
from dockflow.models.isolation import SAMPLE, TREES, fit, score_sql
from dockflow.operators.filters import filter_periode, usable_rows
from dockflow.operators.lookups import with_profile
from dockflow.operators.profile import idle_percentile
from dockflow.schemas import CLOSED_PERIOD, DETECTOR_FEATURES, IDLE_LIMITS, MAX_IDLE_STEPS, SEED, UNUSED_STATIONS
from dockflow.session import settle, spread

RUN = "consecutive_no_transactions_out"
COMBINATION = (RUN, "quarter", "weekday", "hours")
#: Largest share of anomalies that a threshold is set for.
MAX_CONTAMINATION = 0.5
#: Idle runs per scoring group: bounds a group to 64 * 4 * 7 * 24 combinations.
RUN_BAND = 64

MODEL_SCHEMA = (
    "station_id int, rows bigint, sample_rows int, contamination double, reason string, "
    "threshold double, mean array<double>, scale array<double>, components array<double>, "
    "split_feature array<int>, split_at array<double>, path_length array<double>"
)


def training_rows(
    df: DataFrame, period: tuple[str, str] = CLOSED_PERIOD,
    non_use_station_id: Sequence[int] | None = UNUSED_STATIONS, max_idle: int = MAX_IDLE_STEPS,
) -> DataFrame:
    """Rows the detector learns from: outside the closed period, open station, idle run not too long."""
    return usable_rows(filter_periode(df, non_use_station_id, period), max_idle)


def count_combinations(df: DataFrame, key: str = "station_id", date: str = "date") -> DataFrame:
    """Rows per station and detector combination, as ``rows``."""
    return df.groupBy(
        F.col(key),
        F.col(RUN).cast("bigint").alias(RUN),
        F.quarter(date).alias("quarter"),
        iso_weekday(date).alias("weekday"),
        F.hour(date).alias("hours"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def add_encodings(counted: DataFrame) -> DataFrame:
    return (
        counted.transform(get_encoding_time, "quarter", max_val=4)
        .transform(get_encoding_time, "weekday", max_val=7)
        .transform(get_encoding_time, "hours", max_val=24)
    )


def feature_moments(counted: DataFrame, key: str = "station_id") -> DataFrame:
    """Per station: ``rows``, and ``mean`` and population ``covariance`` (upper triangle, row by row) of the features.

    Two passes over the counts, so a constant feature gets a variance of 0. Values are rounded to nine places: the order
    in which partial sums meet must not turn components of equal variance.
    """
    run, calendar = DETECTOR_FEATURES.index(RUN), COMBINATION[1:]
    n = F.sum("rows")
    # rows of the same quarter, weekday and hour differ in the idle run only: few are left for the sums of products
    summed = counted.groupBy(key, *calendar).agg(n.alias("rows"), F.sum(F.col("rows") * F.col(RUN)).alias("_sum"))
    total = [F.col("_sum") if i == run else F.col("rows") * F.col(f) for i, f in enumerate(DETECTOR_FEATURES)]
    means = add_encodings(summed).groupBy(key).agg(
        n.alias("_n"), *[F.round(F.sum(t) / n, 9).alias(f"_mean_{i}") for i, t in enumerate(total)]
    )
    gap = F.col(RUN) - F.col(f"_mean_{run}")
    apart = counted.join(means.select(key, f"_mean_{run}"), key).groupBy(key, *calendar).agg(
        n.alias("rows"), F.sum(F.col("rows") * gap).alias("_gap"), F.sum(F.col("rows") * gap * gap).alias("_square")
    )
    gaps = [F.col(f) - F.col(f"_mean_{i}") if i != run else None for i, f in enumerate(DETECTOR_FEATURES)]
    centred = add_encodings(apart).join(means, key)

    def product(i: int, j: int) -> Column:
        if i == j == run:
            return F.col("_square")
        return F.col("_gap") * gaps[j if i == run else i] if run in (i, j) else F.col("rows") * gaps[i] * gaps[j]

    pairs = [
        F.round(F.sum(product(i, j)) / F.sum("rows"), 9).alias(f"_c_{i}_{j}") for i in range(len(gaps)) for j in range(i, len(gaps))
    ]
    mean_columns = [f"_mean_{i}" for i in range(len(gaps))]
    out = centred.groupBy(key, "_n", *mean_columns).agg(*pairs)
    triangle = [f"_c_{i}_{j}" for i in range(len(gaps)) for j in range(i, len(gaps))]
    return out.select(
        key, F.col("_n").alias("rows"), F.array(*mean_columns).alias("mean"), F.array(*triangle).alias("covariance")
    )


def standardise(df: DataFrame, features: Sequence[str] = DETECTOR_FEATURES, key: str = "station_id") -> DataFrame:
    """Add ``z_<feature>``: distance to the station's mean in population standard deviations (1 when constant)."""
    stats = df.groupBy(key).agg(
        *[F.avg(f).alias(f"_mean_{f}") for f in features], *[F.stddev_pop(f).alias(f"_std_{f}") for f in features]
    )
    scale = {f: F.when(F.col(f"_std_{f}") < 1e-12, 1.0).otherwise(F.col(f"_std_{f}")) for f in features}
    scaled = df.join(stats, key).withColumns({f"z_{f}": (F.col(f) - F.col(f"_mean_{f}")) / scale[f] for f in features})
    return scaled.drop(*[f"_mean_{f}" for f in features], *[f"_std_{f}" for f in features])


def contamination(
    counted: DataFrame, profile: DataFrame | None, label: str | None = None, rules: Mapping[str, int] = IDLE_LIMITS,
    key: str = "station_id",
) -> DataFrame:
    """Expected share of anomalies per station: rows idle for longer than the limit of the station's label."""
    runs = counted.groupBy(key, RUN).agg(F.sum("rows").alias("rows"))  # the limit looks at nothing else
    labelled = with_profile(runs, profile, label, key)
    limits = F.create_map(*[F.lit(item) for pair in rules.items() for item in pair])
    limited = labelled.withColumn("_limit", limits[F.col("profile_station_activity")])
    share = idle_percentile(limited, F.col("_limit"), RUN, key, weight="rows")
    return share.select(key, (1 - F.col("percentile") / 100).alias("contamination"))


def _reason(share: str) -> Column:
    """Why no threshold can be set for a share of anomalies."""
    usable = (F.col(share) > 0) & (F.col(share) <= MAX_CONTAMINATION)
    missing = F.col(share).isNull() | F.isnan(share)
    return F.when(missing, "no limit for the station's label").when(~usable, f"share of anomalies outside (0, {MAX_CONTAMINATION}]")


def train_cluster_station(
    df: DataFrame, station_id: int | None = None, profile_station_activity: str | None = None,
    profile: DataFrame | None = None, rules: Mapping[str, int] = IDLE_LIMITS, period: tuple[str, str] = CLOSED_PERIOD,
    non_use_station_id: Sequence[int] | None = UNUSED_STATIONS, max_idle: int = MAX_IDLE_STEPS, seed: int = SEED,
    trees: int = TREES, sample: int = SAMPLE,
) -> DataFrame:
    """Model table, one row per station (or for the one asked for).

    Give the activity ``profile`` table, or one label for all stations. A station whose label is missing or unknown, or whose
    share of anomalies isn't above 0 and at most 0.5, has a null ``threshold`` and the ``reason``; it gets no anomaly flags. One
    unknown label for all is an error.

    Each of the ``trees`` isolation trees is grown, as published, on ``sample`` rows drawn from the counts of all rows.
    """
    if profile is None and profile_station_activity is None:
        raise ValueError("give a profile table or a label")
    if profile is None and profile_station_activity not in rules:
        raise ValueError(f"no idle limit for the label {profile_station_activity!r}")
    if station_id is not None:
        df = df.where(F.col("station_id") == station_id)
    # small, and read by the moments, the contamination and the trees: computed once
    counted = settle(count_combinations(training_rows(df, period, non_use_station_id, max_idle)))
    moments = spread(feature_moments(counted), "station_id").withColumn("_p", principal_components("mean", "covariance", "rows"))
    setup = moments.join(contamination(counted, profile, profile_station_activity, rules), "station_id")
    setup = settle(setup.select(
        "station_id", F.col("rows").alias("total"), F.least(F.col("rows"), F.lit(sample)).cast("int").alias("size"), "contamination",
        _reason("contamination").alias("reason"), "mean", F.col("_p.scale").alias("scale"), F.col("_p.components").alias("components"),
    ))
    models = fit(counted, setup, list(COMBINATION), _features(df.sparkSession), seed, trees, sample)
    models = models.withColumns({"station_id": F.col("station_id").cast("int"), "rows": F.col("total"), "sample_rows": F.col("size")})
    # written: later steps read it more than once, and the trees are grown once
    return settle(models.select(*[c.split()[0] for c in MODEL_SCHEMA.split(", ")]))


def _features(spark: SparkSession) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Makes rows of ``DETECTOR_FEATURES`` from columns of ``COMBINATION``, with the sines and cosines that Spark has."""
    steps = spark.range(25).select(*[F.col("id").alias(c) for c in COMBINATION[1:]])
    known = {f: [r[f] for r in rows] for rows in [add_encodings(steps).orderBy("hours").collect()] for f in DETECTOR_FEATURES if f != RUN}

    def made(columns: list[np.ndarray]) -> np.ndarray:
        of = dict(zip(COMBINATION, columns))
        return np.stack([of[RUN].astype(float) if f == RUN else np.array(known[f])[of[f.partition("_")[2]]] for f in DETECTOR_FEATURES], axis=1)

    return made


def _scores(combos: DataFrame, models: DataFrame, column: str, *carried: str) -> DataFrame:
    """``score`` of every combination of a modelled station, with one ``column`` of its model.

    Combinations of a station are cut by idle run into groups of bounded size, each gathered in a row that meets the model's arrays
    once; the trees are walked by column expressions.
    """
    values = F.array(*[F.col(f).cast("double") for f in DETECTOR_FEATURES])
    each = F.struct(*COMBINATION, *carried, values.alias("_values"))
    # few bytes and much work each: dealt over all tasks, which adaptive execution would merge by size
    banded = spread(combos.withColumn("_band", F.floor(F.col(RUN) / RUN_BAND)), "station_id")
    grouped = add_encodings(banded).groupBy("station_id", "_band").agg(F.collect_list(each).alias("_each"))
    paths = F.transform("path_length", lambda x: F.round(x * 1_000_000_000.0).cast("bigint"))
    held = spread(models.withColumn("_billionths", paths).drop("rows"), "station_id")
    kept = ", ".join(f"'{c}', c.{c}" for c in (*COMBINATION, *carried))
    scored = F.expr(f"inline(transform(_each, c -> named_struct({kept}, 'score', {score_sql(coordinates('c._values'))})))")
    return grouped.join(held, "station_id").select("station_id", column, scored)


def score_combinations(combos: DataFrame, models: DataFrame) -> DataFrame:
    """``decision`` of every distinct combination of a modelled station; below 0 is an anomaly. Null without a threshold."""
    scored = _scores(combos, models, "threshold")
    return scored.select("station_id", *COMBINATION, (F.col("score") - F.col("threshold")).alias("decision"))


def predict_anomalies_station(
    df: DataFrame, models: DataFrame, station_id: int | None = None, with_score: bool = False
) -> DataFrame:
    """Add the detector features and ``anomaly`` (-1 or 1); with ``with_score`` also ``decision`` and ``anomaly_score``.

    Only distinct combinations are scored; rows meet their decision in a join. A station without a model or
    without a threshold keeps its rows with nulls. No rows for a station give an empty result.
    """
    if station_id is not None:
        df = df.where(F.col("station_id") == station_id)
        models = models.where(F.col("station_id") == station_id)
    rows = process_data_cluster(df)
    combos = rows.select(
        "station_id", F.col(RUN).cast("bigint").alias(RUN), "quarter", "weekday", "hours"
    ).distinct()
    scored = score_combinations(combos, models)
    out = rows.join(scored, ["station_id", *COMBINATION], "left")
    flag = F.when(F.col("decision") < 0, -1).when(F.col("decision").isNotNull(), 1).alias("anomaly")
    score = [F.col("decision"), (anomaly_probability("decision") * 100).alias("anomaly_score")] if with_score else []
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], flag, *score)


def add_anomaly_score(df: DataFrame, decision: str | Column = "decision") -> DataFrame:
    """Decision to a score of 0-100; 50 is the border."""
    return df.withColumn("anomaly_score", anomaly_probability(decision) * 100)


def project_rows(df: DataFrame, models: DataFrame, dims: int = 2) -> DataFrame:
    """Rows with their places ``axis_1``, ``axis_2``, ... along a model's components, for a plot of two or three dimensions.

    A station that keeps fewer components has null in the others, one without a model in all.
    """
    values = F.array(*[F.col(f).cast("double") for f in DETECTOR_FEATURES])
    held = models.select("station_id", "mean", "scale", "components")
    rows = process_data_cluster(df).withColumn("_values", values).join(held, "station_id", "left")
    placed = rows.withColumn("_point", F.when(F.col("components").isNotNull(), F.expr(coordinates("_values"))))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], *[F.get("_point", F.lit(d)).alias(f"axis_{d + 1}") for d in range(dims)])
