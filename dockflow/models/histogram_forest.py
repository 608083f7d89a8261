"""Regression forests of all stations, grown level by level from histograms.

The rows of all stations stay spread as they are. Every feature is cut into bins of equal width between the station's smallest and
largest value, with bin 0 for a missing one. On each level one aggregate counts the rows, and sums their targets, per (station,
tree, node, feature, bin), combined before the shuffle; the best cut of each node is chosen from these counts, and rows move on to
the next level. So no task holds a station, and a long history only means more rows to count.

Randomness comes from hashes: a row takes part in a tree as often as a Poisson draw from the md5 of (seed, station, date) says, and a
node may use a feature if the md5 of (seed, tree, node, feature) isn't divisible by 4. The same rows give the same forest whatever
the partitioning, as long as targets are whole numbers, whose sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.functions.durations import wall_seconds
from dockflow.schemas import SEED
from dockflow.session import settle, spread

TREES, DEPTH, BINS = 50, 6, 64
#: Of 65,536 equally likely numbers those below the k-th value draw k or less, by the Poisson distribution with mean 1.
POISSON = (24109, 48219, 60273, 64291, 65296, 65497, 65531, 65535)
#: Trees that one md5 serves, with 16 bits each.
_PER_HASH = 8
_KEYS = ["station_id", "tree", "node"]


def bin_of(value: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Bin of a value, 1 to ``bins`` between the smallest and the largest; 0 if it is missing, 1 if all are equal."""
    place = F.floor(F.round((value - low) * (bins - 1) / (high - low), 6))
    inside = F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)) + 1
    return F.when(value.isNull(), 0).when(high > low, inside).otherwise(1).cast("int")


def draws(seed: int, trees: int) -> tuple[Column, Column]:
    """The digits of a row's hashes, to be named ``_digits``, and from them how often it takes part in each tree, as an array."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("station_id").cast("string"), F.lit("")), wall_seconds("date").cast("bigint").cast("string"))
    groups = -(-trees // _PER_HASH)
    digits = F.concat(*[F.md5(F.concat(text, F.lit(f":{g}"))) for g in range(groups)])

    def drawn(tree: Column) -> Column:
        number = F.conv(F.substring(F.col("_digits"), tree * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return sum(((number >= t).cast("int") for t in POISSON[1:]), (number >= POISSON[0]).cast("int"))

    return digits, F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)


def prepared(rows: DataFrame, features: Sequence[str], seed: int = SEED, trees: int = TREES, bins: int = BINS) -> DataFrame:
    """Rows with their ``bins``, their ``draws`` and the ``nodes`` they are in (all in the root).

    ``rows`` have ``station_id``, ``date``, ``target``, ``asked`` and the features; rows that are asked for never train.
    """
    known = rows.where(~F.col("asked"))
    ends = [f(F.col(c)).alias(f"_{n}_{i}") for i, c in enumerate(features) for n, f in (("low", F.min), ("high", F.max))]
    ranges = known.groupBy(F.col("station_id").alias("_station")).agg(*ends)
    placed = rows.join(ranges, F.col("station_id").eqNullSafe(F.col("_station")), "left")
    cells = [bin_of(F.col(c), F.col(f"_low_{i}"), F.col(f"_high_{i}"), bins) for i, c in enumerate(features)]
    digits, drawn = draws(seed, trees)
    return placed.withColumn("_digits", digits).select(
        "station_id", "date", "asked", "target", F.array(*cells).alias("bins"), drawn.alias("draws"),
        F.array_repeat(F.lit(0), trees).alias("nodes"),
    )


def allowed_features(seed: int, tree: int, node: int, count: int) -> int:
    """The features a node may use, as bits."""
    hashes = (hashlib.md5(f"{seed}:{tree}:{node}:{f}".encode()).hexdigest()[:2] for f in range(count))
    return sum(1 << f for f, h in enumerate(hashes) if int(h, 16) % 4)


def _in_trees(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per training row and tree that drew it: ``tree``, ``node``, ``times``."""
    pairs = F.posexplode(F.arrays_zip("nodes", "draws")).alias("tree", "_pair")
    spread = rows.where(~F.col("asked")).select("station_id", "target", *columns, pairs)
    return spread.where("_pair.draws > 0").select(
        "station_id", "target", *columns, "tree", F.col("_pair.nodes").alias("node"), F.col("_pair.draws").alias("times")
    )


def level_histogram(rows: DataFrame, level: int, features: int, seed: int = SEED, trees: int = TREES) -> DataFrame:
    """``n`` and ``s``, the sum of the targets, per station, tree, node of the level, feature it may use, and bin."""
    first, width = 2**level - 1, 2**level
    masks = F.array(*[F.lit(allowed_features(seed, t, first + k, features)) for t in range(trees) for k in range(width)])
    here = _in_trees(rows, "bins").where(F.col("node") >= first)
    mask = F.element_at(masks, F.col("tree") * width + F.col("node") - first + 1)
    cells = here.select("station_id", "tree", "node", "times", "target", mask.alias("_mask"), F.posexplode("bins").alias("feature", "bin"))
    cells = cells.where(F.expr("shiftright(_mask, feature) & 1") == 1)
    weighted = F.sum(F.col("times") * F.col("target"))
    return cells.groupBy(*_KEYS, "feature", "bin").agg(F.sum("times").alias("n"), weighted.alias("s"))


def best_splits(histogram: DataFrame) -> DataFrame:
    """The cut of each node that lowers the squared error most: ``feature`` and ``cut``, its last bin on the left side.

    Of equal gains the first feature and then the first bin wins. A node without a cut that lowers the error has no row.
    """
    group = Window.partitionBy(*_KEYS, "feature")
    running = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.select(
        *_KEYS, "feature", "bin", F.sum("n").over(running).alias("n_l"), F.sum("s").over(running).alias("s_l"),
        F.sum("n").over(group).alias("n_all"), F.sum("s").over(group).alias("s_all"),
    ).where("n_l < n_all")
    left, right = "s_l * s_l / n_l", "(s_all - s_l) * (s_all - s_l) / (n_all - n_l)"
    gain = F.round(F.expr(f"{left} + {right} - s_all * s_all / n_all"), 6)
    best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("cut"))).alias("_best")
    chosen = summed.groupBy(*_KEYS).agg(best).where("_best.gain > 0")
    return chosen.select(*_KEYS, (-F.col("_best.feature")).alias("feature"), (-F.col("_best.cut")).alias("cut"), "_best.gain")


def next_level(rows: DataFrame, splits: DataFrame, level: int) -> DataFrame:
    """Move the rows of divided nodes to their children; the others stay in their leaf."""
    first, width = 2**level - 1, 2**level
    place = (F.col("tree") * width + F.col("node") - first).alias("place")
    table = splits.groupBy(F.col("station_id").alias("_station")).agg(
        F.map_from_entries(F.collect_list(F.struct(place, F.struct("feature", "cut")))).alias("_splits")
    )
    joined = rows.join(table, F.col("station_id").eqNullSafe(F.col("_station")), "left")
    moved = F.expr(
        f"transform(nodes, (node, tree) -> transform(array(if(node < {first}, null, try_element_at(_splits, tree * {width} + node - {first}))), "
        "s -> if(s is null, node, 2 * node + 1 + int(bins[s.feature] > s.cut)))[0])"
    )
    return joined.withColumn("nodes", F.coalesce(moved, F.col("nodes"))).drop("_station", "_splits")


def forest_answers(
    rows: DataFrame, features: Sequence[str], seed: int = SEED, trees: int = TREES, depth: int = DEPTH, bins: int = BINS
) -> DataFrame:
    """``station_id``, ``date`` and ``answer``, the mean of the trees' leaves, for every row asked for; null where nothing trains."""
    # a row is small, but it takes part in most trees with all its features
    rows = settle(spread(prepared(rows, features, seed, trees, bins), "station_id", "date"))
    for level in range(depth):
        splits = settle(best_splits(level_histogram(rows, level, len(features), seed, trees)))
        rows = settle(next_level(rows, splits, level))
    leaves = _in_trees(rows).groupBy(*_KEYS).agg((F.sum(F.col("times") * F.col("target")) / F.sum("times")).alias("mean"))
    leaves = leaves.withColumnsRenamed({c: f"_{c}" for c in _KEYS})
    asked = rows.where("asked").select("station_id", "date", F.posexplode("nodes").alias("tree", "node"))
    same = [F.col("station_id").eqNullSafe(F.col("_station_id")), F.col("tree") == F.col("_tree"), F.col("node") == F.col("_node")]
    return asked.join(leaves, same, "left").groupBy("station_id", "date").agg(F.round(F.avg("mean"), 6).alias("answer"))
