"""Isolation trees of all stations: drawn and grown station by station in tasks, kept as arrays, walked by column expressions.

Randomness comes from md5 digests of (seed, station, tree, ...): a tree is grown on the ``sample`` rows with the smallest digests,
a node is divided on the movable axis with the largest digest, at the place that another digest says. The same rows give the same
trees whatever the partitioning. Stations are dealt over all tasks. One holds a combination once however often it occurs, and at most
``trees * sample`` drawn rows, so a group is bounded however long the history.

``fit`` does in one pass over a station's combinations what ``draw``, ``grow``, ``as_arrays``, scoring and ``counted_percentile`` do
one after the other, with the same steps: neither drawn rows nor nodes nor scores are shuffled.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import spread

TREES = 50
SAMPLE = 256
#: Trees that one md5 serves when rows are drawn, with 32 bits each.
_PER_HASH = 4
#: Share of the rows that is looked at for a sample, as a multiple of what the sample needs.
_MARGIN = 2
#: Rows whose digests are held at once.
_ROWS = 4_096
#: Additions and turns of md5.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Most bytes of a text that fits in one block of md5, of 64 bytes; blocks that are done at once.
_ONE_BLOCK, _LANES = 55, 16_384


def usual_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among ``n`` points, to nine places."""
    many = F.greatest(n, F.lit(3)).cast("double")
    mean = 2 * (F.log(many - 1) + 0.5772156649015329) - 2 * (many - 1) / many
    return F.when(n > 2, F.round(mean, 9)).when(n == 2, 1.0).otherwise(0.0)


def tree_depth(size: Column) -> Column:
    """Levels below the root of a tree over ``size`` rows."""
    return F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double"))).cast("int")


def tree_nodes(size: Column) -> Column:
    """Heap positions of a tree over ``size`` rows."""
    return (F.pow(F.lit(2.0), tree_depth(size) + 1) - 1).cast("int")


def draw(points: DataFrame, identity: list[str], seed: int, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Rows per tree: ``tree``, ``point`` and ``members`` equal ones drawn.

    ``points`` holds ``station_id``, the columns of ``identity`` (whole numbers, not null), ``rows`` (how often the combination occurs),
    ``total`` rows of the station, and ``point``. Each tree takes the ``sample`` rows of the station with the smallest digests, all if
    there are fewer. A task holds a station's combinations and, of its rows, those whose digest can be among these.
    """
    types = dict(points.dtypes)
    needed = points.select("station_id", *identity, F.col("rows").cast("bigint").alias("rows"), "total", "point")

    def run(table: pa.Table) -> pa.Table:
        whole = table.sort_by([(c, "ascending") for c in identity]).combine_chunks()
        station, total = whole["station_id"][0].as_py(), whole["total"][0].as_py()
        drawn = _drawn(station, [whole[c].to_numpy() for c in identity], whole["rows"].to_numpy(), total, seed, trees, sample)
        tree, at, members = drawn
        columns = [whole["station_id"].take(at), pa.array(tree, pa.int32()), *[whole[c].take(at) for c in identity], whole["point"].take(at)]
        return pa.table([*columns, pa.array(members, pa.int64())], ["station_id", "tree", *identity, "point", "members"])

    names = ", ".join(f"`{c}` {types[c]}" for c in identity)
    return spread(needed, "station_id").groupBy("station_id").applyInArrow(
        run, f"station_id {types['station_id']}, tree int, {names}, point {types['point']}, members bigint")


def _joined(*parts) -> pa.Array:
    """The parts of a name, arrays of whole numbers or texts for all, with colons between them."""
    texts = [p if isinstance(p, str) else pc.cast(pa.array(p), pa.string()) for p in parts]
    return pc.binary_join_element_wise(*texts, ":")


def digests(texts: pa.Array, *suffixes: str) -> np.ndarray:
    """md5 of many short texts with each suffix: by suffix, then by text, 16 bytes a row. The 64 steps are done for many rows at once."""
    n, ends = len(texts), [x.encode() for x in suffixes]
    if not n:
        return np.zeros((0, 16), dtype=np.uint8)
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    size = np.diff(places)
    if size.max() + max(map(len, ends)) > _ONE_BLOCK:
        return np.array([list(md5(t.encode() + end, usedforsecurity=False).digest()) for end in ends for t in texts.to_pylist()], dtype=np.uint8)
    one, block, rows = np.zeros(n * 64, dtype=np.uint8), np.empty((len(ends), n, 64), dtype=np.uint8), np.arange(n)
    one[np.arange(places[-1] - places[0]) + np.repeat(rows * 64 - places[:-1] + places[0], size)] = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]]
    block[:] = one.reshape(n, 64)
    for g, end in enumerate(ends):
        for i, byte in enumerate(end + b"\x80"):
            block[g, rows, size + i] = byte
    bits = np.concatenate([(size + len(end)) * 8 for end in ends]).astype(np.uint32)
    used = (int(size.max()) + max(map(len, ends))) // 4 + 1
    words = block.reshape(-1, 64).view("<u4")
    out = [_md5(np.ascontiguousarray(words[i : i + _LANES, :used].T), bits[i : i + _LANES]) for i in range(0, len(words), _LANES)]
    return np.concatenate(out).astype("<u4", copy=False).view(np.uint8)


def _md5(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The four words of the digests of one block each, of which the first ``words`` and the count of ``bits`` aren't 0."""
    used, n = words.shape
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _STARTS)
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            k = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            k = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            k = (7 * i) % 16
        f += a
        f += np.uint32(_SINES[i])
        if k < used:
            f += words[k]
        elif k == 14:
            f += bits
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=high)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + np.uint32(start) for x, start in zip((a, b, c, d), _STARTS)], axis=1)


def _drawn(station, identity: list[np.ndarray], counts: np.ndarray, total: int, seed: int, trees: int, sample: int):
    """Tree, combination and how many of its rows are drawn, for a station's combinations in the order of their ``identity``."""
    limit = math.floor(min(1.0, _MARGIN * sample / total) * 2.0**32)
    hashes = -(-trees // _PER_HASH)
    ends = np.cumsum(counts)
    found = []  # places by row: its combination, then its copy
    for at in range(0, int(ends[-1]), _ROWS):
        place = np.arange(at, min(at + _ROWS, int(ends[-1])))
        owner = np.searchsorted(ends, place, side="right")
        names = _joined(f"{seed}:{station}", *[c[owner] for c in identity], place - (ends[owner] - counts[owner]) + 1)
        words = digests(names, *[f":{g}" for g in range(hashes)]).view(">u4").astype(np.uint32).reshape(hashes, len(place), _PER_HASH)
        g, row, i = np.nonzero(words < limit)
        found.append((g * _PER_HASH + i, words[g, row, i], place[row], owner[row]))
    tree, key, place, combination = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((place, key, tree))
    order = order[tree[order] < trees]  # the last digest may serve fewer trees
    tree, combination = tree[order], combination[order]
    first = np.flatnonzero(np.diff(tree, prepend=-1))
    rank = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
    both, members = np.unique(tree[rank < sample].astype(np.int64) * len(counts) + combination[rank < sample], return_counts=True)
    return both // len(counts), both % len(counts), members


def grow(drawn: DataFrame, sizes: DataFrame, axes: int, seed: int, sample: int = SAMPLE) -> DataFrame:
    """Nodes of all trees: ``station_id``, ``place`` (tree after tree, heap order), ``feature`` (-1 on a leaf), ``cut``, ``path``.

    ``sizes`` has ``station_id`` and the ``size`` of its samples. A station's trees grow together, a level at a time.
    """
    rows = drawn.join(sizes, "station_id").select(
        "station_id", "tree", "point", "members", tree_depth(F.col("size")).alias("depth"), tree_nodes(F.col("size")).alias("nodes"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        points = table["point"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)[:, :axes]
        station, depth, nodes = (table[c][0].as_py() for c in ("station_id", "depth", "nodes"))
        columns = _grown(station, table["tree"].to_numpy(), points, table["members"].to_numpy(), depth, nodes, seed)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int64())
        ids = pa.array([station] * len(columns[0]), table.schema.field("station_id").type)
        return pa.table([ids, *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["station_id", "place", "feature", "cut", "level", "n"])

    kind = dict(rows.dtypes)["station_id"]
    made = spread(rows, "station_id").groupBy("station_id").applyInArrow(run, f"station_id {kind}, place int, feature int, cut double, level int, n bigint")
    path = F.when(F.col("feature") < 0, F.col("level").cast("double") + usual_path(F.col("n"))).otherwise(0.0)
    return made.select("station_id", "place", "feature", "cut", path.alias("path"))


def _grouped(key: np.ndarray) -> np.ndarray:
    """A stable order by ``key``, from 0; few keys are sorted by their digits."""
    return np.argsort(key.astype(np.uint16) if len(key) and key.max() < 2**16 else key, kind="stable")


def _grown(station, tree: np.ndarray, points: np.ndarray, members: np.ndarray, depth: int, nodes: int, seed: int):
    """Place, axis (-1 on a leaf), cut, level and members of all nodes of a station's trees."""
    tree, key, out = tree.astype(np.int64), tree.astype(np.int64), []
    node, axes = np.zeros(len(tree), dtype=np.int64), points.shape[1]
    for level in range(depth + 1):
        order = _grouped(key)
        tree, node, points, members = tree[order], node[order], points[order], members[order]
        place = tree * nodes + node
        first = np.flatnonzero(np.diff(place, prepend=-1))
        if not len(first):
            break
        low, high = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
        feature, cut = np.full(len(first), -1), np.zeros(len(first))
        inner = np.flatnonzero((high > low).any(axis=1)) if level < depth else np.zeros(0, dtype=np.int64)
        if len(inner):
            names = _joined(f"{seed}:{station}", tree[first[inner]], node[first[inner]])
            digits = np.full((len(inner), max(axes, 8)), -1, dtype=np.int64)
            own, share = digests(names, "", ":cut").reshape(2, len(inner), 16)
            digits[:, :8] = own.view(">u2")
            d = np.where(high[inner] > low[inner], digits[:, :axes], -2).argmax(axis=1)
            share = share.view(">u4")[:, 0] / 2.0**32
            least, most = low[inner, d], high[inner, d]
            raw = least + share * (most - least)
            feature[inner], cut[inner] = d, np.where(raw >= most, least, raw)
        out.append((place[first], feature, cut, np.full(len(first), level), np.add.reduceat(members, first)))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(place))))
        right = points[np.arange(len(points)), np.maximum(feature[of], 0)] > cut[of]
        node, key = 2 * node + 1 + right, 2 * of + right
        on = feature[of] >= 0
        tree, node, points, members, key = tree[on], node[on], points[on], members[on], key[on]
    return [np.concatenate(c) for c in zip(*out)]


def rounded_half_up(x: np.ndarray, places: int = 9) -> np.ndarray:
    """As Spark's ``round``, which takes the shortest decimal that names the value."""
    scaled = x * 10.0**places
    out = np.rint(scaled) / 10.0**places
    for i in zip(*np.nonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-4)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))
    return out


def _placed(values: np.ndarray, mean: np.ndarray, scale: np.ndarray, components: np.ndarray) -> np.ndarray:
    """Coordinates of rows of features, added up in the order that ``coordinates`` does it."""
    z = (values - mean) / scale
    out = np.zeros((len(values), len(components)))
    for i in range(values.shape[1]):
        out += z[:, i : i + 1] * components[:, i]
    return rounded_half_up(out)


def _walked(points: np.ndarray, feature: np.ndarray, cut: np.ndarray, billionths: np.ndarray, nodes: int, depth: int) -> np.ndarray:
    """Sum over the trees of the path lengths of every point. All points go down to the lowest level: below a leaf to the left."""
    n, trees = len(points), len(feature) // nodes
    axis, border, lengths = feature.reshape(trees, nodes).astype(np.int64), cut.reshape(trees, nodes).copy(), billionths.reshape(trees, nodes).copy()
    for level in range(depth):
        at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        leaf = axis[:, at] < 0
        axis[:, at] = np.where(leaf, 0, axis[:, at] * n)
        border[:, at] = np.where(leaf, np.inf, border[:, at])
        below = 2 * at + 1
        axis[:, below] = np.where(leaf, -1, axis[:, below])
        lengths[:, below] = np.where(leaf, lengths[:, at], lengths[:, below])
    flat, row, total = np.ascontiguousarray(points.T).ravel(), np.arange(n), np.zeros(n, dtype=np.int64)
    at, place, value, right = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n), np.empty(n, dtype=bool)
    for tree in range(trees):
        at[:] = 0
        for _ in range(depth):
            axis[tree].take(at, out=place, mode="clip")
            place += row
            flat.take(place, out=value, mode="clip")
            np.greater(value, border[tree].take(at, mode="clip"), out=right)
            at <<= 1
            at += 1
            at += right
        total += lengths[tree].take(at, mode="clip")
    return total


def fit(combos: DataFrame, setup: DataFrame, identity: list[str], features, seed: int, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Every row of ``setup`` with ``split_feature``, ``split_at`` and ``path_length`` of its station's trees, and ``threshold``.

    ``combos`` holds ``station_id``, the columns of ``identity`` and ``rows``; ``setup`` one row per station with ``total``, ``size``,
    ``contamination``, ``reason``, ``mean``, ``scale`` and ``components``. ``features`` makes rows of features from the columns of
    ``identity``. The threshold is the quantile ``contamination`` of the scores of all rows, null where there is a ``reason``.
    Logarithms and powers are Spark's, so both ways give the same numbers.
    """
    place = F.when(F.col("reason").isNull(), F.round((F.col("total") - 1) * F.col("contamination"), 6))
    held = setup.withColumns({"_depth": tree_depth(F.col("size")), "_nodes": tree_nodes(F.col("size")), "_place": place})
    held = held.withColumns({"_floor": F.floor("_place"), "_ceil": F.ceil("_place")})
    usual = np.array([r[0] for r in combos.sparkSession.range(sample + 1).select("id", usual_path(F.col("id")).alias("path")).orderBy("id").select("path").collect()])
    made = {"split_feature": pa.list_(pa.int32()), "split_at": pa.list_(pa.float64()), "path_length": pa.list_(pa.float64()), "_below": pa.int64(), "_above": pa.int64()}

    def run(table: pa.Table, setups: pa.Table) -> pa.Table:
        if not table.num_rows or not setups.num_rows:
            return pa.table([*setups.slice(0, 0).columns, *[pa.array([], k) for k in made.values()]], [*setups.schema.names, *made])
        one = setups.to_pylist()[0]
        station, total, size, depth, nodes = (one[c] for c in ("station_id", "total", "size", "_depth", "_nodes"))
        columns = [table[c].to_numpy() for c in identity]
        order = np.lexsort(columns[::-1])
        columns, counts = [c[order] for c in columns], table["rows"].to_numpy()[order]
        components = np.array(one["components"]).reshape(-1, len(one["mean"]))
        points = _placed(features(columns), np.array(one["mean"]), np.array(one["scale"]), components)
        tree, at, members = _drawn(station, columns, counts, total, seed, trees, sample)
        grown, kind, border, level, n = _grown(station, tree, points[at], members, depth, nodes, seed)
        feature, cut, path = np.full(trees * nodes, -1, dtype=np.int32), np.zeros(trees * nodes), np.zeros(trees * nodes)
        feature[grown], cut[grown], path[grown] = kind, border, np.where(kind < 0, level + usual[n], 0.0)
        below = above = None
        if one["_place"] is not None:
            totals = _walked(points, feature, cut, np.rint(path * 1e9).astype(np.int64), nodes, depth)
            order = np.argsort(totals)
            upto = np.cumsum(counts[order])
            below, above = (int(totals[order[np.searchsorted(upto, one[c], side="right")]]) for c in ("_floor", "_ceil"))
        arrays = [pa.array([x], k) for x, k in zip((feature, cut, path, below, above), made.values())]
        return pa.table([*setups.columns, *arrays], [*setups.schema.names, *made])

    schema = ", ".join([f"`{c}` {k}" for c, k in held.dtypes] + ["split_feature array<int>", "split_at array<double>", "path_length array<double>", "_below bigint", "_above bigint"])
    both = spread(combos.select("station_id", *identity, "rows"), "station_id").groupBy("station_id")
    fitted = both.cogroup(spread(held, "station_id").groupBy("station_id")).applyInArrow(run, schema)
    low, high = (F.expr(score_of_sum(c, "size", str(trees))) for c in ("_below", "_above"))
    threshold = low + (high - low) * (F.col("_place") - F.col("_floor"))
    return fitted.select(*setup.columns, "split_feature", "split_at", "path_length", threshold.alias("threshold"))


def as_arrays(nodes: DataFrame, sizes: DataFrame, trees: int = TREES) -> DataFrame:
    """Per station ``split_feature``, ``split_at`` and ``path_length`` by place; places that no tree has are leaves of length 0."""
    places = F.explode(F.sequence(F.lit(0), F.lit(trees) * tree_nodes(F.col("size")) - 1)).alias("place")
    whole = sizes.select("station_id", places).join(nodes, ["station_id", "place"], "left")
    cell = F.struct("place", F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("cut", F.lit(0.0)).alias("cut"), F.coalesce("path", F.lit(0.0)).alias("path"))
    listed = whole.groupBy("station_id").agg(F.sort_array(F.collect_list(cell)).alias("_n"))
    return listed.select(
        "station_id", F.col("_n.feature").alias("split_feature"), F.col("_n.cut").alias("split_at"), F.col("_n.path").alias("path_length")
    )


def score_of_sum(total: str, size: str, trees: str) -> str:
    """Score in (-1, 0) of a point whose path lengths in all trees add up to ``total`` billionths."""
    many = f"double(greatest({size}, 3))"
    usual = f"if({size} > 2, round(2 * (ln({many} - 1) + 0.5772156649015329D) - 2 * ({many} - 1) / {many}, 9), if({size} = 2, 1D, 0D))"
    mean = f"{total} / 1e9D / double({trees})"
    return f"transform(array({usual}), u -> if(u > 0, -pow(2D, -({mean}) / u), -1D))[0]"


def score_sql(point: str, size: str = "sample_rows", paths: str = "_billionths") -> str:
    """Score in (-1, 0) of a point by a model row's arrays: the shorter the mean path, the closer to -1.

    ``paths`` names the path lengths in whole billionths, whose sum doesn't depend on the order.
    """
    depth = f"int(ceil(log2(greatest({size}, 2))))"
    inner = "if(split_feature[at] >= 0, 2 * at - t * nodes + 1 + int(p[split_feature[at]] > split_at[at]), at)"
    walked = f"aggregate(sequence(1, {depth}), int(t * nodes), (at, i) -> int({inner}))"
    total = f"aggregate(sequence(0, size(split_feature) div nodes - 1), 0L, (sum, t) -> sum + {paths}[{walked}])"
    score = score_of_sum(total, size, "size(split_feature) div nodes")
    nodes = f"int(pow(2D, {depth} + 1) - 1)"
    return f"transform(array({nodes}), nodes -> transform(array({point}), p -> {score})[0])[0]"


def counted_percentile(scored: DataFrame, value: str, share: str, key: str = "station_id") -> DataFrame:
    """Linearly interpolated quantile ``share`` of ``value`` per key, each value occurring ``rows`` times: ``threshold``."""
    running = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    counted = scored.groupBy(key, value, share).agg(F.sum("rows").alias("rows"))
    counted = counted.withColumns({"_upto": F.sum("rows").over(running), "_place": F.round((F.sum("rows").over(whole) - 1) * F.col(share), 6)})
    below = F.min(F.when(F.col("_upto") > F.floor("_place"), F.col(value)))
    above = F.min(F.when(F.col("_upto") > F.ceil("_place"), F.col(value)))
    part = F.any_value(F.col("_place") - F.floor("_place"))
    return counted.groupBy(key).agg((below + (above - below) * part).alias("threshold"))
