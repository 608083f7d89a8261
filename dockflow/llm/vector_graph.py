"""Near-duplicate vectors by a robust-pruned graph over overlapping shards.

Equal vectors are one class. Classes are dealt to shards: k-means centroids are fitted on a bounded sample, and a
class goes to its nearest centroid and to others that are nearer than its nearest plus the angle of the threshold, at most
``overlap`` of them. Shards that come out too large are divided by centroids of their own, from a bounded sample of
each; what still is too large, as a ball of vectors that no centroid can part, is cut into blocks, and each pair of
blocks is a shard. So no task holds more than twice ``cap`` vectors, and no class is left out.

In each shard every node's neighbours are chosen by robust pruning (nearest first; a candidate goes if a chosen one is
nearer to it by the factor ``alpha``), and links hold both ways. The adjacency lists of a node from all its shards are united.
Then each shard is searched for each of its own nodes: a greedy beam from the shard's medoid and from the node itself, and
from what is in range on along the graph until nothing new is. Every pair found is verified in double precision.

A class near more centroids than ``overlap`` is not dealt to the rest of them. Of two classes within the angle, the one
farther from its nearest centroid is within the margin of the other's nearest, so pairs without a common shard are only
among the classes of two groups of centroids where one has such a rest in the other (or within one divided shard). These
groups are cut into blocks of ``BLOCK`` and compared block by block, all with all: isolated vectors that are near many
centroids cost as much as a comparison of all pairs.

A pair that meets in several shards is counted in the first that both are in, and by blocks only if no shard has both.
Shards and blocks hand back a number of links and the smallest node reached per node, not pairs. The result is audited: for a bounded sample of classes, as many of each order of magnitude of
links found, the links to other classes are counted by brute force over all rows. If the mean share found per class is under
``recall``, all is done again with wider settings, and after the last try all pairs are compared in blocks.

Null, empty or zero vectors, and those with null or non-finite components, link with nothing; nor do vectors of different
dimension. Every input row gives one row, repeated ids and vectors included; ``component_id`` is the smallest id that
isn't null. Other columns are left aside, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.llm.graphs import connected_components
from dockflow.session import settle

#: Vectors per shard that centroids aim at, and the most that a shard or a block may hold.
TARGET, CAP = 800, 2_000
SAMPLE = 8_192
MAX_CENTROIDS, MAX_PARTS, PART_SAMPLE = 512, 32, 1_024
OVERLAP, DEGREE, BEAM, ALPHA = 2, 24, 12, 1.2
AUDITED = 128
QUERIES = 256
#: Links followed, and pairs measured, at once in a search; rows whose distances to centroids are held at once.
LINKS, MEASURED, PLACED_ROWS = 1 << 18, 1 << 13, 1_024
#: Centroids whose classes are compared in blocks together (divides ``MAX_CENTROIDS``), and the most classes of a block.
GROUP, BLOCK = 16, 8_000
#: Angles are rounded; so much is added to the margin.
SLACK = 1e-6
_PLACED = "c bigint, copies bigint, vector array<double>, shards array<bigint>, met array<bigint>, groups array<bigint>, visits array<bigint>"


def unit_rows(vectors: list, dtype=np.float64) -> np.ndarray:
    out = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    scale = np.abs(out).max(axis=1, keepdims=True)  # very large and very small components don't overflow
    out = out / scale
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(dtype)


def fit_centroids(points: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centroids = points[np.sort(rng.choice(len(points), k, replace=False))]
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    return centroids


def near_centroids(points: np.ndarray, centroids: np.ndarray, margin: float) -> list[np.ndarray]:
    """Per point its nearest centroid and all those within the margin of it, nearest first."""
    out = []
    for begin in range(0, len(points), PLACED_ROWS):
        angles = np.arccos(np.clip(points[begin : begin + PLACED_ROWS] @ centroids.T, -1, 1))
        order = np.argsort(angles, axis=1, kind="stable")
        within = (angles <= angles.min(axis=1, keepdims=True) + margin + SLACK).sum(axis=1)
        out += [o[:n].copy() for o, n in zip(order, within)]
    return out


def robust_prune(points: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Neighbours of every node, from all others."""
    distance = points @ points.T
    distance *= -2
    distance += 2
    np.sqrt(np.maximum(distance, 0, out=distance), out=distance)
    np.fill_diagonal(distance, np.inf)
    out = []
    for i in range(len(points)):
        left, chosen = distance[i].copy(), []
        while len(chosen) < degree:
            j = int(left.argmin())
            if left[j] == np.inf:
                break
            chosen.append(j)
            left[alpha * distance[j] <= distance[i]] = np.inf
            left[j] = np.inf
        out.append(np.array(chosen, dtype=np.int64))
    return out


def similarities(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows ``a`` of ``left`` and ``b`` of ``right``, pair by pair; few rows are gathered at once."""
    out = np.empty(len(a), dtype=left.dtype)
    for i in range(0, len(a), MEASURED):
        s = slice(i, i + MEASURED)
        out[s] = np.einsum("ij,ij->i", left[a[s]], right[b[s]])
    return out


def range_search(
    points: np.ndarray, links: tuple[np.ndarray, np.ndarray], starts: np.ndarray, queries: np.ndarray, threshold: float, beam: int,
    slack: float = 0.02,
):
    """Pairs (query, node) with a similarity of ``threshold`` or more, found along the graph.

    ``links`` holds all nodes' neighbours, node by node, and where each node's begin and the last's end. Queries are nodes; each
    begins at ``starts`` and at itself. About
    ``LINKS`` links are followed at once, besides those of a single node or of a query's next step, so that neither many links of a
    node nor many nodes in range make large tables.
    """
    q, n = len(queries), len(points)
    to, ends = links
    degree = np.diff(ends)
    seen = np.zeros(q * n, dtype=bool)
    rows = np.arange(q)[:, None]

    def look(who, nodes):
        return similarities(points, queries[who], points, nodes)

    def unseen(who, nodes):
        """Neighbours of the nodes that their query has not seen, once each; they are seen now."""
        many = degree[nodes]
        total = int(many.sum())
        place = np.arange(total) + np.repeat(ends[nodes] - np.cumsum(many) + many, many)
        flat = np.repeat(who * n, many) + to[place]
        flat = np.unique(flat[~seen[flat]])
        seen[flat] = True
        return flat // n, flat % n

    first = np.concatenate([np.broadcast_to(starts, (q, len(starts))), queries[:, None]], axis=1)
    width = max(beam, first.shape[1])
    ids = np.full((q, width), -1)
    near = np.full((q, width), -np.inf, dtype=np.float32)
    ids[:, : first.shape[1]] = first
    near[:, : first.shape[1]] = look(np.repeat(np.arange(q), first.shape[1]), first.ravel()).reshape(first.shape)
    done = np.zeros((q, width), dtype=bool)
    seen[(rows * n + first).ravel()] = True
    hits = [(np.repeat(np.arange(q), first.shape[1])[near[:, : first.shape[1]].ravel() >= threshold], first.ravel()[near[:, : first.shape[1]].ravel() >= threshold])]
    while True:
        open_ = np.where(done | (ids < 0), -np.inf, near)
        pick = open_.argmax(axis=1)
        active = np.flatnonzero(open_[np.arange(q), pick] > -np.inf)
        if not len(active):
            break
        done[active, pick[active]] = True
        who, nodes = unseen(active, ids[active, pick[active]])
        if not len(who):
            continue
        value = look(who, nodes)
        good = value >= threshold
        hits.append((who[good], nodes[good]))
        # the beam keeps the nearest
        place = np.arange(len(who)) - np.searchsorted(who, who)
        wide_ids = np.full((q, place.max() + 1), -1)
        wide = np.full(wide_ids.shape, -np.inf, dtype=np.float32)
        wide_ids[who, place], wide[who, place] = nodes, value
        all_ids, all_near = np.concatenate([ids, wide_ids], axis=1), np.concatenate([near, wide], axis=1)
        all_done = np.concatenate([done, np.zeros(wide_ids.shape, dtype=bool)], axis=1)
        keep = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        ids, near, done = (np.take_along_axis(x, keep, axis=1) for x in (all_ids, all_near, all_done))
    who, nodes = (np.concatenate(x) for x in zip(*hits))
    found_who, found_nodes = [who], [nodes]
    while len(who):  # on from what is in range, over nodes just outside it too
        upto = np.cumsum(degree[nodes])
        cuts = np.flatnonzero(np.diff(upto // LINKS, prepend=0))
        next_who, next_nodes = [], []
        for begin, end in zip([0, *cuts], [*cuts, len(who)]):
            some, fresh = unseen(who[begin:end], nodes[begin:end])
            value = look(some, fresh)
            good = value >= threshold
            found_who.append(some[good])
            found_nodes.append(fresh[good])
            near_by = value >= threshold - slack
            next_who.append(some[near_by])
            next_nodes.append(fresh[near_by])
        who, nodes = np.concatenate(next_who), np.concatenate(next_nodes)
    return np.concatenate(found_who), np.concatenate(found_nodes)


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each node reaches over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def vector_classes(df: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their usable vector (or null), and the classes of equal ones."""
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_column).alias("id"), F.when(usable, vector).alias("vector"))
    classes = rows.where("vector IS NOT NULL").groupBy("vector").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    # written at once, so the numbers stay
    return rows, settle(classes.withColumn("c", F.monotonically_increasing_id()))


def _assigned(classes: DataFrame, centroids: dict, margin: float, overlap: int) -> DataFrame:
    """The classes with their ``shards``; centroids by dimension.

    ``met`` stays as the shards are now, ``groups`` is the group of the nearest centroid, and ``visits`` are the groups of
    the centroids within the margin beyond ``overlap``.
    """
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            shards, groups, visits = ([None] * len(vectors) for _ in range(3))
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                near = near_centroids(unit_rows([vectors[i] for i in which]), shared.value[int(dim)], margin)
                for i, found in zip(which, near):
                    found = found + int(dim) * MAX_CENTROIDS
                    shards[i], groups[i] = found[:overlap].tolist(), [int(found[0]) // GROUP]
                    visits[i] = np.unique(found[overlap:] // GROUP).tolist()
            dealt = [pa.array(x, pa.list_(pa.int64())) for x in (shards, shards, groups, visits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *dealt], [*batch.schema.names, "shards", "met", "groups", "visits"])

    return classes.select("c", "copies", "vector").mapInArrow(run, _PLACED)


def _divided(placed: DataFrame, large: list[int], margin: float, overlap: int, cap: int) -> DataFrame:
    """Deal the members of the large shards to parts of these, by centroids from a bounded sample of each.

    Such a shard is a group of its own, below 0, which those members visit that more than ``overlap`` parts are near to.
    """
    member = placed.select("c", "vector", F.explode("shards").alias("shard")).where(F.col("shard").isin(large))
    order = Window.partitionBy("shard").orderBy("h", "c")
    near = member.withColumn("h", F.xxhash64("c"))
    sizes = near.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    near = near.join(sizes, "shard").where(
        F.shiftrightunsigned("h", 11) / 2.0**53 * F.col("n") <= 2 * PART_SAMPLE
    )
    sample = near.withColumn("i", F.row_number().over(order)).where(F.col("i") <= PART_SAMPLE)

    def fit(key, table):
        points = unit_rows(table.column("vector").to_pylist())
        centroids = fit_centroids(points, min(MAX_PARTS, max(2, table.column("n")[0].as_py() // (cap // 2))))
        return pa.table({"shard": pa.array([key[0].as_py()]), "centroids": pa.array([centroids.ravel().tolist()], pa.list_(pa.float64()))})

    fitted = sample.select("shard", "vector", "n").groupBy("shard").applyInArrow(fit, "shard bigint, centroids array<double>")
    parts = {r["shard"]: np.array(r["centroids"]) for r in fitted.collect()}
    shared = placed.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            out, groups, visits = [], batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for i, (vector, shards) in enumerate(zip(vectors, batch.column(3).to_pylist())):
                dealt = []
                for s in shards:
                    if s in shared.value:
                        point = unit_rows([vector])
                        found = near_centroids(point, shared.value[s].reshape(-1, len(vector)), margin)[0]
                        dealt += [(s + 1) * 10**6 + int(f) for f in found[:overlap]]
                        groups[i].append(-s - 1)
                        visits[i] += [-s - 1] * (len(found) > overlap)
                    else:
                        dealt.append(s)
                out.append(dealt)
            out, groups, visits = (pa.array(x, pa.list_(pa.int64())) for x in (out, groups, visits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], out, batch.column(4), groups, visits], batch.schema.names)

    return placed.mapInArrow(run, _PLACED)


def _tasks(placed: DataFrame, cap: int) -> DataFrame:
    """One row per class and task: ``shard``, ``x`` and ``y`` (the task's two blocks), ``block`` and the class."""
    member = placed.select("c", "copies", "vector", "shards", F.explode("shards").alias("shard"))
    sizes = member.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / cap).alias("blocks"))
    member = member.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    return member.select("shard", "block", "c", "copies", "vector", "shards", other).select(
        "shard", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "c", "copies", "vector", "shards"
    )


def _build(degree: int, alpha: float):
    def build(key, table):
        c = table.column("c").to_numpy()
        lists = robust_prune(unit_rows(table.column("vector").to_pylist(), np.float32), degree, alpha)
        both = [set(x.tolist()) for x in lists]
        for i, x in enumerate(lists):  # links hold both ways
            for j in x:
                both[j].add(i)
        return pa.table({"c": pa.array(c), "near": pa.array([c[sorted(x)].tolist() for x in both], pa.list_(pa.int64()))})

    return build


def _search(threshold: float, beam: int):
    def search(key, table):
        shard, x, y = (k.as_py() for k in key)
        c = table.column("c").to_numpy()
        order = np.argsort(c)
        table, c = table.take(pa.array(order)), c[order]
        n = len(c)
        exact = unit_rows(table.column("vector").to_pylist())
        points = exact.astype(np.float32)
        copies, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
        near = table.column("near").combine_chunks()
        flat, owner = near.flatten().to_numpy(), np.repeat(np.arange(n), near.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(c, flat), n - 1)
        here = c[at] == flat
        graph = at[here], np.concatenate([[0], np.cumsum(np.bincount(owner[here], minlength=n))])
        mean = points.mean(axis=0)
        medoids = np.unique([np.flatnonzero(block == b)[(points[block == b] @ mean).argmax()] for b in np.unique(block)])
        homes = table.column("shards").to_pylist()
        width = max(len(h) for h in homes)
        home = np.array([h + [-1] * (width - len(h)) for h in homes])
        links, label = np.zeros(n, dtype=np.int64), np.arange(n)
        for begin in range(0, n, QUERIES):
            queries = np.arange(begin, min(begin + QUERIES, n))
            who, node = range_search(points, graph, medoids, queries, threshold - 1e-4, beam)
            who = queries[who]
            sure = (who != node) & (similarities(exact, who, exact, node) >= threshold)
            who, node = who[sure], node[sure]
            if len(who):  # pairs of earlier queries are kept as labels only
                label = smallest_reached(n, np.concatenate([who, np.arange(n)]), np.concatenate([node, label]))
            # counted where both meet first
            mine = (block[who] != block[node]) if x != y else np.ones(len(who), dtype=bool)
            for i in range(home.shape[1]):
                for j in range(home.shape[1]):
                    both = home[who, i] == home[node, j]
                    mine &= ~(both & (home[who, i] >= 0) & (home[who, i] < shard))
            np.add.at(links, who[mine], copies[node[mine]])
        return pa.table({"c": pa.array(c), "links": pa.array(links), "reached": pa.array(c[label])})

    return search


def _padded(lists: list, fill: int) -> np.ndarray:
    width = max((len(x) for x in lists), default=0)
    return np.array([[*x, *[fill] * (width - len(x))] for x in lists], dtype=np.int64).reshape(len(lists), width)


def _compare(threshold: float):
    """All pairs of a task's two blocks, or of its only one, that have no shard in common."""

    def compare(key, table):
        low, x, high, y = (k.as_py() for k in key)
        n, c = table.num_rows, table.column("c").to_numpy()
        exact = unit_rows(table.column("vector").combine_chunks().flatten().to_numpy().reshape(n, -1))
        points, copies = exact.astype(np.float32), table.column("copies").to_numpy()
        first = table.column("first").to_numpy()
        left = np.flatnonzero(first)
        right = left if (low, x) == (high, y) else np.flatnonzero(~first)
        # -1 and -2 stand for nothing and are never equal
        mine, theirs = ({k: _padded(table.column(k).to_pylist(), fill) for k in ("shards", "met")} for fill in (-1, -2))
        links, label = np.zeros(n, dtype=np.int64), np.arange(n)
        for begin in range(0, len(left), QUERIES):
            rows = left[begin : begin + QUERIES]
            a, b = np.nonzero(points[rows] @ points[right].T >= threshold - 1e-4)
            a, b = rows[a], right[b]
            if right is left:
                a, b = a[a < b], b[a < b]
            apart = np.ones(len(a), dtype=bool)
            least = np.full(len(a), np.iinfo(np.int64).max)
            for i in range(mine["shards"].shape[1]):
                for j in range(theirs["shards"].shape[1]):
                    apart &= mine["shards"][a, i] != theirs["shards"][b, j]
            for i in range(mine["met"].shape[1]):
                for j in range(theirs["met"].shape[1]):
                    both = mine["met"][a, i] == theirs["met"][b, j]
                    least[both] = np.minimum(least[both], mine["met"][a[both], i])
            # those that met before a division are counted in the first shard divided
            apart &= least == (-low - 1 if low < 0 else np.iinfo(np.int64).max)
            a, b = a[apart], b[apart]
            sure = similarities(exact, a, exact, b) >= threshold
            a, b = a[sure], b[sure]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            if len(a):
                label = smallest_reached(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, label]))
        some = np.flatnonzero(links)
        return pa.table({"c": pa.array(c[some]), "links": pa.array(links[some]), "reached": pa.array(c[label[some]])})

    return compare


def _by_blocks(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """``c``, ``links`` and ``reached`` from the pairs without a common shard, as far as there are any.

    Two groups are compared where a class of one visits the other.
    """
    visit = placed.select(F.element_at("groups", 1).alias("home"), F.explode("visits").alias("other"))
    home = F.when(F.col("other") < 0, F.col("other")).otherwise(F.col("home"))
    pairs = visit.select(F.least(home, "other").alias("low"), F.greatest(home, "other").alias("high")).distinct()
    member = placed.select("c", "copies", "vector", "shards", "met", F.explode("groups").alias("group"))
    blocks = settle(member.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    numbered = blocks.select("group", numbers.alias("block"))
    tasks = pairs.join(numbered.select(F.col("group").alias("low"), F.col("block").alias("x")), "low")
    tasks = tasks.join(numbered.select(F.col("group").alias("high"), F.col("block").alias("y")), "high")
    tasks = settle(tasks.where("low < high OR x <= y").select("low", "x", "high", "y"))
    ends = tasks.select(F.col("low").alias("group"), F.col("x").alias("block"), "*", F.lit(True).alias("first")).unionByName(
        tasks.where("low < high OR x < y").select(F.col("high").alias("group"), F.col("y").alias("block"), "*", F.lit(False).alias("first"))
    )
    member = member.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    dealt = member.join(ends, ["group", "block"]).select("low", "x", "high", "y", "first", "c", "copies", "vector", "shards", "met")
    return dealt.groupBy("low", "x", "high", "y").applyInArrow(_compare(threshold), "c bigint, links bigint, reached bigint")


def _audit(found: DataFrame, classes: DataFrame, threshold: float, audited: int) -> float:
    """Mean share of the links to other classes that were found, over a sample of classes that have any.

    The links are counted by brute force over all classes. The sample takes as many classes of each stratum by links found
    (none, 1, 2 to 3, 4 to 7 and so on) as there are, so a large ball doesn't stand for the isolated pairs.
    """
    own = F.col("n_links") - F.col("copies") + 1
    counted = found.join(classes.select("c", "copies"), "c").select("c", own.alias("got"))
    counted = counted.withColumn("stratum", F.ceil(F.log2(F.col("got") + 1)).cast("int")).withColumn("h", F.xxhash64("c"))
    sizes = {r["stratum"]: r["count"] for r in counted.groupBy("stratum").count().collect()}
    if not sizes:
        return 1.0
    each = -(-audited // len(sizes))
    # four times what is wanted passes a threshold on the hash, so that no stratum has to be sorted
    share = F.create_map(*[F.lit(x) for stratum, n in sizes.items() for x in (stratum, min(1.0, 4 * each / n))])
    near = counted.where(F.shiftrightunsigned("h", 11) / 2.0**53 <= share[F.col("stratum")])
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "c"))).where(F.col("k") <= each)
    sample = ranked.join(classes, "c").select("c", "copies", "vector", "got").collect()
    if not sample:
        return 1.0
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vector"]), []).append(r)
    queries = classes.sparkSession.sparkContext.broadcast(
        {d: (np.array([r["c"] for r in rs]), unit_rows([r["vector"] for r in rs])) for d, rs in by_dim.items()}
    )

    def count(batches):
        for batch in batches:
            total: dict[int, int] = {}
            vectors, copies = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            sizes = np.array([len(v) for v in vectors])
            for dim, (c, points) in queries.value.items():
                which = np.flatnonzero(sizes == dim)
                if len(which):
                    close = unit_rows([vectors[i] for i in which]) @ points.T >= threshold
                    for k, n in zip(c.tolist(), (close * copies[which][:, None]).sum(axis=0).tolist()):
                        total[k] = total.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["c", "n"])

    true = classes.select("copies", "vector").mapInArrow(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    true = {r["c"]: r["n"] for r in true.collect()}
    others = [(r["got"], true[r["c"]] - r["copies"]) for r in sample]
    shares = [min(got, n) / n for got, n in others if n > 0]
    return sum(shares) / len(shares) if shares else 1.0


def _totals(classes: DataFrame, searched: DataFrame) -> DataFrame:
    summed = searched.groupBy("c").agg(F.sum("links").alias("links"))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return settle(classes.join(summed, "c", "left").select("c", "first_id", "vector", links.alias("n_links")))


def near_duplicate_vectors(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95,
    overlap: int = OVERLAP, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, target: int = TARGET, cap: int = CAP,
    recall: float = 0.97, audited: int = AUDITED, tries: int = 3, block: int = BLOCK,
) -> DataFrame:
    """``id_column``, ``n_links``, ``component_id``, ``kept`` and ``recall`` (as audited; 1 where all pairs were compared) of every row."""
    rows, classes = vector_classes(df, id_column, vector_column)
    margin = float(np.arccos(threshold))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    centroids = {}
    for dim, n in sizes.items():
        mine = classes.where(F.size("vector") == dim).select("vector", F.xxhash64("c").alias("h"))
        near = mine.where(F.shiftrightunsigned("h", 11) / 2.0**53 <= min(1.0, 2 * SAMPLE / n))
        sample = [r["vector"] for r in near.orderBy("h").limit(SAMPLE).collect()]
        centroids[dim] = fit_centroids(unit_rows(sample), min(MAX_CENTROIDS, -(-n * overlap // target)))
    for attempt in range(tries):
        placed = settle(_assigned(classes, centroids, margin, overlap))
        counts = placed.select(F.explode("shards").alias("shard")).groupBy("shard").count()
        large = [r["shard"] for r in counts.where(F.col("count") > cap).collect()]
        if large:
            placed = settle(_divided(placed, large, margin, overlap, cap))
        tasks = settle(_tasks(placed, cap))
        groups = ["shard", "x", "y"]
        lists = tasks.select(*groups, "c", "vector").groupBy(*groups).applyInArrow(_build(degree, alpha), "c bigint, near array<bigint>")
        united = lists.select("c", F.explode("near").alias("to")).groupBy("c").agg(F.collect_set("to").alias("near"))
        united = settle(united)
        joined = tasks.join(united, "c", "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))
        searched = joined.groupBy(*groups).applyInArrow(_search(threshold, beam), "c bigint, links bigint, reached bigint")
        searched = settle(searched.unionByName(_by_blocks(placed, threshold, block)))
        found = _totals(classes, searched)
        share = _audit(found, classes, threshold, audited)
        if share >= recall:
            break
        overlap, degree, beam = 2 * overlap, degree * 3 // 2, 2 * beam
    else:
        none, one = F.array().cast("array<bigint>"), F.array(F.size("vector").cast("bigint"))
        every = classes.select("c", "copies", "vector", none.alias("shards"), none.alias("met"), one.alias("groups"), one.alias("visits"))
        searched = settle(_by_blocks(every, threshold, block))
        found, share = _totals(classes, searched), 1.0
    labels = connected_components(searched.select(F.col("c").alias("a"), F.col("reached").alias("b")))
    named = found.join(labels.select(F.col("node").alias("c"), "component"), "c", "left")
    named = settle(named.withColumn("component", F.coalesce("component", "c")))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = named.join(least, "component").select("vector", "n_links", "component_id")
    out = rows.join(known, "vector", "left")
    component = F.when(F.col("vector").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.lit(share).alias("recall"),
    )
