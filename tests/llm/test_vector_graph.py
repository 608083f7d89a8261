"""Near-duplicate vectors against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dockflow.llm import vector_graph as vg
from tests.llm.test_shingle_join import components


def brute(rows, threshold=0.95):
    usable = [
        v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows
    ]
    unit = [vg.unit_rows([v])[0] if u else None for (_, v), u in zip(rows, usable)]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    of = components(range(len(rows)), [(i, j) for i in links for j in links[i]])
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[of[i]] = min(vec_id, least.get(of[i], vec_id))
    return sorted((str(r[0]), len(links[i]), str(least.get(of[i])), r[0] == least.get(of[i])) for i, r in enumerate(rows))


def got(df, **options):
    out = vg.near_duplicate_vectors(df, **options).collect()
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in out)


def sample(rng, n, dim=24):
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            vector = base + rng.normal(size=dim) * rng.choice([0, 0.01, 0.04, 0.07])
        else:
            vector = rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in vector]))
    return rows


@pytest.mark.parametrize("target,cap", [(60, 400), (40, 50), (10_000, 30)])
def test_links_and_components(spark, target, cap):
    rows = sample(np.random.default_rng(target), 400)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, n_links int, c int").repartition(3)
    assert got(df, target=target, cap=cap) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    rows += [(7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.3]), (11, [1.0, 0.34]), (12, [-1.0, 0.0])]
    rows += [(13, [1.0, 0.0, 0.0]), (14, [1.0, 0.0, 0.001]), (15, [1e30, 0.0]), (16, [1e-30, 0.0]), (None, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = [list(r) for r in brute(rows)]
    for r in want:  # rows without id are their own component's smallest only where all ids are null
        r[3] = r[0] == r[2]
    assert [list(r) for r in got(df)] == sorted(want)
    assert vg.near_duplicate_vectors(df.limit(0)).count() == 0


def test_dense_ball_and_recall(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    rows = [(i, [float(x) for x in centre + rng.normal(size=32) * 0.05]) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=32)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = vg.near_duplicate_vectors(df, target=100, cap=60).collect()
    want = {r[0]: r for r in brute(rows)}
    links = {str(r["vec_id"]): r["n_links"] for r in out}
    assert all(n <= want[i][1] for i, n in links.items())
    assert sum(links.values()) >= 0.97 * sum(r[1] for r in want.values())
    assert min(r["recall"] for r in out) >= 0.97


def test_pruning_keeps_the_nearest():
    points = vg.unit_rows(np.random.default_rng(0).normal(size=(80, 8)).tolist())
    near = np.argsort(-(points @ points.T), axis=1)[:, 1]
    for i, chosen in enumerate(vg.robust_prune(points, 6, 1.2)):
        assert chosen[0] == near[i] and len(set(chosen)) == len(chosen) <= 6 and i not in chosen


@pytest.mark.parametrize("target,cap,block", [(12, 400, 100), (150, 40, 70)])
def test_isolated_pairs_near_many_centroids(spark, target, cap, block):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        one, other = vg.unit_rows(rng.normal(size=(2, 64)))
        other -= (other @ one) * one
        near = 0.955 * one + np.sqrt(1 - 0.955**2) * other / np.linalg.norm(other)
        rows += [(2 * i, one.tolist()), (2 * i + 1, near.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = got(df, target=target, cap=cap, block=block, recall=0.0)
    assert out == brute(rows) and sum(r[1] for r in out) == 600


def ball_and_pairs(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * 0.03).tolist()) for i in range(200)]
    for i in range(150):
        one = rng.normal(size=32)
        rows += [(1000 + 2 * i, one.tolist()), (1001 + 2 * i, (one + rng.normal(size=32) * 0.1).tolist())]
    rows += [(2000 + i, rows[200][1]) for i in range(50)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_audit_sees_lost_pairs_beside_a_ball(spark):
    _, df = ball_and_pairs(spark)
    _, classes = vg.vector_classes(df, "vec_id", "embedding")
    # the ball is complete, of every isolated pair nothing was found but the copies
    links = F.when(F.col("first_id") < 1000, 199).otherwise(F.col("copies") - 1).cast("bigint")
    found = classes.select("c", "first_id", "vector", links.alias("n_links"))
    assert vg._audit(found, classes, 0.95, 128) < 0.97
    links = F.when(F.col("first_id") < 1000, 199).when(F.col("first_id") == 1001, 51).otherwise(F.col("copies")).cast("bigint")
    assert vg._audit(classes.select("c", "first_id", "vector", links.alias("n_links")), classes, 0.95, 128) == 1.0


def test_all_pairs_are_compared_after_the_last_try(spark):
    rows, df = ball_and_pairs(spark)
    assert got(df, target=100, degree=1, beam=1, recall=1.01, tries=1, block=90) == brute(rows)


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_dense_shard_is_built_and_searched_in_little_memory():
    """All 700 link with all: neither nodes with many neighbours nor many pairs in range make large tables."""
    rng = np.random.default_rng(0)
    n = 700
    points = vg.unit_rows(rng.normal(size=(1, 64)) + rng.normal(size=(n, 64)) * 0.08)
    shard = pa.table({"c": pa.array(np.arange(n)), "vector": pa.array(points.tolist(), pa.list_(pa.float64()))})
    lists, built = peak_mb(lambda: vg._build(24, 1.2)(None, shard))
    shard = shard.append_column("near", lists["near"]).append_column("copies", pa.array(np.ones(n, dtype=np.int64)))
    shard = shard.append_column("block", pa.array(np.zeros(n, dtype=np.int64))).append_column("shards", pa.array([[0]] * n, pa.list_(pa.int64())))
    key = [pa.scalar(0), pa.scalar(0), pa.scalar(0)]
    out, searched = peak_mb(lambda: vg._search(0.95, 12)(key, shard))
    assert out["links"].to_pylist() == ((points @ points.T >= 0.95).sum(axis=1) - 1).tolist() and min(out["links"].to_pylist()) > 600
    assert set(out["reached"].to_pylist()) == {0}
    assert built < 30 and searched < 100


def test_nearest_centroids_of_many_points_in_little_memory():
    rng = np.random.default_rng(1)
    points, centroids = (vg.unit_rows(rng.normal(size=(k, 8))) for k in (6_000, 400))
    near, mb = peak_mb(lambda: vg.near_centroids(points, centroids, 0.05))
    assert mb < 40 and [x[0] for x in near] == (points @ centroids.T).argmax(axis=1).tolist()
