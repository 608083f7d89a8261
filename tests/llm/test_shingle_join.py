"""Near duplicates and components against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from dockflow.llm import shingle_join as sj
from dockflow.llm.graphs import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(rows):
    """Per row its set size and component's smallest id; rows are known by their place."""
    sets = [shingles(t) for _, t in rows]
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    of = components(range(len(rows)), edges)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[of[i]] = min(doc_id, ids.get(of[i], doc_id))
    return sorted((r[0] is None, r[0], len(s), ids.get(of[i], None)) for i, (r, s) in enumerate(zip(rows, sets)))


def text(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def changed(rng, words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"c{rng.randrange(10**6)}"
    return out


def corpus(rng, docs):
    passages = [text(rng, 40) for _ in range(3)]
    rows = []
    for i in range(docs):
        kind = rng.random()
        if kind < 0.5 or not rows:
            words = text(rng, rng.choice([1, 3, 4, 5, 6, 9, 30, 200]))
        else:
            words = changed(rng, rng.choice(rows[-60:])[1].split(), rng.choice([0, 0.01, 0.03, 0.05]))
        if rng.random() < 0.4:
            at = rng.randrange(len(words) + 1)
            words = words[:at] + rng.choice(passages) + words[at:]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.01 else w for w in words)))
    return rows


def got(df, **options):
    return sorted(
        (r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in sj.near_duplicates(df, **options).collect()
    )


@pytest.mark.parametrize("rare", [2, 4, 32])
def test_components_by_brute_force(spark, monkeypatch, rare):
    monkeypatch.setattr(sj, "RARE", rare)
    monkeypatch.setattr(sj, "MIN_BUCKETS", 5)
    rows = corpus(random.Random(rare), 260)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, k string").repartition(3)
    assert got(df) == brute(rows)


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(sj, "RARE", 8)
    rng = random.Random(9)
    base = text(rng, 120, 10**6)
    rows = [(i, " ".join(changed(rng, base, 0.005 * (i % 6)))) for i in range(120)]
    rows += [(200 + i, " ".join(base)) for i in range(30)] + [(300 + i, " ".join(base[:60] + text(rng, 70, 10**6))) for i in range(40)]
    rows += [(400 + i, " ".join(base[: 90 + i])) for i in range(25)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_edges(spark):
    long = " ".join(text(random.Random(1), 30_000, 10**6))
    rows = [(1, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two three four"), (7, "one two three four")]
    rows += [(8, "a b c d e"), (9, "A\x0bB c\rd e"), (9, "a b c d e"), (10, "a b c d e a b c d e a b c d e"), (11, long), (12, long + " end")]
    rows += [(13, "é É ü Ü ö"), (14, "é é ü ü ö"), (15, "\xa0 x y z w"), (16, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    none = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (None, "q"), (None, None)], "doc_id long, text string")
    assert sorted((r["n_shingles"], r["component_id"] or -1) for r in sj.near_duplicates(none).collect()) == [(0, -1), (1, -1), (1, 7), (1, 7), (1, 7)]
    assert sj.near_duplicates(df.limit(0)).count() == 0


def test_sets_are_the_same_whatever_the_batch():
    rng = random.Random(3)
    texts = [" ".join(text(rng, rng.randrange(12), 9)).encode() for _ in range(200)]
    for t, s in zip(texts, sj.shingle_sets(texts)):
        assert len(s) == len(shingles(t.decode())) and (s == sj.shingle_sets([t])[0]).all()
        assert (np.diff(s.astype(object)) > 0).all() if len(s) > 1 else True


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    edges += [(5, 5), (-3, 8), (-3, 8)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    assert out == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    made = sj.sketches([*sets, np.zeros(0, dtype=np.uint64)])
    assert made.shape == (61, sj.SKETCH) and not made[60].any()
    told = 0
    for a in range(60):
        for b in range(a):
            differ = sum(int(x).bit_count() for x in (made[a] ^ made[b]).view(np.uint64))
            really = len(np.setxor1d(sets[a], sets[b]))
            assert differ <= really and (really - differ) % 2 == 0
            both = len(np.intersect1d(sets[a], sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                assert 9 * differ <= len(sets[a]) + len(sets[b])
            else:
                told += 9 * differ > len(sets[a]) + len(sets[b])
    assert told > 1_500


def test_sets_that_nearly_link_meet_few_times(spark):
    """Every two sets that share a pair of tokens meet, but not once for each pair that they share."""
    rng = random.Random(4)
    common = rng.sample(range(10**15), 200)
    rows = []
    for k in range(30):
        tokens = sorted(rng.sample(common, 170))
        rows.append((k, 900, k, k % 3 > 0, *[0] * sj.SKETCH, tokens))
    longs = ", ".join(f"s{i} long" for i in range(sj.SKETCH))
    sets = spark.createDataFrame(rows, f"k long, n long, c long, heavy boolean, {longs}, tokens array<long>").repartition(3)
    sigs = sj._pair_signatures(sets).where("sig IS NOT NULL")
    assert sigs.where("size(least) > 4 OR lowest <> array_contains(least, sig)").count() == 0
    met = [tuple(sorted(r)) for r in sj._meetings(sigs).select("k_a", "k_b").collect()]
    of = {r[0]: {x["sig"] for x in sigs.where(f"k = {r[0]} AND level = 10").select("sig").collect()} for r in rows[:6]}
    for a in range(6):
        for b in range(a):
            assert ((b, a) in met) == (bool(a % 3 or b % 3) and bool(of[a] & of[b]))
            assert a % 3 == b % 3 == 0 or len(of[a] & of[b]) > 30
    pairs = {(a, b) for b in range(30) for a in range(b) if a % 3 or b % 3}
    assert set(met) == pairs and len(met) < 6 * len(pairs)


def test_keep_one_sends_few_texts_to_python_at_once(spark):
    def narrow(batches):
        for batch in batches:
            assert batch.num_rows <= 256
            yield batch

    rows = [(i // 2, f"one two three four five {i // 4}") for i in range(1_000)] + [(None, "a b"), (None, "a b"), (None, " "), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(setting)
    out = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in sj.keep_one(df.mapInArrow(narrow, df.schema)).collect())
    assert spark.conf.get(setting) == kept
    want = [(False, 2 * i, f"one two three four five {i}") for i in range(250)] + [(False, 7, ""), (True, 0, " "), (True, 0, "a b")]
    assert out == sorted(want)


def test_keep_one_deals_only_rows_with_a_like_and_leaves_few_tables(spark, monkeypatch):
    written, settle = [], sj.settle
    monkeypatch.setattr(sj, "settle", lambda df, **how: written.append(settle(df, **how)) or written[-1])
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(9))) for i in range(60)] + [(70 + i, f"t{i}w0 \n" + rows_text(i)) for i in range(8)]
    rows += [(80, None), (80, None), (3, " ".join(f"t3w{j}" for j in range(9)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted((r["doc_id"], r["text"] or "") for r in sj.keep_one(df).collect())
    assert out == sorted([*rows[:60], (80, ""), (80, "")])
    keyed = [t for t in written if "row" in t.columns]
    assert len(keyed) == 1 and keyed[0].where("NOT sole").count() == 17
    left = [t for t in written if Path(t.inputFiles()[0].removeprefix("file:")).exists()]
    assert sorted(map(len, (t.columns for t in left))) == sorted([3, 3, 4 + sj.SKETCH])


def rows_text(i):
    return " ".join(f"T{i}w{j}" for j in range(1, 9))


def test_sets_without_enough_pairs_meet_few_times(spark):
    """Sets that lack pairs meet all that share enough frequent tokens, and hardly ever twice."""
    rng = random.Random(8)
    common = sorted(rng.sample(range(10**15), 300))
    n = 1_000  # 259 tokens are indexed, 148 of which sets that link share at least
    rows = []
    for k in range(40):
        tokens = rng.sample(common, rng.choice([20, 120, 240, 259]))
        rows.append((k, n, k // 2, k % 3 == 0, *[0] * sj.SKETCH, tokens))
    longs = ", ".join(f"s{i} long" for i in range(sj.SKETCH))
    sets = spark.createDataFrame(rows, f"k long, n long, c long, lacks boolean, {longs}, tokens array<long>").repartition(3)
    met = [tuple(sorted(r)) for r in sj._first_meetings(sets).select("k_a", "k_b").collect()]
    must = set()
    for a, b in ((a, b) for b in range(40) for a in range(b) if (a % 3 == 0 or b % 3 == 0) and a // 2 != b // 2):
        rare = 259 - max(len(rows[a][-1]), len(rows[b][-1]))
        both = len(set(rows[a][-1]) & set(rows[b][-1]))
        if both and both + rare >= 148:
            must.add((a, b))
    assert len(must) > 100 and must <= set(met)
    assert len(met) < 3 * len(set(met))


def test_parts_of_a_component_join_before_all_pairs_meet(spark, monkeypatch):
    """Few of a large group link with its most typical set; the others join in rounds, so few pairs of them are left."""
    monkeypatch.setattr(sj, "RARE", 8)
    met, candidates = [], sj.candidate_pairs
    monkeypatch.setattr(sj, "candidate_pairs", lambda *given: met.append(sj.settle(candidates(*given), stays=True)) or met[-1])
    rng = random.Random(21)
    base = text(rng, 150, 10**6)
    rows = [(i, " ".join(changed(rng, base, 0.018))) for i in range(240)] + [(None, " ".join(base[:3]))] * 2
    # typical in the tokens that are indexed, but with a tail of its own that nothing else has
    rows += [(500 + i, " ".join(base + text(rng, 45, 10**6))) for i in range(6)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    assert met[0].count() < 2 * len(rows)


def test_nearest_pairs(spark, monkeypatch):
    """Each component meets only larger ones, two at most, in pairs of sets that may link."""
    monkeypatch.setattr(sj, "RARE", 8)
    rng = random.Random(22)
    base = text(rng, 150, 10**6)
    rows = [(i, " ".join(changed(rng, base, 0.015))) for i in range(90)] + [(200 + i, " ".join(text(rng, 30, 10**6))) for i in range(9)]
    made = dict(zip(range(99), sj.shingle_sets([t.encode() for _, t in rows])))
    of = {sj.digest(s)[0]: s for s in made.values()}
    documents = spark.createDataFrame([(i, t) for i, t in rows], "id long, text string")
    sets = sj.settle(sj.set_table(documents))
    low = sj.low_tokens(sj.settle(sj.shared_tokens(documents, 5)), sets)
    assert low.where("df >= 8").count() > 0
    near = [sj.digest(made[i])[0] for i in range(90)]
    members = {min(near[:30]): near[:30], min(near[30:45]): near[30:45]}
    labels = spark.createDataFrame([(k, c) for c, ks in members.items() for k in ks], "node long, component long")
    component = {k: c for c, ks in members.items() for k in ks}
    size = {c: len(ks) for c, ks in members.items()}
    turns = [sorted(map(tuple, sj.nearest_pairs(low, sets, labels, turn).collect())) for turn in (0, 1)]
    assert turns[0] != turns[1]
    for pairs in turns:
        of_component = {}
        for a, b in pairs:
            c, d = component.get(a, a), component.get(b, b)
            assert c != d and (size.get(c, 1), c) < (size.get(d, 1), d) and len(np.intersect1d(of[a], of[b])) > 0
            of_component.setdefault(c, []).append(d)
        assert all(len(set(ds)) == len(ds) <= 2 for ds in of_component.values()) and len(of_component) > 20
