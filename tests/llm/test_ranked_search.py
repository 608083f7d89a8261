"""Ranked search against plain Python, and the graph of shared terms."""

import math
import random
import re
from collections import Counter

import numpy as np

from dockflow.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def by_hand(docs, items, top):
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1):
            out.append((item, rank, doc, -score))
    return Counter(out)


def test_ranks_by_hand(spark):
    rng = random.Random(3)
    words = ["the", "of", "Été", "é", "x1", "Ü", "42", "日本", "𝔘", "rare1", "rare2", "mid", "And"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", "\u007f", ", "]) for _ in range(n))

    docs = [(i, text(rng.randint(1, 40))) for i in range(150)]
    docs += [(None, None), (200, ""), (201, " -_ "), (None, docs[3][1]), (5, docs[5][1]), (5, docs[9][1]), (202, text(5000))]
    docs += [(300 + i, docs[7][1]) for i in range(60)]
    items = [(i, text(rng.randint(1, 9))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "unknown words"), (3, "rare1 mid"), (None, "the rare2"), (28, items[4][1])]
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, n int, term string").repartition(5)
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    for top, block in ((50, 50_000), (3, 20)):
        got = rs.rank_documents(df, queries, top=top, block=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == by_hand(docs, items, top)
    assert rs.rank_documents(df.limit(0), queries).count() == 0
    assert rs.rank_documents(df, queries.limit(0)).count() == 0
    assert rs.rank_documents(df, queries.where("item_id = 27")).count() == 0


def test_shared_sums_are_the_items(monkeypatch):
    rng = random.Random(8)
    base = [rng.sample(range(60), 12) for _ in range(4)]
    items = [sorted(set(rng.choice(base)) | set(rng.sample(range(60, 200), 5))) for _ in range(40)]
    for segment in (4, 32):
        nodes, parts = rs.share_terms(items, 200, segment)
        values = {t: np.array([t * t + 1]) for t in range(200) if t % 7}
        all_values = rs.accumulate(dict(values), nodes, 200)
        for item, part in zip(items, parts):
            assert sum(int(all_values[p][0]) for p in part if p in all_values) == sum(int(values[t][0]) for t in item if t in values)
        assert len(nodes) + sum(map(len, parts)) < sum(map(len, items)) * (0.8 if segment == 4 else 0.6)
    assert rs.share_terms([], 0) == ([], [])
    # one set in all items: made once, then read by each
    nodes, parts = rs.share_terms([[0, 1, 2, 3]] * 10, 4)
    assert len(nodes) == 3 and all(len(p) == 1 for p in parts)


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(rs.text_slices, "__defaults__", (16,))
    text = "Abc déf " * 50 + "x" * 100
    total = sum(rs.count_terms(text), Counter())
    assert total == {b"abc": 50, "déf".encode(): 50, b"x" * 100: 1}
