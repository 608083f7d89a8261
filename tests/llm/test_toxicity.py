"""The toxicity network: gradients, windows, held-out accuracy, edges."""

import random

import numpy as np
from pyspark.sql import functions as F

from dockflow.llm import toxicity as tx
from dockflow.llm.queries import toxicity_held_out

BAD = ["zorgle", "mukfit", "drabbel"]


def windows_by_hand(words):
    out, start = [], 0
    while words:
        out.append(tuple(words[start : start + tx.WINDOW]))
        if start + tx.WINDOW >= len(words):
            break
        start += tx.STRIDE
    return out


def read_back(portions):
    out = {}
    for held in portions:
        names = list(held.number)
        matrix, text = held.matrix()
        for row, i in zip(matrix, text):
            out.setdefault(int(i), []).append(tuple(names[k] for k in row if k >= 0))
    return out


def test_windows_overlap_and_cover_all():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(n)) for n in (0, 1, 31, 32, 33, 55, 56, 57, 80, 81, 500)]
    texts += [None, " -- \n", "ÄB é9_x", "y" * 300]
    want = {i: windows_by_hand([w for part in tx.words_of(t) for w in part]) for i, t in enumerate(texts)}
    want = {i: w for i, w in want.items() if w}
    assert want[13] == [("ÄB".encode().replace(b"B", b"b"), "é9".encode(), b"x")]
    assert read_back(tx.windows_of(texts)) == want
    assert read_back(tx.windows_of(texts, words_at_once=40, size=50)) == want


def test_gradients_by_differences(monkeypatch):
    rng = np.random.default_rng(1)
    words = [b"ab", b"abc", "éx".encode(), b"long-er"]
    bucket, word = tx.character_runs(words)
    weights = {k: v.astype(np.float64) for k, v in tx.start_weights(3, rng).items()}
    rows = np.array([0, 1, 2, 3])
    vectors = tx.word_vectors(weights, rows, bucket, word).astype(np.float64)
    windows = np.array([[0, 1, 2, 3, 0, 2], [3, 3, 1, -1, -1, -1]])
    pull = np.array([0.7, -1.3])
    monkeypatch.setattr(tx.np, "float32", np.float64)
    _, notes = tx.forward(weights, vectors, windows, keep=True)
    gradients, d_vectors = tx.backward(weights, vectors, notes, pull)

    def value():
        return float(tx.forward(weights, vectors, windows) @ pull)

    for name, grown in [*gradients.items(), ("vectors", d_vectors)]:
        values = vectors if name == "vectors" else weights[name]
        for at in rng.choice(values.size, min(6, values.size), replace=False):
            before = values.flat[at]
            values.flat[at] = before + 1e-5
            high = value()
            values.flat[at] = before - 1e-5
            low = value()
            values.flat[at] = before
            assert np.isclose(grown.flat[at], (high - low) / 2e-5, atol=1e-6), name


def test_character_runs_stay_in_words():
    bucket, word = tx.character_runs([b"abcd", b"", b"abcd", "é".encode()])
    # 6 marked characters: 4 + 3 + 2 runs
    assert np.bincount(word, minlength=4).tolist() == [9, 0, 9, 1]
    assert (bucket[word == 0] == bucket[word == 2]).all() and (np.diff(word) >= 0).all()
    assert len(tx.character_runs([])[0]) == 0


def sample(rng, toxic, words=150):
    out = ["".join(rng.choices(["ta", "re", "mi", "no", "lu", "sa"], k=rng.randint(1, 4))) for _ in range(words)]
    if toxic:
        for at in rng.sample(range(words), 2):
            out[at] = rng.choice(BAD) if rng.random() < 0.7 else "qux" + out[at]
    return " ".join(out)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    toxic = [i % 5 == 0 for i in range(600)]
    rows = [(i, sample(rng, t), 1.0) for i, t in enumerate(toxic)]
    marks = [(i, int(t) if rng.random() > 0.03 else int(not t)) for i, t in enumerate(toxic)]
    long_bad = sample(rng, False, 30_000) + " zorgle " + sample(rng, False, 2_000)
    edges = [(None, "ta re", 0.0), (1000, None, 0.0), (1001, "", 0.0), (1002, " -\n", 0.0), (1, rows[1][1], 0.0),
             (1003, long_bad, 0.0), (1004, sample(rng, False, 30_000), 0.0)]
    df = spark.createDataFrame([*rows, *edges], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([*marks, (3, marks[3][1]), (None, 1)], "doc_id long, toxic int")
    net = tx.learn_net(df, labels, ~toxicity_held_out())
    got = tx.score_texts(df, net).join(df.select("doc_id", "text"), "doc_id", "left")
    held = {r["doc_id"]: r["score"] for r in got.where(toxicity_held_out()).where("doc_id < 600").collect()}
    assert len(held) > 80
    assert np.mean([(s >= 0.5) == toxic[i] for i, s in held.items()]) > 0.97
    scores = tx.score_texts(df, net).collect()
    assert len(scores) == 607 and all(0 <= r["score"] <= 1 for r in scores)
    by_id = {r["doc_id"]: r["score"] for r in scores}
    assert by_id[1000] == by_id[1001] == by_id[1002] == net.base and 0.1 < net.base < 0.3
    assert by_id[1003] >= 0.5 > by_id[1004]
    assert len({round(r["score"], 6) for r in scores if r["doc_id"] == 1}) == 1
    # labels of held-out rows change nothing
    turned = labels.withColumn("toxic", F.when(toxicity_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tx.learn_net(df, turned, ~toxicity_held_out())
    assert again.base == net.base and again.scale == net.scale and again.shift == net.shift
    assert tx.score_texts(df.limit(0), net).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in tx.score_texts(df, tx.learn_net(df, labels, F.lit(True))).collect()] == [1.0, 1.0]
    none = tx.learn_net(df, labels.limit(0), F.lit(True))
    assert [r["score"] for r in tx.score_texts(df, none).collect()] == [0.0, 0.0]
    assert tx.learn_net(df.limit(0), labels, F.lit(True)).base == 0.0
    spaces = tx.fit_net(["", " "], np.array([0, 1]))
    assert spaces.score(["a", ""]).tolist() == [0.5, 0.5]
