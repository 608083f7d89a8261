"""The line field: exact marginals, features, held-out accuracy."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from dockflow.llm import line_quality as lq


def brute(logits, tie):
    """Log-odds of good per line by summing over all labellings."""
    n = len(logits)
    weight = {}
    for labels in itertools.product((0, 1), repeat=n):
        kept = sum(a == b for a, b in zip(labels, labels[1:]))
        weight[labels] = np.exp(sum(x for x, y in zip(logits, labels) if y) + tie * kept)
    return [
        np.log(sum(w for k, w in weight.items() if k[i]) / sum(w for k, w in weight.items() if not k[i])) for i in range(n)
    ]


def likelihood(logits, lengths, tie, target):
    out, at = 0.0, 0
    for n in lengths:
        part, labels = logits[at : at + n], target[at : at + n]
        total = sum(
            np.exp(sum(x for x, y in zip(part, ls) if y) + tie * sum(a == b for a, b in zip(ls, ls[1:])))
            for ls in itertools.product((0, 1), repeat=n)
        )
        out += sum(part[labels == 1]) + tie * sum(labels[1:] == labels[:-1]) - np.log(total)
        at += n
    return out


def test_marginals_and_gradient_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5, 2, 5])
    logits, tie = rng.normal(size=lengths.sum()) * 2, 0.7
    at = np.concatenate([[0], np.cumsum(lengths)])
    want = np.concatenate([brute(logits[a:b], tie) for a, b in zip(at, at[1:])])
    assert np.allclose(lq.marginals(logits, lengths, tie), want)
    target = rng.integers(0, 2, size=lengths.sum())
    step = 1e-5
    slope = (likelihood(logits, lengths, tie + step, target) - likelihood(logits, lengths, tie - step, target)) / (2 * step)
    assert np.isclose(lq._tie_gradient(logits, lengths, tie, target), slope, atol=1e-5)


def test_features_count_each_line():
    features, chars, text = lq.line_features(["", "AB cd\n\n  \nx x x", "\n", "ü1 #\nAB cd\nAB cd"])
    assert text.tolist() == [1, 1, 3, 3, 3] and chars.tolist() == [4, 3, 4, 4, 4]
    assert features[0, 1] == 0.5 and features[1, 8] == 2 / 3 and features[1, 9] == 2 / 3
    assert features[2, 3] == 0.25 and features[:, 10].tolist() == [0, 0, 0, 0, 1]
    assert len(lq.line_features([])[0]) == 0 and len(lq.line_features(["", ""])[0]) == 0


def sample(rng, good):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
    if not good:
        words = [w + "%%%" for w in words] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, 60, 12))


def test_lines_come_from_anywhere_in_a_text(monkeypatch):
    """Long texts whose bad lines all come late are learned as bad."""
    rng = random.Random(12)
    good = [sample(rng, True).split("\n")[0] for _ in range(4_000)]
    bad = [sample(rng, False).split("\n")[0] for _ in range(4_000)]
    texts = ["\n".join(rng.sample(good, 100)) for _ in range(60)]
    texts += ["\n".join(rng.sample(good, 40) + rng.sample(bad, 60)) for _ in range(60)]
    label = np.array([1] * 60 + [0] * 60)
    field = lq.fit_field(texts, label)
    assert ((field.score(texts) >= 0.5) == label).mean() > 0.95


def test_copies_count_in_the_base_rate(spark):
    rng = random.Random(9)
    rows = [(i, sample(rng, True)) for i in range(60)] + [(60 + i, sample(rng, False)) for i in range(7)]
    rows += [(67 + i, rows[60][1]) for i in range(33)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, quality int")
    for sample_docs in (1_500, 5):
        field = lq.learn_field(df, labels, F.lit(True), sample_docs=sample_docs)
        assert field.base == 0.6
        assert all(s == 0.6 for s in field.score(["", "\n"]))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, sample(rng, i % 5 > 0), 1.0) for i in range(400)]
    edges = [(None, "fine words here", 0.0), (1000, None, 0.0), (1001, "", 0.0), (1002, "\n \n", 0.0), (1, rows[1][1], 0.0)]
    edges.append((1003, "good words and more\n" * 30_000, 0.0))
    df = spark.createDataFrame(rows + edges, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), "x") for i in range(400)] + [(1, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    train = F.col("doc_id") % 2 == 0
    field = lq.learn_field(df, labels, train)
    out = lq.score_texts(df, field).collect()
    assert len(out) == len(rows) + len(edges) and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert sum((by_id[i] >= 0.7) == (i % 5 > 0) for i in range(1, 400, 2)) >= 196
    assert by_id[1000] == by_id[1001] == by_id[1002] == field.base
    kept = lq.keep_good(df, field)
    assert kept.columns == df.columns and kept.count() == sum(r["score"] >= 0.7 for r in out)
    assert lq.score_texts(df.limit(0), field).count() == 0
    assert lq.learn_field(df, labels.limit(0), train).weights is None
    assert lq.learn_field(df, labels.where("quality = 1"), train).base == 1.0


def test_many_texts_are_taken_apart_in_slices(monkeypatch):
    """What the driver learns from is a few MB of text; the arrays over its bytes never cover all of it."""
    import tracemalloc

    import numpy as np

    from dockflow.llm import line_quality

    texts = [f"some words of text {i} and MORE #1\n" * 60 for i in range(2_500)]
    tracemalloc.start()
    try:
        features, chars, text = line_quality.line_features(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(features) == 150_000 and peak < 120e6
    monkeypatch.setattr(line_quality, "SLICE_BYTES", 1 << 40)
    for made, whole in zip((features, chars, text), line_quality.line_features(texts)):
        assert np.array_equal(made, whole)


def test_keep_good_sends_few_texts_to_python_at_once(spark):
    from dockflow.llm import line_quality

    def narrow(batches):
        for batch in batches:
            assert batch.num_rows <= 256
            yield batch

    df = spark.range(1_000).selectExpr("id AS doc_id", "'some line ' || id AS text").coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(setting)
    field = line_quality.LineField(base=0.8)
    assert line_quality.keep_good(df.mapInArrow(narrow, df.schema), field).count() == 1_000
    assert spark.conf.get(setting) == kept
