"""Quality of a text from a linear-chain conditional random field over its lines.

Each line that holds a word is good or bad. What a line looks like (shares of capitals, digits, symbols and punctuation,
word lengths, repeated words, whether the line itself is repeated) together with the same of its neighbours gives the
weight of each label; a transition weight ties neighbours. Forward and backward passes give each line's probability of being
good, and the mean of these probabilities, weighted by the characters of the lines, is calibrated to the document's score.

Fitting: documents carry labels, lines don't, so each line starts with its document's label; after the first fit, lines of
bad documents that look good to the model count less, and the field is fitted once more. It is fitted with gradient steps on
the driver on a bounded sample: ``SAMPLE_DOCS`` distinct labelled texts per class with the smallest hash and at most
``SAMPLE_CHARS`` characters. The lines' weights are fitted on ``SAMPLE_LINES`` lines in a row of each, from a place that a hash of
the text names; the calibration reads these texts whole. The base rate is that of all labelled documents with a text, copies
included. Scoring reads every line of every text, however long.

Features come from arrays over all bytes of a batch; non-ASCII bytes count as letters. A text without lines scores the share
of good documents among the labelled ones; so does every text where nothing or one class only is labelled. Of repeated
labels of a document the lowest counts. Every input row gives one row, with repeated and null ids; other columns are left
aside, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import small_batches, small_slices, with_fields
from dockflow.session import settle

SAMPLE_DOCS = 1_500
SAMPLE_LINES = 40
SAMPLE_CHARS = 20_000
STEPS = 150
#: Bytes of text that are taken apart at once; the arrays over them take some hundred times that.
SLICE_BYTES = 1 << 17
_SPACE, _NEWLINE, _UPPER, _DIGIT, _SYMBOL, _MARK, _LETTER = range(7)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _MARK, dtype=np.uint8)
    kinds[128:] = _LETTER
    for chars, kind in (
        (b" \t\x0b\x0c\r", _SPACE), (b"\n", _NEWLINE), (bytes(range(65, 91)), _UPPER), (bytes(range(97, 123)), _LETTER),
        (b"0123456789", _DIGIT), (b"#*$%&|<>@^~_=+/\\{}[]", _SYMBOL),
    ):
        kinds[list(chars)] = kind
    return kinds


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that hold a word, how many characters each has, and the index of its text.

    Texts are taken apart ``SLICE_BYTES`` at a time, however many there are; one is never cut.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])  # characters: at most four times as many bytes
    cuts, begin = [], 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        cuts.append((begin, stop))
        begin = stop
    parts = [_slice_features(texts[a:b]) for a, b in cuts or [(0, 0)]]
    starts = [a for a, _ in cuts or [(0, 0)]]
    features, chars, text = zip(*parts)
    return np.concatenate(features), np.concatenate(chars), np.concatenate([t + a for t, a in zip(text, starts)])


def _slice_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer("\n".join([*texts, ""]).encode(), dtype=np.uint8)
    kinds = _byte_kinds()[data]
    text_ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    ends = np.flatnonzero(kinds == _NEWLINE)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    if not len(ends):
        return np.zeros((0, 12)), np.zeros(0), np.zeros(0, dtype=int)

    def per_line(mask):
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(float)

    blank = kinds <= _NEWLINE
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    chars, words = per_line(~blank), per_line(begins)
    counts = {k: per_line(kinds == k) for k in (_UPPER, _DIGIT, _SYMBOL, _MARK)}
    # words as numbers: a sum over their bytes, each times an odd factor by place
    at = np.flatnonzero(~blank)
    word_starts = np.flatnonzero(begins)
    repeats = np.zeros(len(ends))
    after = np.zeros(len(ends))
    again = np.zeros(len(ends))
    if len(word_starts):
        first = np.searchsorted(at, word_starts)
        length = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, length)
        factor = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value = (data[at].astype(np.uint64) + np.uint64(1)) * (factor ^ (factor >> np.uint64(29)))
        word = np.add.reduceat(value, first)
        line = np.searchsorted(ends, word_starts)
        order = np.lexsort((word, line))
        same = (line[order][1:] == line[order][:-1]) & (word[order][1:] == word[order][:-1])
        repeats = np.bincount(line[order][1:][same], minlength=len(ends)).astype(float)
        next_same = (line[1:] == line[:-1]) & (word[1:] == word[:-1])
        after = np.bincount(line[1:][next_same], minlength=len(ends)).astype(float)
        ranks = (np.arange(len(word)) - np.searchsorted(line, line)).astype(np.uint64)
        whole = np.zeros(len(ends), dtype=np.uint64)
        np.add.at(whole, line, (word ^ (word >> np.uint64(31))) * (ranks * np.uint64(2) + np.uint64(1)))
        text_of = np.searchsorted(text_ends, ends, side="right")
        order = np.lexsort((np.arange(len(ends)), whole, text_of))
        twin = (whole[order][1:] == whole[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
        again[order[1:][twin]] = 1.0
    keep = words > 0
    chars, words = chars[keep], words[keep]
    some = {k: v[keep] for k, v in counts.items()}
    features = np.stack([
        np.ones(len(chars)), some[_UPPER] / chars, some[_DIGIT] / chars, some[_SYMBOL] / chars, some[_MARK] / chars,
        some[_MARK] / words - 0.1, np.minimum(chars / words, 20) / 10 - 0.5, np.minimum(np.log1p(words), 6) / 3 - 1,
        repeats[keep] / words, after[keep] / words, again[keep], (some[_UPPER] / words > 0.9).astype(float),
    ], axis=1)
    return features, chars, np.searchsorted(text_ends, ends[keep], side="right")


def with_neighbours(features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Append the previous and the next line's features; at a text's ends zeros."""
    same = (text[1:] == text[:-1])[:, None]
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:] = features[:-1] * same
    after[:-1] = features[1:] * same
    return np.concatenate([features, before, after], axis=1)


def marginals(logits: np.ndarray, lengths: np.ndarray, tie: float) -> np.ndarray:
    """Log-odds of good for every line; the chains lie one after the other.

    ``logits`` are the lines' own log-odds and ``tie`` the log-odds of keeping the label from line to line. With two
    labels a message is one number: what one line's log-odds say about its neighbour's. Chains advance side by side.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")

    def passed(x):
        return np.logaddexp(x + tie, 0) - np.logaddexp(x, tie)

    ahead, back = np.zeros_like(logits), np.zeros_like(logits)
    for step in range(1, len(alive)):
        at = starts[order[: alive[step]]] + step
        ahead[at] = passed(ahead[at - 1] + logits[at - 1])
    ends = starts + lengths - 1
    for step in range(1, len(alive)):
        at = ends[order[: alive[step]]] - step
        back[at] = passed(back[at + 1] + logits[at + 1])
    return logits + ahead + back


def _tie_gradient(logits, lengths, tie, target) -> float:
    """Derivative of the chains' log-likelihood by ``tie``: observed less expected kept labels."""
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(logits), dtype=bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    odds = marginals(logits, lengths, tie)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first = np.zeros(len(logits), dtype=bool)
    first[starts] = True
    # the pair's own terms: each end's log-odds without the message over this edge
    over = np.zeros(len(logits))
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    for step in range(1, len(alive)):
        at = starts[order[: alive[step]]] + step
        x = over[at - 1] + logits[at - 1]
        over[at] = np.logaddexp(x + tie, 0) - np.logaddexp(x, tie)
    left = over[i] + logits[i]
    right = odds[i + 1] - over[i + 1]
    kept = np.logaddexp(left + right, 0) + tie
    expected = np.exp(kept - np.logaddexp(kept, np.logaddexp(left, right)))
    observed = target[i] * target[i + 1] + (1 - target[i]) * (1 - target[i + 1])
    return float((observed - expected).sum())


class LineField:
    """The fitted weights; ``base`` is the share of good documents."""

    def __init__(self, weights=None, tie: float = 0.0, scale: float = 0.0, shift: float = 0.0, base: float = 0.5):
        self.weights, self.tie, self.scale, self.shift, self.base = weights, tie, scale, shift, base

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean probability of the lines of each text, less a half, and whether it has any."""
        features, chars, text = line_features(texts)
        out, some = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if len(text) and self.weights is not None:
            some[text] = True
            lengths = np.bincount(text, minlength=len(texts))[some]
            odds = marginals(with_neighbours(features, text) @ self.weights, lengths, self.tie)
            probability = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            weight = np.bincount(text, chars, len(texts))
            out[some] = np.bincount(text, chars * probability, len(texts))[some] / weight[some] - 0.5
        return out, some

    def score(self, texts: list[str]) -> np.ndarray:
        evidence, some = self.evidence(texts)
        scored = 1 / (1 + np.exp(-np.clip(self.scale * evidence + self.shift, -30, 30)))
        return np.where(some, scored, self.base)


def _ascend(gradient, parameters: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam, uphill."""
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, steps + 1):
        g = gradient(parameters)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        parameters = parameters + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return parameters


def fit_field(texts: list[str], good: np.ndarray, steps: int = STEPS, lines: int = SAMPLE_LINES) -> LineField:
    """Fit on labelled texts (bounded: the caller's sample). ``good`` is 1 or 0 per text."""
    good = np.asarray(good, dtype=float)
    if not len(good) or good.min() == good.max():
        return LineField(base=float(good.mean()) if len(good) else 0.5)
    features, _, text = line_features(texts)
    count = np.bincount(text, minlength=len(texts))
    begin = np.array([zlib.crc32(t.encode()) for t in texts]) % np.maximum(count - lines + 1, 1)
    rank = np.arange(len(text)) - np.searchsorted(text, text) - begin[text]
    taken = (rank >= 0) & (rank < lines)
    inputs = with_neighbours(features, text)[taken]
    text = text[taken]
    lengths = np.bincount(text, minlength=len(texts))
    lengths = lengths[lengths > 0]
    label = good[text]
    target = label
    weights, tie = np.zeros(inputs.shape[1]), 1.0
    for _ in range(2):
        def gradient(p):
            logits = inputs @ p[:-1]
            odds = marginals(logits, lengths, p[-1])
            error = target - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))  # noqa: B023
            own = inputs.T @ error - 1e-2 * p[:-1]
            return np.append(own, _tie_gradient(logits, lengths, p[-1], target) - 1e-2 * p[-1]) / len(label)  # noqa: B023

        fitted = _ascend(gradient, np.append(weights, tie), steps, 0.05)
        weights, tie = fitted[:-1], float(fitted[-1])
        seen = 1 / (1 + np.exp(-np.clip(marginals(inputs @ weights, lengths, tie), -30, 30)))
        target = np.where(label == 0, np.minimum(seen, 0.9) * (seen > 0.6), 1.0)
    field = LineField(weights, tie, base=float(good.mean()))
    evidence, some = field.evidence(texts)
    x, y = evidence[some], good[some]

    def calibrate(p):
        error = y - 1 / (1 + np.exp(-np.clip(p[0] * x + p[1], -30, 30)))
        return np.array([(error * x).sum() - 1e-4 * p[0], error.sum()]) / len(y)

    field.scale, field.shift = map(float, _ascend(calibrate, np.array([4.0, 0.0]), 1500, 0.05))
    return field


def learn_field(
    df: DataFrame, labels: DataFrame, use: Column, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", sample_docs: int = SAMPLE_DOCS,
) -> LineField:
    """Fit on the documents where ``use`` is true that have a label; base rate and calibration follow the shares of all of them."""
    marks = labels.where(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("_id"))
    marks = marks.agg(F.min(label_column).alias("_good"))
    rows = df.where(use & F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    order = F.xxhash64("_text").alias("h")
    # ids, hashes and sizes of all labelled documents; texts are fetched for the sample only
    joined = settle(rows.select("_id", order, (F.char_length("_text") <= SAMPLE_CHARS).alias("short")).join(marks, "_id"))
    found = joined.groupBy("_good").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(F.col("short"), F.col("h"))).alias("texts")).collect()
    shares = {r["_good"]: r["n"] for r in found}
    # hashes are spread evenly: about twice the sample passes the threshold of each class, the smallest stay
    limit = F.lit(False)
    for r in found:
        share = min(1.0, 2 * sample_docs / max(1, r["texts"]))
        limit = F.when(F.col("_good") == r["_good"], F.col("h") <= min(int(share * 2**64) - 2**63, 2**63 - 1)).otherwise(limit)
    passed = joined.where(limit & F.col("short")).groupBy("h").agg(F.min("_good").alias("_good")).collect()
    chosen = []
    for label in (0, 1):
        chosen += sorted((r["h"], r["_good"]) for r in passed if r["_good"] == label)[:sample_docs]
    picked = F.broadcast(df.sparkSession.createDataFrame(chosen, "h long, _good int"))  # at most twice the sample's numbers
    sample = rows.select(order, "_text").join(picked, "h").distinct().collect()
    sample.sort(key=lambda r: (r["_good"], r["h"], r["_text"]))
    texts, good = [r["_text"] for r in sample], [r["_good"] for r in sample]
    field = fit_field(texts, np.array(good))
    total = sum(shares.values())
    if total:
        field.base = shares.get(1, 0) / total
        if 0 < field.base < 1 and field.scale:
            here = sum(good) / len(good)
            field.shift += float(np.log(field.base / (1 - field.base)) - np.log(here / (1 - here)))
    return field


def score_texts(
    df: DataFrame, field: LineField, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id_column`` and ``score`` (0 to 1) of every row."""
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in small_slices(batches, size=SLICE_BYTES):
            scores = field.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_column)


def keep_good(df: DataFrame, field: LineField, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores ``threshold`` or more."""
    rows = df.select(F.struct("*").alias("row"))
    place = df.columns.index(text_column)

    def run(batches):
        for batch in small_slices(with_fields(batches, {"text": place}), size=SLICE_BYTES):
            scores = field.score([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(scores >= threshold))], ["row"])

    with small_batches(df.sparkSession):
        return settle(rows.mapInArrow(run, rows.schema)).select("row.*")
