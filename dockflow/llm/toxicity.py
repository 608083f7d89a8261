"""Toxicity of whole texts from a bidirectional gated recurrent network over windows of words.

A text's words (runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased) are read in windows of
``WINDOW`` words, each of which begins ``STRIDE`` words after the one before, to the text's end. A word enters as the learned vector
of the word, if it is one of the ``WORDS`` most widespread of the training texts, next to the sum of the learned vectors of its runs
of three to five characters, divided by the root of their number. Two gated recurrent units read a window forwards and backwards; attention weighs their states, and the pooled state
gives the window's log-odds. The text's evidence is its highest window, calibrated to a probability.

Labels are known for texts, not for windows, and some are wrong. Training therefore goes in rounds: in each, the network picks
the window of every text that looks most toxic to it (at first by the smoothed log-odds of words and character runs, which also start one
number of each vector), and is trained on the picked windows, and on others of the clean texts. In later rounds a toxic text counts
the less, the less the network finds in it. A fifth of the texts is kept out of training and calibrates the score. It is trained with numpy on the driver on a bounded sample: of each class the
``SAMPLE_DOCS`` distinct labelled texts of the smallest hash with at most ``SAMPLE_CHARS`` characters, whole. The base rate is that
of all labelled documents, copies included. Scoring reads every window of every text; a long text is taken apart in slices.

Null and empty texts, and such without a word, score the share of toxic documents among the labelled ones; so does every text
where nothing or one class only is labelled. Of repeated labels of a document the highest counts; texts that carry both labels are
drawn as toxic. Every input row gives one row, with repeated and null ids; other columns are left aside, whatever their names. Equal
texts score equally. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import small_slices
from dockflow.session import settle

SAMPLE_DOCS = 1_500
SAMPLE_CHARS = 50_000
WINDOW, STRIDE = 32, 24
WORDS = 20_000
#: Sizes: word vector, vector of a character run, buckets that runs are hashed to, state of one direction.
WORD_DIM, CHAR_DIM, BUCKETS, STATE = 8, 8, 1 << 14, 12
RUNS = (3, 4, 5)
ROUNDS, PASSES = 3, 3
#: Bytes of text that are taken apart at once, words whose windows are scored together, and windows that advance together.
TEXT_SLICE = 1 << 20
WORDS_AT_ONCE = 200_000
WINDOWS_AT_ONCE = 2_048

#: Per byte of UTF-8: a word's byte, with A-Z lower-cased, or a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None, size: int = TEXT_SLICE) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    data = (text or "").encode().translate(_TABLE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def window_starts(n: int) -> range:
    """Where the windows of a text of ``n`` words start; the last reaches its end."""
    return range(0, max(n - WINDOW + STRIDE, 1) if n else 0, STRIDE)


class Windows:
    """Windows of several texts, as numbers of distinct words; -1 where a window is longer than its text."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.words: list[int] = []
        self.spans: list[tuple[int, int, int]] = []  # text, first and last place in ``words``

    def add(self, text: int, words: list[bytes], starts: range) -> None:
        base = len(self.words)
        self.words.extend(self.number.setdefault(w, len(self.number)) for w in words)
        self.spans.extend((text, base + s, min(base + s + WINDOW, len(self.words))) for s in starts)

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers per window, and the text of each."""
        spans = np.array(self.spans, np.int64).reshape(-1, 3)
        at = spans[:, 1:2] + np.arange(WINDOW)
        words = np.append(np.array(self.words, np.int32), np.int32(-1))
        return np.where(at < spans[:, 2:], words[np.minimum(at, len(self.words))], -1), spans[:, 0]


def windows_of(texts: list[str | None], words_at_once: int = WORDS_AT_ONCE, size: int = TEXT_SLICE) -> Iterator[Windows]:
    """All windows of all texts, in bounded portions."""
    held = Windows()
    for i, text in enumerate(texts):
        rest: list[bytes] = []
        seen = False
        for part in words_of(text, size):
            rest += part
            # the full windows; from where the next one starts, the words stay for the next slice
            starts = range(0, len(rest) - WINDOW + 1, STRIDE)
            if len(starts):
                held.add(i, rest, starts)
                rest, seen = rest[len(starts) * STRIDE :], True
            if len(held.words) >= words_at_once:
                yield held
                held = Windows()
        if len(rest) > (WINDOW - STRIDE if seen else 0):
            held.add(i, rest, window_starts(len(rest)))
    if held.spans:
        yield held


def character_runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character runs of words with their ends marked, in the order of words, and the index of the word of each."""
    marked = "".join(f"\x01{w.decode('utf-8', 'replace')}\x02" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 1) - 1
    buckets, at = [], []
    for n in RUNS:
        h = np.full(max(len(points) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        at.append(owner[: len(h)][inside])
    word = np.concatenate(at)
    order = np.argsort(word, kind="stable")
    return np.concatenate(buckets)[order], word[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = WORD_DIM + CHAR_DIM

    def some(*shape, scale):
        return (rng.normal(size=shape) * scale).astype(np.float32)

    weights = {"word": some(n_words + 1, WORD_DIM, scale=0.1), "char": some(BUCKETS, CHAR_DIM, scale=0.02)}
    for way in ("f", "b"):
        weights["w" + way] = some(size, 3 * STATE, scale=size**-0.5)
        weights["u" + way] = some(STATE, 3 * STATE, scale=STATE**-0.5)
        weights["c" + way] = np.zeros(3 * STATE, np.float32)
    weights["a"], weights["ac"] = some(2 * STATE, STATE, scale=0.3), np.zeros(STATE, np.float32)
    weights["v"], weights["o"] = some(STATE, scale=0.5), some(2 * STATE, scale=0.3)
    weights["oc"] = np.zeros(1, np.float32)
    return weights


def word_vectors(weights: dict, rows: np.ndarray, bucket: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Inputs of distinct words: the vector of the row next to what their character runs' vectors add up to."""
    out = np.zeros((len(rows), WORD_DIM + CHAR_DIM), np.float32)
    out[:, :WORD_DIM] = weights["word"][rows]
    if len(bucket):
        n = np.sqrt(np.bincount(word, minlength=len(rows)))
        for k in range(CHAR_DIM):
            out[:, WORD_DIM + k] = np.bincount(word, weights["char"][bucket, k], len(rows)) / np.maximum(n, 1)
    return out


def _unit(into: np.ndarray, mask: np.ndarray, recur: np.ndarray, keep: bool):
    """One direction: ``into`` (step, window, 3 x state) holds the inputs' part; states per step, and what the way back needs."""
    steps, n, _ = into.shape
    h = np.zeros((n, STATE), np.float32)
    states, notes = np.empty((steps, n, STATE), np.float32), []
    for t in range(steps):
        own = h @ recur
        gates = _sigmoid(into[t, :, : 2 * STATE] + own[:, : 2 * STATE])
        z, r = gates[:, :STATE], gates[:, STATE:]
        new = np.tanh(into[t, :, 2 * STATE :] + r * own[:, 2 * STATE :])
        before, h = h, (new + z * (h - new)) * mask[t]
        states[t] = h
        if keep:
            notes.append((before, z, r, new, own[:, 2 * STATE :]))
    return states, notes


def forward(weights: dict, vectors: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Log-odds of each window; ``vectors`` are the inputs of the words that ``windows`` numbers."""
    index = windows.T  # step, window; -1 reads the last row, which is left out by the mask
    mask = (index >= 0).astype(np.float32)[:, :, None]
    sides = {}
    for way, at, m in (("f", index, mask), ("b", index[::-1], mask[::-1])):
        into = (vectors @ weights["w" + way] + weights["c" + way])[at]
        states, notes = _unit(into, m, weights["u" + way], keep)
        sides[way] = states, notes
    both = np.concatenate([sides["f"][0], sides["b"][0][::-1]], 2)
    hidden = np.tanh(both @ weights["a"] + weights["ac"])
    scored = np.where(mask[:, :, 0] > 0, hidden @ weights["v"], -np.inf)
    share = np.exp(scored - scored.max(0))
    share /= share.sum(0)
    pooled = np.einsum("tn,tnk->nk", share, both)
    odds = pooled @ weights["o"] + weights["oc"][0]
    return (odds, (index, mask, sides, both, hidden, share, pooled)) if keep else odds


def backward(weights: dict, vectors: np.ndarray, notes, d_odds: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the word inputs."""
    index, mask, sides, both, hidden, share, pooled = notes
    out = {"o": pooled.T @ d_odds, "oc": d_odds.sum(keepdims=True)}
    d_pooled = d_odds[:, None] * weights["o"]
    d_share = np.einsum("tnk,nk->tn", both, d_pooled)
    d_scored = share * (d_share - (share * d_share).sum(0))
    d_both = share[:, :, None] * d_pooled
    out["v"] = np.einsum("tn,tnk->k", d_scored, hidden)
    d_hidden = d_scored[:, :, None] * weights["v"] * (1 - hidden**2)
    out["a"] = np.einsum("tnk,tnj->kj", both, d_hidden)
    out["ac"] = d_hidden.sum((0, 1))
    d_both = d_both + d_hidden @ weights["a"].T
    d_vectors = np.zeros_like(vectors)
    for way, at, m, d_states in (
        ("f", index, mask, d_both[:, :, :STATE]), ("b", index[::-1], mask[::-1], d_both[::-1, :, STATE:])
    ):
        recur = weights["u" + way]
        d_recur, d_h = np.zeros_like(recur), np.zeros(d_states.shape[1:], np.float32)
        d_into = np.zeros((*d_states.shape[:2], 3 * STATE), np.float32)
        for t in range(len(d_states) - 1, -1, -1):
            before, z, r, new, own = sides[way][1][t]
            d = (d_states[t] + d_h) * m[t]
            d_new = d * (1 - z) * (1 - new**2)
            d_gates = np.concatenate([d * (before - new) * z * (1 - z), d_new * own * r * (1 - r)], 1)
            d_own = np.concatenate([d_gates, d_new * r], 1)
            d_into[t, :, : 2 * STATE], d_into[t, :, 2 * STATE :] = d_gates, d_new
            d_recur += before.T @ d_own
            d_h = d * z + d_own @ recur.T
        out["u" + way] = d_recur
        out["c" + way] = d_into.sum((0, 1))
        x = vectors[at]
        out["w" + way] = np.einsum("tnk,tnj->kj", x, d_into, optimize=True)
        d_x = (d_into @ weights["w" + way].T).reshape(-1, vectors.shape[1])
        seen = at.ravel() >= 0
        np.add.at(d_vectors, at.ravel()[seen], d_x[seen])
    return out, d_vectors


class Adam:
    """Gradient steps with running means."""

    def __init__(self, weights: dict, rate: float):
        self.rate, self.t = rate, 0
        self.mean = {k: np.zeros_like(w) for k, w in weights.items()}
        self.square = {k: np.zeros_like(w) for k, w in weights.items()}

    def step(self, weights: dict, gradients: dict) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            weights[k] -= rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-6)


class ToxicNet:
    """The trained network; ``base`` is the share of toxic documents."""

    def __init__(self, vocabulary=None, weights=None, scale: float = 1.0, shift: float = 0.0, base: float = 0.0):
        self.vocabulary, self.weights, self.scale, self.shift, self.base = vocabulary or {}, weights, scale, shift, base

    def inputs(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and character runs of distinct words; row 0 is for words outside the vocabulary."""
        words = list(words)
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64), *character_runs(words)

    def window_odds(self, vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        parts = [forward(self.weights, vectors, matrix[i : i + WINDOWS_AT_ONCE]) for i in range(0, len(matrix), WINDOWS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of the most toxic window of each text, -inf without words."""
        out = np.full(len(texts), -np.inf)
        for held in windows_of(texts):
            matrix, text = held.matrix()
            np.maximum.at(out, text, self.window_odds(word_vectors(self.weights, *self.inputs(held.number)), matrix))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        odds = self.evidence(texts)
        some = np.isfinite(odds)
        return np.where(some, _sigmoid(self.scale * np.where(some, odds, 0) + self.shift), self.base)


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much likelier something is in toxic texts, from the texts that hold it; what few hold is pulled to 0."""
    return (np.log((toxic + 3) / (n_toxic + 6)) - np.log((clean + 3) / (n_clean + 6))).astype(np.float32)


def _spread(pairs: np.ndarray, toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean texts per number, from distinct (text, number) pairs."""
    label = toxic[pairs[:, 0]] == 1
    return np.bincount(pairs[label, 1], minlength=size), np.bincount(pairs[~label, 1], minlength=size)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a weighted logistic regression on one number, by Newton's steps with a small ridge."""
    middle, wide = x.mean(), x.std() + 1e-6
    u = np.stack([(x - middle) / wide, np.ones(len(x))], 1)
    p = np.zeros(2)
    for _ in range(50):
        s = _sigmoid(u @ p)
        gradient = u.T @ (weight * (y - s)) - 1e-2 * p
        curve = (u * (weight * s * (1 - s))[:, None]).T @ u + 1e-2 * np.eye(2)
        p = p + np.clip(np.linalg.solve(curve, gradient), -1, 1)
    scale = max(float(p[0] / wide), 0.0)
    return scale, float(p[1] - scale * middle)


def fit_net(texts: list[str], toxic: np.ndarray, base: float | None = None, rounds: int = ROUNDS, passes: int = PASSES, seed: int = 0) -> ToxicNet:
    """Train on labelled texts (bounded: the caller's sample). ``toxic`` is 1 or 0 per text, ``base`` the share to calibrate to."""
    toxic = np.asarray(toxic, dtype=np.float32)
    base = float(toxic.mean()) if base is None and len(toxic) else base or 0.0
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicNet(base=base)
    rng = np.random.default_rng(seed)
    kept = np.zeros(len(texts), bool)  # for calibration: a fifth of each class
    for label in (0, 1):
        kept[rng.permutation(np.flatnonzero(toxic == label))[: int((toxic == label).sum()) // 5]] = True
    held = Windows()
    for i, text in enumerate(texts):
        words = [w for part in words_of(text) for w in part]
        held.add(i, words, window_starts(len(words)))
    matrix, text = held.matrix()
    if not len(text):
        return ToxicNet(base=base)
    names = list(held.number)
    bucket, word = character_runs(names)
    n_runs = np.bincount(word, minlength=len(names))
    first_run = np.cumsum(n_runs) - n_runs

    def runs_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = n_runs[some]
        return bucket[np.repeat(first_run[some] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(some)), n)

    # in how many training texts of each class a word or a character run occurs
    train = ~kept[text]
    in_words, in_runs = np.zeros((2, len(names)), np.int64), np.zeros((2, BUCKETS), np.int64)
    for begin in range(0, len(texts), 100):
        here = train & (text >= begin) & (text < begin + 100)
        pairs = np.unique(np.stack([np.repeat(text[here], WINDOW), matrix[here].ravel()], 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        in_words += _spread(pairs, toxic, len(names))
        run, owner = runs_of(pairs[:, 1])
        in_runs += _spread(np.unique(np.stack([pairs[owner, 0], run], 1), axis=0), toxic, BUCKETS)
    n_toxic, n_clean = int((toxic[~kept] == 1).sum()), int((toxic[~kept] == 0).sum())
    both = in_words.sum(0)
    widest = sorted(np.flatnonzero(both >= max(3, (n_toxic + n_clean) // 300)), key=lambda i: (-both[i], names[i]))[:WORDS]
    weights = start_weights(len(widest), rng)
    net = ToxicNet({names[i]: k for k, i in enumerate(widest, 1)}, weights, base=base)
    weights["word"][0], weights["word"][1:, 0] = 0, _log_odds(*in_words[:, widest], n_toxic, n_clean) / 2
    weights["char"][:, 0] = _log_odds(*in_runs, n_toxic, n_clean) / 2
    rows = np.array([net.vocabulary.get(w, 0) for w in names], np.int64)
    start = word_vectors(weights, rows, bucket, word)[:, [0, WORD_DIM]].sum(1)
    looks = np.where(matrix >= 0, start[matrix], -9).max(1)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    which = text[first]

    def highest() -> np.ndarray:
        """The most toxic window of each text that has one."""
        order = np.lexsort((-looks, text))
        return order[np.searchsorted(text[order], which)]

    learns = ~kept[which]
    clean_windows = np.flatnonzero(train & (toxic[text] == 0))
    adam = Adam(weights, 0.01)
    for turn in range(rounds):
        picked, label = highest()[learns], toxic[which[learns]]
        weight = np.ones(len(picked), np.float32)
        if turn:
            weight = np.where(label == 1, np.minimum(2 * _sigmoid(looks[picked]), 1) ** 2, 1).astype(np.float32)
        others = rng.choice(clean_windows, min(len(clean_windows), len(picked)), replace=False)
        at = np.concatenate([picked, others])
        target = np.concatenate([label, np.zeros(len(others), np.float32)])
        count = np.concatenate([weight, np.ones(len(others), np.float32)])
        for _ in range(passes * max(1, 2_000 // len(at))):
            order = rng.permutation(len(at))
            for i in range(0, len(order), 128):
                part = order[i : i + 128]
                some, local = np.unique(matrix[at[part]], return_inverse=True)
                local = local.reshape(len(part), -1) - int(some[0] < 0)
                some = some[some >= 0]
                run, owner = runs_of(some)
                row = np.where(rng.random(len(some)) < 0.2, 0, rows[some])  # at times a word must be known by its characters
                vectors = word_vectors(weights, row, run, owner)
                predicted, notes = forward(weights, vectors, local, keep=True)
                error = ((_sigmoid(predicted) - target[part]) * count[part] / len(part)).astype(np.float32)
                gradients, d_vectors = backward(weights, vectors, notes, error)
                gradients["word"], gradients["char"] = np.zeros_like(weights["word"]), np.zeros_like(weights["char"])
                np.add.at(gradients["word"], row, d_vectors[:, :WORD_DIM])
                scaled = d_vectors[:, WORD_DIM:] / np.sqrt(np.maximum(n_runs[some], 1))[:, None]
                for k in range(CHAR_DIM):
                    gradients["char"][:, k] = np.bincount(run, scaled[owner, k], BUCKETS)
                for k in gradients:
                    gradients[k] = gradients[k] + np.float32(1e-4) * weights[k]
                adam.step(weights, gradients)
        looks = net.window_odds(word_vectors(weights, rows, bucket, word), matrix)
    use = kept[which] if len({*toxic[which[kept[which]]]}) == 2 else np.ones(len(which), bool)
    x, y = looks[highest()][use].astype(float), toxic[which][use].astype(float)
    share = {1: base, 0: 1 - base} if 0 < base < 1 else {1: y.mean(), 0: 1 - y.mean()}
    each = np.where(y == 1, share[1] / y.mean(), share[0] / (1 - y.mean())) if 0 < y.mean() < 1 else np.ones(len(y))
    net.scale, net.shift = calibrated(x, y, each)
    return net


def learn_net(
    df: DataFrame, labels: DataFrame, use: Column, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", sample_docs: int = SAMPLE_DOCS,
) -> ToxicNet:
    """Train on the documents where ``use`` is true that have a label."""
    marks = labels.where(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("_id"))
    marks = marks.agg(F.max(label_column).alias("toxic"))
    text = F.col(text_column)
    rows = df.where(use & text.isNotNull()).select(F.col(id_column).alias("_id"), text.alias("_text"))
    seen = settle(rows.select("_id", F.xxhash64("_text").alias("h"), F.char_length("_text").alias("size")).join(marks, "_id"))
    shares = {r["toxic"]: r for r in seen.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(F.col("size") <= SAMPLE_CHARS, F.col("h"))).alias("texts")).collect()}
    total = sum(r["n"] for r in shares.values())
    base = shares[1]["n"] / total if 1 in shares else 0.0
    # hashes are spread evenly: about twice the sample passes the threshold of each class, the smallest stay
    limit = F.lit(False)
    for label, r in shares.items():
        share = min(1.0, 2 * sample_docs / max(1, r["texts"]))
        limit = F.when(F.col("toxic") == label, F.col("h") <= min(int(share * 2**64) - 2**63, 2**63 - 1)).otherwise(limit)
    passed = seen.where(limit & (F.col("size") <= SAMPLE_CHARS)).groupBy("h").agg(F.max("toxic").alias("toxic")).collect()
    chosen = []
    for label in (0, 1):
        chosen += sorted((r["h"], r["toxic"]) for r in passed if r["toxic"] == label)[:sample_docs]
    picked = df.sparkSession.createDataFrame(chosen, "h long, toxic int")
    # at most twice the sample's numbers; so the texts stay where they are
    sample = rows.select(F.xxhash64("_text").alias("h"), "_text").join(F.broadcast(picked), "h").distinct().collect()
    sample.sort(key=lambda r: (r["toxic"], r["h"], r["_text"]))
    return fit_net([r["_text"] for r in sample], np.array([r["toxic"] for r in sample]), base)


def score_texts(df: DataFrame, net: ToxicNet, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``score`` (0 to 1) of every row."""
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in small_slices(batches, size=TEXT_SLICE):
            scores = net.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_column)
