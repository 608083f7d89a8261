"""Spelling variants: frequent words one code point apart, grouped under the form that is written most.

Words are the maximal runs of Latin letters (``[A-Za-z`` and U+00C0 to U+00FF ``]+``) with A-Z lower-cased. A fixed rule adds
slips of the pen: where 199 divides the crc32 of ``<doc_id>:<run>``, the run loses the code point at crc32 modulo its length.
Results of ``least_length`` code points and ``least_count`` occurrences are the vocabulary. Two words are near if one inserted,
deleted or replaced code point makes one of the other.

Near words are found with FM-index search schemes. Of two near words, the shorter with m code points, the error lies in the
left or in the right half, so the other half matches exactly. The vocabulary is dealt by these halves: a word goes to the
group of its left half and to that of its right half, as the shorter and as the longer word of a pair. Groups are gathered in
shards of bounded size. A shard holds two FM-indexes of its delimited words, one read to the right and one to the left; a query
narrows the interval of suffix ranks over its exact half and then extends it across the other half, allowing one error, to
the delimiter. Each word looks for those of its length and for those one longer; the shorter reports both ways.

Where one half is so common that its group exceeds ``cap`` words, the window that may hold the error is halved again: either the
half and the near quarter match, or the half and the far quarter, and so on down to one place, where the alphabet bounds the
group. Nothing is dropped. The longest way from a word to its root is bounded by the counts, each form being written at least
``ratio`` times as often, so roots are found in that many halvings of the way.

Null and empty texts have no words; a null id counts as the empty text before the colon. Texts are taken apart in slices, whatever
their length. Every row counts, repeated ones and null ids included. Among near words of equal count the smallest in code-point
order is the form. An empty table gives an empty result. Other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import small_slices
from dockflow.session import settle

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: One run in so many loses a code point.
SLIPS = 199
#: Entries of a shard, words that may share an exact part, and queries that are searched at once.
SHARD = 20_000
CAP = 20_000
QUERIES = 4_000
#: Different words that a task counts before it passes them on, and bytes of text that are taken apart at once.
HELD_WORDS = 100_000
TEXT_SLICE = 1 << 20
_KEYS = ["m", "lo", "hi", "pre", "suf"]

#: Per byte of Latin-1: a letter, with A-Z lower-cased, or a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def written(doc_id: str, text: str, least: int = LEAST_LENGTH, slips: int = SLIPS, size: int = TEXT_SLICE) -> Counter:
    """Counts of a document's words of ``least`` code points or more, in Latin-1, after the slips."""
    data = text.encode("latin-1", "replace").translate(_TABLE)  # what Latin-1 lacks becomes a question mark, then a space
    before = crc32(f"{doc_id}:".encode())
    words: Counter = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size)
        end = len(data) if end < 0 else end
        for run, n in Counter(data[start:end].split()).items():
            if len(run) < least:
                continue
            h = crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
            if h % slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            words[run] += n
        start = end
    return words


def word_counts(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word`` and ``n`` of the vocabulary."""
    rows = df.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )

    def run(batches):
        held: Counter = Counter()

        def out():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in small_slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(written(i, text.as_py(), least_length))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


class FmIndex:
    """FM-index of words, each with its own delimiter, that is extended to the right.

    It indexes the words read backwards, so a step to the right prepends a letter there. ``keys`` holds (letter, row) of the
    Burrows-Wheeler transform in order; the place of (c, row) in it is both the rank of c before that row and the row's new rank
    after the step, as the letters before c in the text and in the transform are the same.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``codes``: letters (1 and up) of the words one after the other, each closed by 0 at ``ends``."""
        n = len(codes)
        starts = np.concatenate([[0], ends[:-1] + 1])
        word = np.repeat(np.arange(len(ends)), ends - starts + 1)
        place = np.arange(n)
        # read backwards: letters reversed in front of the delimiter
        text = codes[np.where(codes == 0, place, starts[word] + ends[word] - 1 - place)]
        left = ends[word] - place + 1  # letters to the end of the word, the delimiter included
        rank = np.zeros(n, np.int64)
        for k in range(6):
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = text[k:]
            rank = rank * 256 + np.where(left > k, shifted, 0)
        width, longest = 6, int(left.max(initial=0))
        while True:
            order = np.argsort(rank, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.diff(rank[order], prepend=rank[order[:1]]) > 0) + 1
            if width >= longest:
                break
            after = np.zeros(n, np.int64)
            after[: n - width] = new[width:]
            rank = new * (n + 2) + np.where(left > width, after, 0)
            width *= 2
        self.n = n
        self.size = int(codes.max(initial=0)) + 1
        self.transform = np.where(order == starts[word[order]], 0, text[order - 1])
        by_letter = np.argsort(self.transform, kind="stable")
        self.keys = self.transform[by_letter] * (n + 1) + by_letter
        self.word = word[order]

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffix ranks after one more letter."""
        at = letter * (self.n + 1)
        return np.searchsorted(self.keys, at + low), np.searchsorted(self.keys, at + high)

    def start(self) -> int:
        """End of the interval of the delimiters, before any letter."""
        return int(np.searchsorted(self.keys, self.n + 1))

    def letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letters that go on from each interval: index of the interval and letter, in this order, each pair once."""
        size = high - low
        wide = size > self.size
        few = np.flatnonzero(~wide)
        total = size[few]
        row = np.repeat(low[few] - np.cumsum(total) + total, total) + np.arange(total.sum())
        pair = np.unique(np.repeat(few, total) * self.size + self.transform[row])
        all_of = (np.flatnonzero(wide)[:, None] * self.size + np.arange(1, self.size)).ravel()
        pair = np.sort(np.concatenate([pair, all_of]))
        pair = pair[pair % self.size > 0]
        return pair // self.size, pair % self.size

    def complete(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word that ends in each interval, -1 where none does."""
        first, last = self.step(np.zeros(len(low), np.int64), low, high)
        ended = first < last
        out = np.full(len(low), -1, np.int64)
        out[ended] = self.word[self.keys[first[ended]]]
        return out


def one_error(index: FmIndex, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Matches of patterns with one replaced or one inserted letter in lo..hi and everything else exact: (pattern, word) pairs."""
    count = len(starts)
    low, high = np.zeros(count, np.int64), np.full(count, index.start(), np.int64)
    exact = np.arange(count)
    empty = np.zeros(0, np.int64)
    q, a, b = empty, empty, empty  # states after their error, all at the same place of their pattern
    later = (empty, empty, empty)
    found = []
    for t in range(int(lengths.max(initial=-1)) + 1):
        q, a, b = (np.concatenate(x) for x in zip((q, a, b), later))
        open_ = exact[lo[exact] <= t]
        if len(open_):
            spans, which = np.unique(np.stack([low[open_], high[open_]], 1), axis=0, return_inverse=True)
            span, letter = index.letters(spans[:, 0], spans[:, 1])
            first, last = index.step(letter, spans[span, 0], spans[span, 1])
            many = np.bincount(span, minlength=len(spans))
            begin = np.cumsum(many) - many
            which = which.ravel()
            n = many[which]
            branch = np.repeat(begin[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
            who = np.repeat(open_, n)
            inside = t < lengths[who]
            wanted = np.where(inside, codes[np.minimum(starts[who] + t, len(codes) - 1)], 0)
            same = letter[branch] == wanted
            # the same letter put in before itself is put in after itself as well
            put = ~(same & (t < hi[who]))
            swap = ~same & inside & (t < hi[who])
            q, a, b = (np.concatenate([x, y[put]]) for x, y in ((q, who), (a, first[branch]), (b, last[branch])))
            later = who[swap], first[branch][swap], last[branch][swap]
        else:
            later = (empty, empty, empty)
        done = lengths[q] == t
        if done.any():
            word = index.complete(a[done], b[done])
            found.append(np.stack([q[done], word], 1)[word >= 0])
        go = ~done
        q, a, b = q[go], a[go], b[go]
        a, b = index.step(codes[starts[q] + t], a, b)
        alive = a < b
        q, a, b = q[alive], a[alive], b[alive]
        exact = exact[hi[exact] > t]
        low[exact], high[exact] = index.step(codes[starts[exact] + t], low[exact], high[exact])
        exact = exact[low[exact] < high[exact]]
        if not (len(exact) or len(q) or len(later[0])):
            break
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as small numbers, each word closed by 0, and the places of the zeros."""
    raw = np.frombuffer("\0".join([*words, ""]).encode("latin-1"), np.uint8)
    known = np.unique(raw)
    return np.searchsorted(known, raw), np.flatnonzero(raw == 0)


def _search(words: list[str], length: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Pairs of entries (shorter or equal, other) whose exact part lies to the left of the error."""
    names, at = np.unique(np.array(words, object), return_inverse=True)
    if not len(names):
        return np.zeros((0, 2), np.int64)
    codes, ends = _letters(list(names))
    starts = np.concatenate([[0], ends[:-1] + 1])
    index = FmIndex(codes, ends)
    ask = np.flatnonzero(length == m)
    first = np.zeros(len(names), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    out = []
    for i in range(0, len(ask), QUERIES):
        part = ask[i : i + QUERIES]
        pairs = one_error(index, codes, starts[at[part]], length[part], lo[part], hi[part])
        out.append(np.stack([part[pairs[:, 0]], first[pairs[:, 1]]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def near_in_shard(words: list[str], m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Near pairs among the entries of a shard, as entry numbers both ways; pairs may come more than once."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    right = lo >= m - hi
    out = [np.zeros((0, 2), np.int64)]
    for side, flip in ((right, False), (~right, True)):
        at = np.flatnonzero(side)
        some = [words[i][::-1] if flip else words[i] for i in at]
        a, b = (m[at] - hi[at], m[at] - lo[at]) if flip else (lo[at], hi[at])
        out.append(at[_search(some, length[at], m[at], a, b)])
    pairs = np.concatenate(out)
    longer = length[pairs[:, 0]] != length[pairs[:, 1]]
    return np.concatenate([pairs, pairs[longer][:, ::-1]])


def _entries(vocabulary: DataFrame, least: int) -> DataFrame:
    """Each word once per length of the shorter word of a pair and per window of the error, with its exact parts."""
    size = "char_length(word)"
    windows = [f"named_struct('m', {m}, 'lo', {lo}, 'hi', {hi})" for m in (size, f"{size} - 1")
               for lo, hi in (("0", f"({m}) div 2"), (f"({m}) div 2", m))]
    places = F.expr(f"inline(filter(array({', '.join(windows)}), w -> w.m >= {least}))")
    return _with_parts(vocabulary.select("word", "n", places))


def _with_parts(windows: DataFrame) -> DataFrame:
    return windows.selectExpr(
        "word", "n", "cast(m as int) m", "cast(lo as int) lo", "cast(hi as int) hi", "substring(word, 1, int(lo)) pre",
        "right(word, int(m - hi)) suf",
    )


def _divided(entries: DataFrame, cap: int) -> DataFrame:
    """Halve the windows of groups with more than ``cap`` words, until none is left or a window has one place."""
    while True:
        hot = entries.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > cap) & (F.col("hi") - F.col("lo") > 1))
        hot = settle(hot.select(*_KEYS, F.lit(True).alias("hot")))
        if hot.isEmpty():
            return entries
        marked = entries.join(hot, _KEYS, "left")
        middle = "(lo + hi) div 2"
        halves = F.expr(
            f"inline(if(hot, array(named_struct('a', lo, 'b', int({middle})), named_struct('a', int({middle}), 'b', hi)), "
            "array(named_struct('a', lo, 'b', hi))))"
        )
        entries = settle(_with_parts(marked.select("word", "n", "m", halves).withColumnsRenamed({"a": "lo", "b": "hi"})))


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, cap: int = CAP, shard: int = SHARD) -> DataFrame:
    """``word``, ``n``, ``near`` and ``near_n`` of all near words; ``vocabulary`` has distinct words and their counts."""
    entries = _divided(_entries(vocabulary, least_length), cap)
    n_shards = max(1, -(-4 * vocabulary.count() // shard))
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64(*_KEYS), F.lit(n_shards))).drop("pre", "suf")

    def run(table: pa.Table) -> pa.Table:
        words = table.column("word").to_pylist()
        m, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi"))
        pairs = near_in_shard(words, m, lo, hi)
        own, other = (table.select(["word", "n"]).take(pa.array(side)) for side in pairs.T)
        return pa.table([*own.columns, *other.columns], ["word", "n", "near", "near_n"])

    found = dealt.repartition(n_shards, "shard").groupBy("shard").applyInArrow(run, "word string, n long, near string, near_n long")
    return found.repartition("word").distinct()


def group_variants(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, ratio: int = RATIO, cap: int = CAP, shard: int = SHARD,
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of the vocabulary."""
    vocabulary = settle(word_counts(df, id_column, text_column, least_length, least_count))
    best = near_words(vocabulary, least_length, cap, shard).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    )
    taken = -F.col("best.n") >= ratio * F.col("n")
    best = settle(best.select("word", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n")))
    ways = best.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # a way has at most so many forms, as each is written ``ratio`` times as often; every round doubles what is walked
    most = vocabulary.agg(F.max("n")).first()[0] or least_count
    steps = max(1, math.floor(math.log(max(most / least_count, 1), ratio) + 1e-9))
    for _ in range(math.ceil(math.log2(steps))):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = settle(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    out = vocabulary.join(best, "word", "left").join(ways, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
