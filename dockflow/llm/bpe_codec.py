"""BPE encoding and decoding; long texts are encoded in halves that are joined by re-encoding around the joins.

A text longer than ``leaf`` characters is halved, wherever that cuts, until its parts are short; all parts are encoded
together. To join two halves, a window around the cut is encoded again. It replaces the tokens near the cut once it
agrees with the left half on a token left of the cut and with the right half on one right of it: same id, same place.
Until then the window doubles, at last to both halves.

Why that is exact: BPE tokens of a piece are right if and only if every two neighbours are what BPE makes of the two
alone, as the first merge across a boundary would show in that pair. Neighbours left of the agreed token are from the left
encoding, right of it from the window, so every pair has been seen by BPE, and the ends of pieces are part of the ids
(``</w>``), so both encodings cut pieces alike there. An agreed token must not be the first or last of an artificially
cut part, must not share a character with its neighbour, and no combining character may follow it.

Null texts count as empty and give no ids and an empty decoded text. Every input row gives one row, repeated and null ids
included; further columns are left aside whatever their names. Nothing is ranked, so there are no ties; equal texts get equal ids.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import shipped, small_slices, text_or_empty, unpacked
from dockflow.llm.word_encoder import WordEncoder

LEAF = 8_192
WINDOW = 64


def _composes(char: str) -> bool:
    """May join the character before it under NFC."""
    return unicodedata.category(char)[0] == "M" or "ᅠ" <= char <= "ᇿ"


class Half(NamedTuple):
    """An encoded part of a text: its ids, and at which token each word starts that follows white space."""

    begin: int
    end: int
    ids: np.ndarray
    places: np.ndarray
    tokens: np.ndarray


def _leaf(encoder: WordEncoder, text: str, begin: int, end: int) -> Half:
    found = encoder.placed(text, begin, end)
    tokens = np.cumsum([0, *[len(e) // 4 for e in found.ids]])[:-1]
    ids = np.frombuffer(b"".join(found.ids), dtype="<u4")
    return Half(begin, end, ids, found.starts[found.stable], tokens[found.stable])


def _with_places(encoder: WordEncoder, text: str, begin: int, end: int):
    """Ids, starts and ends of the tokens of ``text[begin:end]``."""
    made = encoder.tokenizer.encode(text[begin:end], add_special_tokens=False)
    spans = np.asarray(made.offsets, dtype="<i8").reshape(-1, 2) + begin
    return np.asarray(made.ids, dtype="<u4"), spans[:, 0], spans[:, 1]


def _agreed(text: str, half, window, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices, in the half and in the window, of equal tokens that lie strictly inside ``text[begin:end]``."""
    common, a, b = np.intersect1d(half[1], window[1], return_indices=True)
    good = (half[0][a] == window[0][b]) & (half[2][a] == window[2][b]) & (common > begin) & (half[2][a] < end)
    for x, at in ((half, a), (window, b)):  # a character of its own on both sides
        after = np.minimum(at + 1, len(x[1]) - 1)
        good &= ((at == 0) | (x[2][at - 1] <= x[1][at])) & ((after == at) | (x[1][after] >= x[2][at]))
    keep = [i for i in np.flatnonzero(good) if not _composes(text[half[2][a[i]]]) and not _composes(text[common[i]])]
    return a[keep], b[keep]


def join_halves(encoder: WordEncoder, text: str, left: Half, right: Half, window: int = WINDOW) -> Half:
    """The encoding of both halves together."""
    cut = left.end
    while True:
        lo, hi = max(left.begin, cut - window), min(right.end, cut + window)
        middle = _with_places(encoder, text, lo, hi)
        keep_left, from_middle, to_middle, keep_right = 0, 0, len(middle[0]), len(right.ids)
        found = True
        if lo > left.begin:
            k = left.places.searchsorted(lo, "right") - 1
            place, token = (left.places[k], left.tokens[k]) if k >= 0 else (left.begin, 0)
            a, b = _agreed(text, _with_places(encoder, text, int(place), cut), middle, lo, cut)
            found = len(a) > 0
            if found:
                keep_left, from_middle = int(token + a[0] + 1), int(b[0] + 1)
        if found and hi < right.end:
            k = right.places.searchsorted(hi)
            place = int(right.places[k]) if k < len(right.places) else right.end
            a, b = _agreed(text, _with_places(encoder, text, cut, place), middle, cut, hi)
            found = len(a) > 0 and b[-1] >= from_middle
            if found:
                keep_right, to_middle = int(a[-1] + 1), int(b[-1] + 1)
        if found:
            ids = np.concatenate([left.ids[:keep_left], middle[0][from_middle:to_middle], right.ids[keep_right:]])
            a, b = left.tokens < keep_left, right.tokens >= keep_right
            shift = keep_left + to_middle - from_middle - keep_right
            places = np.concatenate([left.places[a], right.places[b]])
            return Half(left.begin, right.end, ids, places, np.concatenate([left.tokens[a], right.tokens[b] + shift]))
        window *= 2


def encode_long(encoder: WordEncoder, text: str, leaf: int = LEAF, window: int = WINDOW) -> np.ndarray:
    """Ids of one long text. The library takes added tokens out first and treats what is between them alone; so here."""
    if not encoder.added:
        return _by_halves(encoder, text, leaf, window)
    contents = sorted(encoder.added, key=len, reverse=True)
    parts = re.split(f"({'|'.join(map(re.escape, contents))})", text)
    return np.concatenate(
        [[encoder.added[p]] if i % 2 else _by_halves(encoder, p, leaf, window) for i, p in enumerate(parts)]
    ).astype("<u4")


def _by_halves(encoder: WordEncoder, text: str, leaf: int, window: int) -> np.ndarray:
    """Ids of a text without added tokens by halving and joining."""
    cuts = [0, len(text)]
    while max(b - a for a, b in zip(cuts, cuts[1:])) > leaf:
        cuts = [c for a, b in zip(cuts, cuts[1:]) for c in ((a, (a + b) // 2) if b - a > leaf else (a,))] + [len(text)]
    parts = [_leaf(encoder, text, a, b) for a, b in zip(cuts, cuts[1:])]
    while len(parts) > 1:
        odd = parts[len(parts) // 2 * 2 :]
        parts = [join_halves(encoder, text, *pair, window) for pair in zip(parts[::2], parts[1::2])] + odd
    return parts[0].ids


def encode_decode(
    df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", leaf: int = LEAF,
    window: int = WINDOW, decoded: bool = True,
) -> DataFrame:
    """``id_column``, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit) and, if asked for, ``decoded``."""
    encoder = shipped(df.sparkSession, WordEncoder.from_file(vocabulary))
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches):
        tool = unpacked(encoder)
        for batch in small_slices(batches):
            texts = text_or_empty(batch.column(1))
            ids = tool.encode_texts([t if len(t) <= leaf else "" for t in texts])
            for i, text in enumerate(texts):
                if len(text) > leaf:
                    ids[i] = encode_long(tool, text, leaf, window).astype("<u4").tobytes()
            out = [batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([tool.decode(np.frombuffer(b, dtype="<u4")) for b in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "ids", "decoded"][: len(out)])

    schema = f"id {dict(rows.dtypes)['id']}, n_tokens bigint, ids binary" + (", decoded string" if decoded else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
