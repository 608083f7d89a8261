"""Token counts of whole texts; huge texts are counted over overlapping chunks that are brought back into step.

A text longer than ``chunk`` characters is encoded chunk by chunk with offsets. Neighbouring chunks share ``overlap``
characters. They are spliced at a boundary in the overlap that is proven stable (see ``word_encoder``) and from which
both encodings agree up to the last such boundary; tokens before it are counted in the left chunk, the rest in the right.
Where there is none, as in text without white space, the overlap is doubled, and when it has reached the whole left
chunk, that chunk grows. Memory holds one chunk's tokens.

Null texts count as empty. Every row of the input gives one row, repeated and null ids included; other columns, whatever
their names, are left aside. Nothing is ranked, so there are no ties; equal texts have equal counts. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import shipped, small_slices, text_or_empty, unpacked
from dockflow.llm.word_encoder import Placed, WordEncoder

CHUNK = 16_384
OVERLAP = 256


def _splice(left: Placed, right: Placed, begin: int) -> int | None:
    """A stable boundary after ``begin``, in the part that both encodings hold, from which they agree; else none.

    They must agree up to the last word of the left one, which may have been cut.
    """
    a, b = (int(np.flatnonzero(x.stable & (x.starts > begin))[:1].sum()) for x in (left, right))
    last = np.flatnonzero(left.stable)[-1:].sum()
    n = int(last) - a
    if n <= 0 or not left.stable[a] or left.starts[a] <= begin or len(right.starts) < b + n:
        return None
    same = (left.starts[a:last] == right.starts[b : b + n]).all() and left.ids[a:last] == right.ids[b : b + n]
    return int(left.starts[a]) if same else None


def _tokens(encoding: Placed, begin: int, end: int | None = None) -> int:
    """Number of tokens of the words that start in the range."""
    a = encoding.starts.searchsorted(begin)
    b = len(encoding.starts) if end is None else encoding.starts.searchsorted(end)
    return sum(map(len, encoding.ids[a:b])) // 4


def count_long(encoder: WordEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of one long text."""
    total, taken, begin, end = 0, 0, 0, min(chunk, len(text))
    left = encoder.placed(text, begin, end)
    while end < len(text):
        width, longer, at = overlap, chunk, None
        while at is None and end < len(text):
            after = end - width
            if after <= max(begin, taken):  # no boundary in the whole chunk: a longer one
                end = min(end + longer, len(text))
                left = encoder.placed(text, begin, end)
                width, longer = overlap, 2 * longer
                continue
            until = min(end + chunk, len(text))
            right = encoder.placed(text, after, until)
            at = _splice(left, right, after)
            width *= 2
        if at is not None:
            total += _tokens(left, taken, at)
            begin, end, left, taken = after, until, right, at
    return total + _tokens(left, taken)


def count_tokens(
    df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``id_column``, ``n_bytes`` and ``n_tokens`` of every row; ``vocabulary`` is the path of a tokenizers file."""
    encoder = shipped(df.sparkSession, WordEncoder.from_file(vocabulary))
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def count(batches):
        tool = unpacked(encoder)
        for batch in small_slices(batches):
            texts = text_or_empty(batch.column(1))
            short = [t if len(t) <= chunk else "" for t in texts]
            tokens = [len(ids) // 4 for ids in tool.encode_texts(short)]
            for i, text in enumerate(texts):
                if len(text) > chunk:
                    tokens[i] = count_long(tool, text, chunk, overlap)
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            counts = [batch.column(0), n_bytes, pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(counts, ["id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_column)
