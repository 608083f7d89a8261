"""Language of a text by compression: the language whose sample helps Zstandard most.

For each language a bounded sample of labelled texts, lower-cased, is the raw-content dictionary. A text is lower-cased,
cut into pieces of ``piece`` bytes (all of them) and every piece is compressed with each dictionary; the smallest sum wins,
ties going to the language with more labelled texts, then by name. ``score`` is the winner's share when every byte saved
counts as a factor: 2 ** (-bytes / ``scale``), normalised over the languages. Where the runner-up is within ``margin`` of
the winner, the row is marked ``rejected``.

The sample: per language the ``sample_texts`` distinct texts with the smallest hash, of each ``sample_bytes`` characters in a row from
a place anywhere in the text that another hash names. That is all the driver sees. Texts that are null or hold no letter (no character
of Unicode category L) get ``und``, score 0, and are rejected; very long ones are compressed whole, piece by piece. Every input row
gives one row, with repeated and null ids; other columns, whatever their names, are left aside. Without
labelled texts all is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.llm.shared import shipped, small_slices, unpacked

SAMPLE_TEXTS = 64
SAMPLE_BYTES = 1_500
PIECE = 4_096
LEVEL = 3
SCALE = 8.0
MARGIN = 0.01
UNKNOWN = "und"


class Languages:
    """The dictionaries; compressors are made once per Python worker."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL):
        self.dictionaries, self.level, self._made = dictionaries, level, None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "level": self.level, "_made": None}

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.dictionaries]

    @property
    def compressors(self) -> list:
        if self._made is None:
            import zstandard

            self._made = []
            for _, content in self.dictionaries:
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=self.level)
                self._made.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False))
        return self._made

    def sizes(self, text: str, piece: int = PIECE) -> np.ndarray:
        """Compressed bytes of the whole text with each dictionary."""
        data = text.lower().encode()
        pieces = [data[i : i + piece] for i in range(0, len(data), piece)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors], dtype=float)


def learn_languages(
    df: DataFrame, use: Column, text_column: str = "text", lang_column: str = "lang", sample_texts: int = SAMPLE_TEXTS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Languages:
    """Dictionaries from the rows where ``use`` is true that have a text with a letter and a language."""
    rows = df.where(use).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64("text")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(order).alias("texts")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return Languages([])
    sample: dict[str, list[str]] = {}

    def take(near):
        places = F.greatest(F.char_length("text") - sample_bytes, F.lit(0)) + 1
        start = F.pmod(F.xxhash64("text", F.lit("place")), places).cast("int") + 1
        near = near.select("lang", order.alias("h"), F.substr("text", start, F.lit(sample_bytes)).alias("text"))
        ranked = near.distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
        for row in ranked.where(F.col("k") <= sample_texts).orderBy("lang", "k").collect():
            sample.setdefault(row["lang"], []).append(row["text"])

    # four times what is wanted of the distinct texts passes a threshold on the hash, so that no language's texts have to be sorted
    shares = {r["lang"]: min(1.0, 4 * sample_texts / max(r["texts"], 1)) for r in found}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    take(rows.where((F.shiftrightunsigned(order, 11) / 2.0**53 < share[F.col("lang")]) | (share[F.col("lang")] >= 1.0)))
    short = [lang for lang, passed in shares.items() if passed < 1.0 and len(sample.get(lang, [])) < sample_texts]
    if short:  # too few have passed: once more from all texts
        for lang in short:
            sample.pop(lang, None)
        take(rows.where(F.col("lang").isin(short)))
    names = sorted(sample, key=lambda name: (-counts[name], name))
    return Languages([(name, "\n".join(sample[name]).lower().encode()) for name in names])


def predict_languages(
    df: DataFrame, languages: Languages, id_column: str = "doc_id", text_column: str = "text", margin: float = MARGIN,
    scale: float = SCALE, piece: int = PIECE,
) -> DataFrame:
    """``id_column``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` of every row."""
    shared = shipped(df.sparkSession, languages)
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def predict(batches):
        known = unpacked(shared)
        for batch in small_slices(batches):
            found = []
            for text in batch.column(1).to_pylist():
                if not text or not known.names or not any(map(str.isalpha, text)):
                    found.append((UNKNOWN, 0.0, True))
                    continue
                sizes = known.sizes(text, piece)
                best = int(np.argmin(sizes))
                odds = np.exp2(-(sizes - sizes[best]) / scale)
                others = np.delete(sizes, best)
                narrow = len(others) > 0 and others.min() - sizes[best] < margin * sizes[best]
                found.append((known.names[best], float(1 / odds.sum()), bool(narrow)))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "lang_pred", "score", "rejected"])

    schema = f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(predict, schema).withColumnRenamed("id", id_column)
