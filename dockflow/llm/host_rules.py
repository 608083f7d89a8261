"""Quality rules on documents, and verdicts on whole hosts from them.

Every document is counted and tested against base rules. Failures are aggregated per host; a host's failure rate is
shrunk towards the mean of all hosts with a beta prior whose strength is fitted to the spread between hosts (method of
moments, sampling noise taken off), so that hosts with few documents are judged mildly. Documents of a host whose shrunk
rate exceeds ``limit`` are not kept.

Everything is DataFrame operations. The texts are read once: what is counted is written to the checkpoint folder and read
from there. A host with a third of all documents is summed before its shuffle, and the join back carries no text. Only
``keep_documents``, which returns whole rows, measures them a second time instead of writing a copy of them.

Null texts have no words. A null host has no host verdict, so only the base rules decide. Every input row gives one row,
with repeated and null ids; other columns, whatever their names, are left aside. Whole texts are measured, however long; windows
of words are told apart by a 64-bit hash, so two different ones count as the same once in 2 ** 64 pairs. Nothing is ranked, so
there are no ties. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.session import settle

_SPACE = "[\\x20\\x09-\\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Shrunk failure rate above which a host's documents go.
LIMIT = 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_TRIM))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def with_measures(df: DataFrame, text_column: str) -> DataFrame:
    """``row`` (all columns as a struct) and the measures of its text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), text.alias("text"), _words(text).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    window = F.transform(
        F.sequence(F.lit(0), F.col("n") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
    )
    rows = rows.withColumn("windows", F.when(F.col("n") > WINDOW, window))
    # most texts repeat nothing: only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("sorted", F.when(repeats, F.array_sort(placed)))
    ordered = F.col("sorted")
    twice = F.filter(
        ordered,
        lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]),
    )
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b,
    )
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_TRIM)) != "")
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "row",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    too_short = F.col("n_words") < MIN_WORDS
    return too_short | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host_column: str = "host", limit: float = LIMIT) -> DataFrame:
    """Per host: documents, failures, the shrunk rate and ``host_kept``, from rows with ``base_failed``."""
    hosts = (
        judged.where(F.col(host_column).isNotNull()).groupBy(F.col(host_column).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    spread = hosts.agg(
        F.avg(rate).alias("mean"), F.var_pop(rate).alias("variance"), F.avg(1 / F.col("n_docs")).alias("noise")
    )
    mean = spread.select("mean").scalar()
    even = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("variance") - even * F.col("noise"), F.lit(0.0))
    # equal hosts beyond noise: the prior weighs as much as it can
    strength = F.when(between <= 0, 1e9).otherwise(F.greatest(even / between - 1, F.lit(0.0)))
    weight = spread.select(strength.alias("strength")).scalar()
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= limit)


def judge_documents(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", limit: float = LIMIT,
) -> DataFrame:
    """``id_column``, the measures, ``base_failed``, ``host_rate`` and ``kept`` of every document."""
    slim = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(host_column).alias("host"))
    counted = with_measures(slim, "text").select("row.id", "row.host", *MEASURES)
    judged = settle(counted.withColumn("base_failed", base_failed()))
    hosts = host_verdicts(judged, "host", limit).select("host", "host_rate", "host_kept")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return judged.join(hosts, "host", "left").select(
        F.col("id").alias(id_column), *MEASURES, "base_failed", "host_rate", kept.alias("kept")
    )


def keep_documents(
    df: DataFrame, text_column: str = "text", host_column: str = "source", limit: float = LIMIT
) -> DataFrame:
    """The rows of ``df``, all columns as they are, that ``judge_documents`` keeps."""
    judged = with_measures(df, text_column).select("row", base_failed().alias("base_failed"))
    host = F.col("row").getField(host_column)
    hosts = host_verdicts(settle(judged.select(host.alias("host"), "base_failed")), "host", limit)
    dropped = settle(hosts.where(~F.col("host_kept")).select("host", F.lit(True).alias("dropped")))
    # one test of both sides stays behind the join: Spark would work out the measures many times over in a filter of their own
    joined = judged.join(dropped, host == dropped["host"], "left")
    return joined.where(~F.coalesce("dropped", "base_failed")).select("row.*")
