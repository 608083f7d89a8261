"""From raw documents to token ids: quality, host rules, near duplicates, mixing, BPE.

Each stage takes all that its predecessor kept, written as Parquet to the checkpoint folder and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm import bpe_codec, host_rules, line_quality, mixing, shingle_join
from dockflow.llm.queries import GOOD, MIX_SEED, MIX_WEIGHTS, mix_budget, mix_domain, vocabulary
from dockflow.llm.shared import held_out, table
from dockflow.session import scratch_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those that the line field scores as good; it learns from labelled documents that aren't held out."""
    field = line_quality.learn_field(docs, table(spark, sf_dir, "labels"), ~held_out())
    return line_quality.keep_good(docs, field, GOOD)


def by_host_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those that pass the base rules and come from hosts that mostly do."""
    return host_rules.keep_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates, and all texts without words."""
    return shingle_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each epoch that takes them."""
    chosen = mixing.mix(docs, mix_domain(), mix_budget(), MIX_WEIGHTS, seed=MIX_SEED)
    return mixing.repeated(chosen)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the digest of the decoded text."""
    coded = bpe_codec.encode_decode(docs, vocabulary())
    return coded.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


STAGES = [
    ("quality_classifier", good_documents),
    ("quality_rules", by_host_rules),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", token_ids),
]

#: SQL can express neither the classifier nor BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
