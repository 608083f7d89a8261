"""Mixing sources to target weights: a token budget runs down a domain-language-source tree.

Every node has a whole-number weight among its siblings. A node's budget is shared among its children in proportion to
their weights, but no child gets more than the tokens below it times ``max_epochs``; what a full child can't take goes to
its siblings that can, and only what none of them can take is given back to the parent's siblings. As a node's capacity is
the sum of its leaves', filling from the top with subtree capacities does this in one pass per level: children sorted by
capacity per weight, the full ones are a prefix of that order. All in whole numbers, so at most a token per node is left out.

A leaf takes its budget from epochs, each a permutation of its documents by an md5 of seed, epoch and id: all of the full
epochs, and of the last the longest prefix of documents whose tokens fit. The prefix is found without sorting a leaf: tokens
are summed per range of the hash, the ranges are summed up in order, and only the documents of the one range where the
budget ends are ordered.

Tokens are words here, unless ``tokens`` gives another count. Documents without tokens are never chosen. Null languages,
sources and ids count as empty text. Rows with equal id share their place in the permutation and are chosen together, or not
at all. The tree is known to the user, so its node table is small, but it too is only handled by Spark. Rows come out with
all their columns, whatever their names. Of a text, however long, only the number of tokens is kept while documents are chosen. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import settle

#: Documents of a leaf per range of the hash, about.
RANGE_DOCS = 500
TREE = ["domain", "lang", "source"]


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("bigint")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("bigint")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(known[F.col(level)], F.lit(1)).cast("bigint")


def _fill(nodes: DataFrame, parents: list[str], level: str, weights: Mapping[str, int]) -> DataFrame:
    """Give each child of ``parents`` its share of ``budget`` (same on all children), at most its ``capacity``."""
    nodes = nodes.withColumn("weight", _weight(level, weights))
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), level)
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parents)
    total = F.sum("weight").over(every)
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weight_left = total - F.coalesce(F.sum("weight").over(before), F.lit(0))
    nodes = nodes.withColumn("total", total)
    nodes = nodes.withColumn("full", F.col("capacity") * weight_left <= F.col("weight") * (F.col("budget") - taken))
    full_capacity = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(every)
    full_weight = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every)
    nodes = nodes.withColumns({"rest": F.col("budget") - full_capacity, "rest_weight": F.col("total") - full_weight})
    share = F.expr("CASE WHEN full THEN capacity ELSE weight * rest DIV rest_weight END")
    return nodes.select(*parents, level, share.alias("budget"))


def leaf_budgets(
    leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int
) -> DataFrame:
    """``budget`` tokens for every leaf, from leaves with ``tokens``; ``weights`` by level, 1 where it has none."""
    sums = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    whole = sums.agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    whole = whole.select(F.least(budget, F.col("capacity")).cast("bigint").alias("budget"))
    shares: DataFrame | None = None
    for depth, level in enumerate(TREE):
        parents = TREE[:depth]
        nodes = sums.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("budget", whole.scalar()) if shares is None else nodes.join(shares, parents)
        shares = _fill(nodes, parents, level, weights.get(level, {}))
    return leaves.join(shares, TREE)


def mix(
    df: DataFrame, domain: Column, budget: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int = 2, seed: int = 0,
    tokens: Column | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    source_column: str = "source", range_docs: int = RANGE_DOCS,
) -> DataFrame:
    """``row`` (the input row as a struct), the tree columns, ``n_tokens`` and ``epochs`` (1 or more) of chosen rows.

    ``budget`` is an expression over ``tokens``, the number of all tokens.
    """
    text = F.lit("")
    rows = df.select(
        F.struct("*").alias("row"),
        F.coalesce(domain, text).alias("domain"), F.coalesce(F.col(lang_column), text).alias("lang"),
        F.coalesce(F.col(source_column), text).alias("source"),
        F.coalesce(F.col(id_column).cast("string"), text).alias("id"),
        F.coalesce(word_count(F.col(text_column)) if tokens is None else tokens, F.lit(0)).cast("bigint").alias("n_tokens"),
    )
    # the texts are read twice, for this and for the rows that come out
    counted = settle(rows.select(*TREE, "id", "n_tokens").where("n_tokens > 0"))
    leaves = counted.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = leaf_budgets(leaves, budget, weights, max_epochs).select(
        *TREE, F.expr("budget DIV tokens").alias("whole"), F.expr("budget % tokens").alias("left"),
        F.ceil(F.col("docs") / range_docs).alias("ranges"),
    )
    plan = settle(plan)

    key = order_key(seed, F.col("whole"), F.col("id"))
    place = F.floor(F.conv(F.substr("key", F.lit(1), F.lit(8)), 16, 10).cast("bigint") * F.col("ranges") / 2**32)
    keyed = counted.join(plan, TREE).withColumn("key", key).withColumn("range", place)
    per_range = keyed.groupBy(*TREE, "left", "range").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*TREE).orderBy("range"))
    ends = per_range.withColumn("upto", upto).where("upto > left").groupBy(*TREE).agg(
        F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("end")
    )
    ends = ends.select(*TREE, F.col("end.range").alias("end_range"), F.col("end.before").alias("before"))
    last = keyed.join(ends, TREE).where("range = end_range").groupBy(*TREE, "left", "before", "key")
    within = F.col("before") + F.sum("n").over(Window.partitionBy(*TREE).orderBy("key"))
    fits = last.agg(F.sum("n_tokens").alias("n")).withColumn("upto", within).where("upto <= left")
    cuts = fits.groupBy(*TREE).agg(F.max("key").alias("last_key"))
    plan = settle(plan.join(ends.drop("before"), TREE, "left").join(cuts, TREE, "left"))

    chosen = rows.where("n_tokens > 0").join(plan, TREE).withColumn("key", key).withColumn("range", place)
    partly = (F.col("range") < F.col("end_range")) | (
        (F.col("range") == F.col("end_range")) & F.coalesce(F.col("key") <= F.col("last_key"), F.lit(False))
    )
    epochs = (F.col("whole") + F.when(partly, 1).otherwise(0)).cast("bigint")
    return chosen.select("row", *TREE, "n_tokens", epochs.alias("epochs")).where("epochs > 0")


def repeated(mixed: DataFrame) -> DataFrame:
    """The chosen rows as they were, once for each epoch."""
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("epochs")))).select("row.*")
