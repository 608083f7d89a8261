"""Ranked lexical search: the best documents for each item of a query set, all items evaluated together.

Terms are the maximal runs of characters other than the ASCII ones that are neither letters nor digits; only A-Z are
lower-cased. With N documents that hold a term, L terms in all of them and n in one, m = 100 - 50 + (50 n N) div L, a
term's weight w = floor(1000 ln((2N + 2) / (2 df + 1))) and tf its count in a document, the document's score sums
w ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, once each. The best ``top`` documents above 0 stay, equal scores
by ascending id.

Items share terms, so what they share is computed once. Pairs of terms that several items hold are mined among the items
and become a node, then pairs of nodes and terms, and so on: a graph whose nodes are sums over term sets. A task takes a
block of documents, makes the accumulator of every term that occurs (one number per document), adds them up along the graph,
each node once whatever the number of its readers, and keeps the best documents of each item. These are merged over
salted groups first, so that no item's candidates of all tasks meet in one.

Items are dealt to blocks of about ``block`` item terms, whose terms and graph travel to the tasks; each block is one pass over
the documents' postings. The item's number of terms is bounded only by its own text. Texts are read once per block of items,
in slices, whatever their length; of a text only the counts of the items' terms stay.

Null and empty texts have no terms and are never found; an item without terms has no rows. Rows of items with the same id, null
included, are one item with the terms of all. Rows of documents with the same id are documents of their own. Null document ids
come last among equals. Empty tables give an empty result. Columns besides the named ones are left aside, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dockflow.llm.shared import small_slices
from dockflow.session import settle

#: Item terms of one block of items, and terms among which shared pairs are mined at once.
BLOCK_TERMS = 50_000
SEGMENT = 32
#: Bytes of text that are taken apart at once, and bytes of accumulators that a block of documents may take.
TEXT_SLICE = 1 << 20
ACCUMULATOR_BYTES = 32 << 20
_LAST = np.iinfo(np.int64).max

#: Per byte of UTF-8: a term's byte, with A-Z lower-cased, or a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def text_slices(data: bytes, size: int = TEXT_SLICE) -> Iterator[bytes]:
    """Cut at spaces into slices of about ``size`` bytes."""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size)
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end


def count_terms(text: str | None) -> Iterator[Counter]:
    """Counts of the terms of a text, slice by slice."""
    for part in text_slices((text or "").encode().translate(_TABLE)):
        yield Counter(part.split())


def share_terms(items: list[list[int]], first: int, segment: int = SEGMENT) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Sums that several items need: ``nodes[k]``, numbered ``first + k``, adds up two earlier ones; and the parts of each item.

    The pair that most segments of items hold becomes a node, until no pair is held twice. Terms that an item has alone stay
    as they are. Long items are mined in segments of the same order, so the work grows with the number of terms.
    """
    held = Counter(t for item in items for t in item)
    owner, members = [], []
    for i, item in enumerate(items):
        shared = sorted((t for t in item if held[t] > 1), key=lambda t: (-held[t], t))
        for at in range(0, len(shared), segment):
            owner.append(i)
            members.append(set(shared[at : at + segment]))
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for s, part in enumerate(members):
        some = sorted(part)
        for x, a in enumerate(some):
            for b in some[x + 1 :]:
                where[a, b].add(s)
    heap = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
    heapq.heapify(heap)
    nodes: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        at = where[pair]
        if len(at) != -count:
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), pair))
            continue
        a, b = pair
        new = first + len(nodes)
        nodes.append(pair)
        grown = set()
        for s in list(at):
            part = members[s]
            part -= {a, b}
            for x in part:
                where[min(a, x), max(a, x)].discard(s)
                where[min(b, x), max(b, x)].discard(s)
                where[x, new].add(s)
                grown.add(x)
            part.add(new)
        at.clear()
        for x in grown:
            if len(where[x, new]) > 1:
                heapq.heappush(heap, (-len(where[x, new]), (x, new)))
    parts = [[t for t in item if held[t] == 1] for item in items]
    for i, part in zip(owner, members):
        parts[i].extend(sorted(part))
    return nodes, parts


def _item_terms(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """``item`` and ``term``, each pair once."""
    rows = items.select(F.col(item_column).alias("item"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in small_slices(batches):
            at, terms = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = {t for counts in count_terms(text) for t in counts}
                at.extend([i] * len(found))
                terms.extend(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.binary())], ["item", "term"])

    return rows.mapInArrow(run, f"item {dict(rows.dtypes)['item']}, term binary").distinct()


def _dealt(terms: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The item terms with a ``block`` of items; twice as many blocks while one with several items is far too large."""
    total = terms.count()
    n = max(1, -(-total // block))
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))
        sizes = dealt.groupBy("block", "item").agg(F.count(F.lit(1)).alias("n")).groupBy("block")
        sizes = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).where(f"n > {2 * block} AND items > 1")
        if sizes.isEmpty():
            return dealt, n
        n *= 2


def _postings(df: DataFrame, vocabulary: list[bytes], id_column: str, text_column: str) -> DataFrame:
    """Per document with a term: ``doc_id``, ``n`` terms, and the numbers (``term``) and counts (``tf``) of the items' terms in it."""
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = {t: i for i, t in enumerate(known.value)}
        lists = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in small_slices(batches):
            at, lengths, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found, n = defaultdict(int), 0
                for part in count_terms(text.as_py()):
                    n += part.total()
                    for term in part.keys() & number.keys():
                        found[number[term]] += part[term]
                if n:
                    at.append(i)
                    lengths.append(n)
                    terms.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, lists[0]),
                pa.array(counts, lists[1]),
            ], ["doc_id", "n", "term", "tf"])

    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


class _Best:
    """The best documents of one item so far."""

    def __init__(self, top: int):
        self.top, self.floor = top, 1
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def offer(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        at = np.flatnonzero(score >= self.floor)
        if not len(at):
            return
        score, doc, null = (np.concatenate([a, b[at]]) for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.top:
            self.floor = int(self.score[-1])


def accumulate(present: dict[int, np.ndarray], nodes: list[tuple[int, int]], first: int) -> dict[int, np.ndarray]:
    """Accumulators of all nodes that any document reaches, from those of the terms; each is made once."""
    for k, (a, b) in enumerate(nodes):
        x, y = present.get(a), present.get(b)
        if x is not None or y is not None:
            present[first + k] = y if x is None else x if y is None else x + y
    return present


def _scored(postings: DataFrame, graph, statistics: tuple[int, int], weights: np.ndarray, item_ids: list, kind, top: int) -> DataFrame:
    """The best documents of each item in each task."""
    context = postings.sparkSession.sparkContext
    shared = context.broadcast((graph, weights))
    n_documents, n_terms = statistics
    arrow = to_arrow_type(kind.dataType)
    names = ["item_id", "doc_id", "score"]

    def run(batches):
        (nodes, parts), weight = shared.value
        first = len(weight)
        size = max(16, ACCUMULATOR_BYTES // (8 * (first + len(nodes) + len(parts))))
        best = [_Best(top) for _ in parts]
        for whole in batches:
            for batch in (whole.slice(i, size) for i in range(0, whole.num_rows, size)):
                doc, terms, tfs = batch.column(0), batch.column(2), batch.column(3)
                null = np.asarray(doc.is_null())
                doc = np.asarray(doc.fill_null(_LAST))
                n = np.asarray(batch.column(1))
                m = 50 + (50 * n * n_documents) // n_terms
                row = np.repeat(np.arange(batch.num_rows), np.asarray(terms.value_lengths()))
                term, tf = np.asarray(terms.flatten()), np.asarray(tfs.flatten())
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                order = np.argsort(term, kind="stable")
                cuts = np.flatnonzero(np.diff(term[order], prepend=-1))
                present = {}
                for a, b in zip(cuts, [*cuts[1:], len(term)]):
                    at = order[a:b]
                    column = np.zeros(batch.num_rows, np.int64)
                    column[row[at]] = value[at]
                    present[int(term[at[0]])] = column
                accumulate(present, nodes, first)
                for item, own in zip(best, parts):
                    some = [present[p] for p in own if p in present]
                    if some:
                        item.offer(sum(some[1:], some[0]), doc, null)
        for i, item in enumerate(best):
            if len(item.doc):
                ids = pa.array([item_ids[i]] * len(item.doc), arrow)
                yield pa.RecordBatch.from_arrays([ids, pa.array(item.doc, pa.int64(), mask=item.null), pa.array(item.score)], names)

    return postings.mapInArrow(run, f"item_id {kind.dataType.simpleString()}, doc_id long, score long")


def _best(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(
    df: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", top: int = 50, block: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's best documents."""
    dealt, n_blocks = _dealt(settle(_item_terms(items, item_column, item_text_column)), block)
    kind = dealt.schema["item"]
    merged = None
    for b in range(n_blocks):
        pairs = [(r["item"], bytes(r["term"])) for r in dealt.where(F.col("block") == b).collect()]
        if not pairs:
            continue
        vocabulary = sorted({t for _, t in pairs})
        number = {t: i for i, t in enumerate(vocabulary)}
        by_item: dict = defaultdict(list)
        for item, term in pairs:
            by_item[item].append(number[term])
        item_ids = sorted(by_item, key=lambda i: (i is not None, i))
        graph = share_terms([sorted(by_item[i]) for i in item_ids], len(vocabulary))
        postings = settle(_postings(df, vocabulary, id_column, text_column))
        totals = postings.agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).first()
        if not totals["d"]:
            continue
        weights = np.full(len(vocabulary), 0, np.int64)
        for r in postings.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
            weights[r["t"]] = math.floor(1000 * math.log((2 * totals["d"] + 2) / (2 * r["df"] + 1)))
        found = _scored(postings, graph, (totals["d"], totals["n"]), weights, item_ids, kind, top)
        found = settle(_best(found.withColumn("part", F.spark_partition_id() % 64), top, "item_id", "part").drop("part", "rank"))
        merged = found if merged is None else merged.unionByName(found)
    if merged is None:
        schema = f"item_id {kind.dataType.simpleString()}, rank int, doc_id long, score long"
        return df.sparkSession.createDataFrame([], schema)
    return _best(merged, top, "item_id").select("item_id", "rank", "doc_id", "score")
