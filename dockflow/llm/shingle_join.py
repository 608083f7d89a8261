"""Near duplicates: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Exact, by prefixes of token combinations. Tokens are 64-bit hashes of shingles, in one order for all: that of the hash.
Two sets that link differ in at most a fifth of the smaller's tokens. So they share a token in the first fifth plus one; if
some of these occur in very many sets ("frequent": in ``RARE`` sets or more), the prefix is made longer, and frequent tokens
are not indexed alone but in pairs. Losing a fifth of the tokens can't break both all the rare ones and all the pairs: in
a group of g frequent tokens, g - 1 must be lost to break all pairs. Prefixes are cut so that rare tokens alone mostly
suffice; sets for which they don't are "heavy", and only pairs with a heavy set need be looked up by token pairs. To keep
pairs few, frequent tokens are dealt by a hash into groups of about four; their number follows the set size, in powers of
two, and a set is indexed for its own size and for that of the largest set it may link to. Two sets that nearly link share most
of their pairs, so each carries its ``LEAST`` lowest: where these show that both meet lower down, they don't meet again, and
what they share is counted once for each two sets that met, in their frequent tokens. Should a heavy set's pairs still
not suffice, it meets every set that shares a frequent token, in the first of these and seldom in another.

Only components are wanted, so near copies needn't meet all their like. First every set meets the most typical set that shares
a few of its lowest tokens; what links there is joined up. One set is typical for few of a large group, and pairs between the
parts of one component grow with the square of its size. So parts then meet in rounds: by each frequent one of its lowest tokens a
set is laid beside a few others, typical ones and others in each round, and each component meets the two larger ones to which a
sketch of any of its sets is nearest. After that only pairs of different components that share a token are counted, and kept
if the number of shared prefix tokens can still reach the threshold. That sketch is of a set's whole contents: ``SKETCH`` longs
whose bits say whether an odd number of its tokens fell on them. Two sketches differ in at most as many bits as the sets differ in
tokens, so pairs whose sketches differ in more than a ninth of both sizes can't link and are left out
where they meet; the longer the sketch, the more of the pairs that can't link it tells. All other pairs are verified on whole texts.

At scale: equal sets are one class, known by a 128-bit digest. Prefix tokens travel packed, in buckets by token whose number
follows the total. In each task, tokens of ``RARE`` sets or more go to salted buckets with a mark for the token's own one, so
a very common shingle is spread. Texts are fetched only for sets in a candidate pair, by a bit set of fixed size that
may let others through. Nothing is dropped.

Words are runs of bytes other than the six ASCII white-space characters; A-Z is lower-cased. A text of one to four words has
one shingle; texts without words, and nulls, have none, link with nothing and are their own component. Every input row
gives one row, with repeated and null ids; ``component_id`` is the smallest id that isn't null of the component.
Whole texts are read, however long, some at a time. Of equally typical sets the one with the larger key is the hub, which
only decides who meets whom first. Other columns are left aside, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.llm.graphs import connected_components
from dockflow.llm.shared import small_batches, small_slices, with_fields
from dockflow.session import passing, settle

WORDS = 5
#: Tokens of so many sets are frequent.
RARE = 32
#: Lowest tokens by which a set finds a hub.
LOW = 8
BUCKET_POSTINGS = 300_000
MIN_BUCKETS = 96
#: Rounds in which components meet, and how many typical and other sets stand for a token in each.
ROUNDS = 3
TYPICAL = 8
OTHERS = 24
#: Larger components that one meets in a round.
NEAREST = 2
#: Postings that a task holds before it sends them, and bytes of text whose shingles it makes at once.
TASK_POSTINGS = 200_000
SLICE_BYTES = 1 << 17
#: Sets whose signatures are made at once.
SIGNED_SETS = 128
#: Longs in a sketch.
SKETCH = 8
#: Lowest signatures of a set that travel with each of its others.
LEAST = 4
#: Frequent tokens of a set that travel with the next one.
BEFORE = 16
#: Upper bound of the bits of the set by which texts are fetched.
MAX_BITS = 1 << 26
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes], seed: int = 0) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = ~_SPACE[data]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(data) else np.zeros(0, dtype=int)
    if not len(begins):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, begins)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15 + 2 * seed, dtype=np.uint64))
        value = (_LOWER[data[at]].astype(np.uint64) + _U(1)) * powers[place]
        word = _mixed(np.add.reduceat(value, first) + length.astype(np.uint64) * _U(0xD1B54A32D192ED03))
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, side="right")
        n = np.bincount(text, minlength=len(texts))
        factors = _mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)
        some = np.flatnonzero(n[text] >= WORDS)
        start = some[(some + WORDS <= len(word))]
        start = start[text[np.minimum(start + WORDS - 1, len(word) - 1)] == text[start]]
        long = sum(word[start + k] * factors[k] for k in range(WORDS)) if len(start) else np.zeros(0, dtype=np.uint64)
        few = np.flatnonzero((n > 0) & (n < WORDS))
        starts = np.searchsorted(text, few)
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(WORDS - 1):
            has = n[few] > k
            short[has] += word[starts[has] + k] * factors[k]
        owner = np.concatenate([text[start], few])
        token = _mixed(np.concatenate([long, short + n[few].astype(np.uint64)]))
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
    owner, token = owner[new], token[new]
    return np.split(token, np.searchsorted(owner, np.arange(1, len(texts))))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest())


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Per set ``SKETCH`` longs: each bit is the parity of the tokens that a hash puts on it."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    bits = SKETCH * 64
    spot = (_mixed(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]) ^ _U(0x5851F42D4C957F2D)) % _U(bits)).astype(np.int64)
    odd = np.bincount(spot + np.repeat(np.arange(len(sets)) * bits, size), minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(bool).reshape(len(sets), bits), axis=1).view(np.int64).reshape(len(sets), SKETCH)


#: Names of the sketch's longs.
_SKETCH = [f"s{i}" for i in range(SKETCH)]


def _differ(a: str = "_a", b: str = "_b") -> str:
    """In how many bits two sketches differ."""
    return "(" + " + ".join(f"bit_count({c}{a} ^ {c}{b})" for c in _SKETCH) + ")"


def _close(a: str = "_a", b: str = "_b") -> str:
    """What two sets that link fulfil: sizes within the threshold, and sketches that differ in few bits."""
    return f"5 * least(n{a}, n{b}) >= 4 * greatest(n{a}, n{b}) AND 9 * {_differ(a, b)} <= n{a} + n{b}"


#: Two sets whose lowest signatures overlap meet in these only: of all that they share the lowest is among them.
_FIRST_MEETING = "((lowest_a AND lowest_b) OR NOT arrays_overlap(least_a, least_b))"


def zone(n):
    """Length of the prefix that is indexed; ``n`` is a number, an array or a column."""
    need = n // 5 + 1
    return np.minimum(n, need + need // 4 + 8)


def _zone_column(n: Column) -> Column:
    need = F.floor(n / 5) + 1
    return F.least(n, need + F.floor(need / 4) + 8)


def _documents(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]


def set_table(documents: DataFrame, seed: int = 0) -> DataFrame:
    """Per row its id, the size of its set, the digest of the set in two halves (null where it is empty), and its sketch."""

    def run(batches):
        for batch in small_slices(batches, size=SLICE_BYTES):
            sets = shingle_sets(_texts(batch), seed)
            pairs = [digest(s) if len(s) else (None, None) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)]
            columns += [pa.array(column) for column in np.ascontiguousarray(sketches(sets).T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "k", "k2", *_SKETCH])

    longs = ", ".join(f"{c} bigint" for c in _SKETCH)
    return documents.mapInArrow(run, f"id {dict(documents.dtypes)['id']}, n bigint, k bigint, k2 bigint, {longs}")


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(tokens + _U(77)) % _U(buckets)).astype(np.int64)


def shared_tokens(documents: DataFrame, buckets: int, seed: int = 0) -> DataFrame:
    """Prefix tokens of two sets or more: ``token``, ``k``, ``df`` (sets that have it, at most ``RARE``) and ``low``."""

    def packed(tokens, keys, low):
        """Rows by bucket; tokens that are frequent here go to salted buckets, and leave a mark in their own."""
        order = np.argsort(tokens, kind="stable")
        tokens, keys, low = tokens[order], keys[order], low[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.append(starts, len(tokens)))
        hot = np.repeat(size >= RARE, size)
        where = _bucket(tokens, buckets)
        where[hot] = buckets + (_bucket(keys[hot].view(np.uint64), buckets))
        marks = tokens[starts[size >= RARE]]
        tokens = np.concatenate([tokens, marks])
        keys = np.concatenate([keys, np.zeros(len(marks), dtype=np.int64)])
        low = np.concatenate([low, np.full(len(marks), 2, dtype=np.uint8)])
        where = np.concatenate([where, _bucket(marks, buckets)])
        order = np.argsort(where, kind="stable")
        tokens, keys, low, where = tokens[order], keys[order], low[order], where[order]
        cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, dtype=int)
        ends = np.append(cut[1:], len(where))
        for i in range(0, len(cut), 64):
            spans = list(zip(cut[i : i + 64], ends[i : i + 64]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[cut[i : i + 64]], pa.int64())]
                + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (tokens, keys, low)],
                ["bucket", "tokens", "keys", "low"],
            )

    def send(batches):
        seen, parts, held = set(), [], 0
        for batch in small_slices(batches, size=SLICE_BYTES):
            for tokens in shingle_sets(_texts(batch), seed):
                if not len(tokens) or (key := digest(tokens)[0]) in seen:
                    continue
                seen.add(key)
                head = tokens[: int(zone(len(tokens)))]
                parts.append((head, key))
                held += len(head)
            if held >= TASK_POSTINGS:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    def flush(parts):
        size = np.array([len(t) for t, _ in parts])
        rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        keys = np.repeat(np.array([k for _, k in parts], dtype=np.int64), size)
        yield from packed(np.concatenate([t for t, _ in parts]), keys, (rank < LOW).astype(np.uint8))

    def gather(key, table):
        tokens, keys, low = (
            np.concatenate([np.frombuffer(b, dtype=t) for b in table.column(c).to_pylist()])
            for c, t in (("tokens", "<u8"), ("keys", "<i8"), ("low", "u1"))
        )
        always = key[0].as_py() >= buckets
        order = np.lexsort((keys, low == 2, tokens))
        tokens, keys, low = tokens[order], keys[order], low[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1]) | ((low[1:] == 2) != (low[:-1] == 2))
        tokens, keys, low = tokens[new], keys[new], low[new]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.append(starts, len(tokens)))
        marked = np.maximum.reduceat(low == 2, starts)
        sets = np.where(marked | always, RARE, np.minimum(size, RARE))
        sets = np.repeat(sets, size)
        keep = (sets > 1) & (low != 2)
        return pa.table({
            "token": pa.array(tokens[keep].view(np.int64)), "k": pa.array(keys[keep]),
            "df": pa.array(sets[keep].astype(np.int32)), "low": pa.array(low[keep] == 1),
        })

    sent = documents.mapInArrow(send, "bucket bigint, tokens binary, keys binary, low binary")
    return sent.groupBy("bucket").applyInArrow(gather, "token bigint, k bigint, df int, low boolean")


def _wanted_bits(keys: DataFrame) -> np.ndarray:
    """A bit set of bounded size over the keys."""
    n = keys.count()
    bits = 1 << 16
    while bits < min(MAX_BITS, 32 * n):
        bits *= 2
    bit = F.pmod(F.col("k"), F.lit(bits))
    words = keys.select(F.floor(bit / 32).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(k, {bits}) % 32 AS INT))").alias("mask"))
    out = np.zeros(bits // 32, dtype=np.uint32)
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.uint32)
    return out


def verified(documents: DataFrame, pairs: DataFrame, classes: DataFrame, seed: int = 0) -> DataFrame:
    """Of the pairs (``a``, ``b``) of set keys those whose sets, made again from the whole texts, are similar enough."""
    spark = documents.sparkSession
    who = classes.select("k", F.col("first_id").alias("id"), "n", *_SKETCH)
    a, b = (who.select(F.col("k").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", *_SKETCH)]) for s in "ab")
    sized = pairs.join(a, "a").join(b, "b").where(_close())
    sized = settle(sized.select("a", "b", "id_a", "id_b"))
    if sized.isEmpty():
        return sized.select("a", "b")
    keys = sized.select(F.col("a").alias("k")).unionByName(sized.select(F.col("b").alias("k"))).distinct()
    bits = spark.sparkContext.broadcast(_wanted_bits(keys))
    # shingles are made only of texts whose id is that of a wanted set
    hashed = [sized.select(F.xxhash64(f"id_{s}").alias("k")) for s in "ab"]
    id_bits = spark.sparkContext.broadcast(_wanted_bits(hashed[0].unionByName(hashed[1]).distinct()))

    def of_wanted_ids(batches):
        for batch in batches:
            spots = batch.column(2).to_numpy() % (len(id_bits.value) * 32)
            keep = id_bits.value[spots >> 5] >> (spots & 31).astype(np.uint32) & np.uint32(1)
            yield batch.select([0, 1]).filter(pa.array(keep.astype(bool)))

    def fetch(batches):
        wanted = bits.value
        size = len(wanted) * 32
        sent = set()
        for batch in small_slices(of_wanted_ids(batches), size=SLICE_BYTES):
            keep, ks = [], []
            for i, tokens in enumerate(shingle_sets(_texts(batch), seed)):
                if len(tokens):
                    k = digest(tokens)[0]
                    spot = k % size
                    if wanted[spot >> 5] >> np.uint32(spot & 31) & np.uint32(1):
                        own = (k, batch.column(0)[i].as_py())
                        if own not in sent:
                            sent.add(own)
                            keep.append(i)
                            ks.append(k)
            if keep:
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), *rows.columns], ["k", "id", "text"])

    kind = dict(documents.dtypes)["id"]
    texts = documents.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(fetch, f"k bigint, id {kind}, text string")
    left = texts.select(F.col("k").alias("a"), F.col("id").alias("at"), F.col("text").alias("text_a"))
    right = texts.select(F.col("k").alias("b"), F.col("id").alias("at"), F.col("text").alias("text_b"))
    met = sized.join(left, (sized["a"] == left["a"]) & sized["id_a"].eqNullSafe(left["at"])).select(
        sized["a"], "b", "id_b", "text_a"
    )
    met = met.join(right, (met["b"] == right["b"]) & met["id_b"].eqNullSafe(right["at"])).select(
        "a", met["b"], "text_a", "text_b"
    )

    def compare(batches):
        for batch in small_slices(batches, "text_a", SLICE_BYTES):
            made: dict[int, np.ndarray] = {}
            columns = [batch.column(i).to_pylist() for i in (0, 1)]
            for side, keys in zip((2, 3), columns):
                fresh = {k: i for i, k in enumerate(keys) if k not in made}
                whole = batch.column(side)
                sets = shingle_sets([(whole[i].as_py() or "").encode() for i in fresh.values()], seed)
                made |= dict(zip(fresh, sets))
            linked = []
            for x, y in zip(*columns):
                both = len(np.intersect1d(made[x], made[y], assume_unique=True))
                linked.append(5 * both >= 4 * (len(made[x]) + len(made[y]) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    with small_batches(spark):
        return settle(met.mapInArrow(compare, "a bigint, b bigint"))


def _groups(level: int) -> int:
    """Number of groups that frequent tokens are dealt to in sets whose size has ``level`` bits: about four tokens in each."""
    return max(1, int(zone(3 << level >> 2)) // 4)


def _pair_signatures(sets: DataFrame) -> DataFrame:
    """``sig``, ``level``, the lowest signatures of that level, whether ``sig`` is one of these, and the set's other columns
    per pair of frequent tokens of a group; ``sig`` is null, once, for heavy sets whose pairs don't suffice."""
    kept = ["k", "n", "c", "heavy", *_SKETCH]

    def run(batches):
        for batch in (whole.slice(i, SIGNED_SETS) for whole in batches for i in range(0, whole.num_rows, SIGNED_SETS)):
            sigs, at, levels, lowest, least, sizes = [], [], [], [], [], []
            for i, row in enumerate(batch.to_pylist()):
                tokens = np.sort(np.array(row["tokens"], dtype=np.int64).view(np.uint64))
                n, paired = row["n"], len(tokens)
                for level in sorted({n.bit_length(), (n * 5 // 4).bit_length()}):
                    groups = _groups(level)
                    begin = len(sigs)
                    with np.errstate(over="ignore"):
                        group = _mixed(tokens + _U(level)) % _U(groups)
                        order = np.argsort(group, kind="stable")
                        for part in np.split(tokens[order], np.flatnonzero(np.diff(group[order].astype(np.int64))) + 1):
                            x, y = np.triu_indices(len(part), 1)
                            sig = _mixed(part[x] * _U(3) ^ _mixed(part[y]) + _U(level))
                            sigs.append(sig.view(np.int64))
                            at.append(np.full(len(sig), i))
                            levels.append(np.full(len(sig), level))
                    own = np.concatenate([np.zeros(0, dtype=np.int64), *sigs[begin:]])
                    low = np.sort(own)[:LEAST]
                    lowest.append(np.isin(own, low))
                    least.append(np.tile(low, len(own)))
                    sizes.append(np.full(len(own), len(low)))
                    paired = min(paired, len(tokens) - len(np.unique(group)))
                if row["heavy"] and paired + int(zone(n)) - len(tokens) < n // 5 + 1:
                    sigs.append(None)
                    at.append(np.array([i]))
                    levels.append(np.array([0]))
                    lowest.append(np.array([False]))
                    sizes.append(np.array([0]))
            where = np.concatenate([np.zeros(0, dtype=np.int64), *at]).astype(np.int64)
            made = [pa.array([None], pa.int64()) if s is None else pa.array(s, pa.int64()) for s in sigs]
            column = pa.concat_arrays(made) if made else pa.array([], pa.int64())
            rows = batch.select(kept).take(pa.array(where))
            bits = pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *levels]).astype(np.int32))
            first = pa.array(np.concatenate([np.zeros(0, dtype=bool), *lowest]))
            ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, dtype=np.int64), *least]))
            yield pa.RecordBatch.from_arrays([column, bits, first, lists, *rows.columns], ["sig", "level", "lowest", "least", *kept])

    longs = ", ".join(f"{c} bigint" for c in _SKETCH)
    schema = f"sig bigint, level int, lowest boolean, least array<bigint>, k bigint, n bigint, c bigint, heavy boolean, {longs}"
    return sets.mapInArrow(run, schema)


def _meetings(sigs: DataFrame) -> DataFrame:
    """Each heavy set (``_a``) with the sets of other components that share a signature and may link; most of them once."""
    kept = ["k", "n", "c", "heavy", "lowest", "least", *_SKETCH]
    x, y = (sigs.select("sig", "level", *[F.col(c).alias(f"{c}_{side}") for c in kept]) for side in "ab")
    # two sets are compared at the level of the larger
    once = "(k_a < k_b OR NOT heavy_b) AND length(bin(greatest(n_a, n_b))) = level"
    return x.where("heavy_a").join(y.drop("level"), "sig").where(f"{once} AND c_a != c_b AND {_close()} AND {_FIRST_MEETING}")


def _first_meetings(sets: DataFrame) -> DataFrame:
    """Each set that ``lacks`` pairs (``_a``) with the sets of other components that share a frequent token and may link.

    ``sets`` have their frequent ``tokens``. The first token that two sets share has none before it that both have, so they meet
    only where none of the ``BEFORE`` last ones is shared: where they share many, hardly ever again. After the first only
    so many can be shared as follow it in both; where these and the rare ones can't suffice, they don't meet.
    """
    rest = _zone_column(F.col("n")) - F.size("tokens")
    kept = ["k", "n", "c", "lacks", *_SKETCH]
    lined = sets.withColumn("tokens", F.sort_array("tokens")).select(*kept, rest.alias("rare"), "tokens", F.posexplode("tokens").alias("at", "token"))
    before = F.slice("tokens", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    lined = lined.select("token", *kept, "rare", (F.size("tokens") - F.col("at")).alias("left"), before.alias("before"))
    x, y = (lined.select("token", *[F.col(c).alias(f"{c}_{side}") for c in [*kept, "rare", "left", "before"]]) for side in "ab")
    enough = least_shown() <= F.least("left_a", "left_b") + F.least("rare_a", "rare_b")
    once = f"(k_a < k_b OR NOT lacks_b) AND c_a != c_b AND {_close()}"
    return x.where("lacks_a").join(y, "token").where(once).where(enough).where("NOT arrays_overlap(before_a, before_b)")


def least_shown() -> Column:
    """How many prefix tokens two sets (``n_a``, ``n_b``) that link share at least.

    Each misses at most n - 4/9 (n_a + n_b) tokens of the other; the one whose prefix ends first shows the rest in it.
    """
    together = F.ceil(4 * (F.col("n_a") + F.col("n_b")) / 9)
    return F.least(*[_zone_column(F.col(f"n_{s}")) - (F.col(f"n_{s}") - together) for s in "ab"])


def candidate_pairs(shared: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs of sets in different components (``labels``) that may still link."""
    known = classes.select("k", "n", *_SKETCH).join(labels.select(F.col("node").alias("k"), "component"), "k", "left")
    known = known.select("k", "n", *_SKETCH, F.coalesce("component", "k").alias("c"))
    frequent = shared.where(F.col("df") >= RARE)
    # frequent tokens of each set
    counts = shared.groupBy("k").agg(F.count(F.when(F.col("df") >= RARE, 1)).alias("f"))
    known = settle(known.join(counts, "k").select("k", "n", "c", "f", *_SKETCH))

    # sketches are most of a row: they are joined to those postings only that may meet another component's
    placed = shared.select("token", "k", "df").join(known.select("k", "c"), "k")
    rare = placed.where(F.col("df") < RARE)
    mixed = rare.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("token")
    rare = settle(rare.select("token", "k").join(mixed, "token")).join(known, "k")
    x, y = (rare.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("k", "n", "c", "f", *_SKETCH)]) for side in "ab")
    met = x.join(y, "token").where(f"k_a < k_b AND c_a != c_b AND {_close()}")
    met = met.groupBy("k_a", "k_b", "n_a", "n_b", "f_a", "f_b").agg(F.count(F.lit(1)).alias("both"))
    shown = least_shown()
    met = settle(met)
    pairs = met.where(F.col("both") + F.least("f_a", "f_b") >= shown).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))

    heavy = _zone_column(F.col("n")) - F.col("f") < F.floor(F.col("n") / 5) + 1
    sets = settle(known.where("f > 0").withColumn("heavy", heavy))
    if sets.where("heavy").isEmpty():
        return pairs.distinct()
    tokens = settle(frequent.groupBy("k").agg(F.collect_set("token").alias("tokens")))
    sigs = settle(_pair_signatures(sets.join(tokens, "k").select("k", "n", "c", "heavy", *_SKETCH, "tokens")))
    mixed = (
        sigs.where("sig IS NOT NULL").groupBy("sig")
        .agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("heavy").alias("any")).where("c0 != c1 AND any").select("sig")
    )
    found = settle(sigs.join(mixed, "sig"))
    ends = [F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b")]
    # never null, and said so: else Spark tests that first, for all that meet
    near = _meetings(found).select(*ends, F.coalesce(shown, F.lit(0)).alias("shown"))
    lacking = settle(sigs.where("sig IS NULL").select("k", F.lit(True).alias("lacks")).distinct())
    # of the sets that don't lack pairs only those with a token of one that does
    theirs = frequent.select("token", "k").join(lacking, "k").select("token").distinct()
    like = frequent.select("token", "k").join(theirs, "token").select("k").distinct()
    like = sets.join(like, "k").join(lacking, "k", "left").join(tokens, "k").withColumn("lacks", F.coalesce("lacks", F.lit(False)))
    first = _first_meetings(like).select(*ends, F.coalesce(shown, F.lit(0)).alias("shown"))
    near = near.unionByName(first).distinct()
    # what must be shared and isn't rare is frequent: that is counted once for each pair
    for end in "ab":
        near = near.join(tokens.select(F.col("k").alias(end), F.col("tokens").alias(f"tokens_{end}")), end)
    near = near.join(met.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), "both"), ["a", "b"], "left")
    often = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.unionByName(near.where(often + F.coalesce("both", F.lit(0)) >= F.col("shown")).select("a", "b")).distinct()


def low_tokens(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``token``, ``k``, ``df`` and ``typical`` of each set's lowest tokens.

    Typical is the set whose prefix tokens are the most shared: of a text and its edited copies that is the text itself,
    which all copies resemble though they may differ too much from each other.
    """
    weight = shared.groupBy("k").agg(F.sum("df").alias("weight")).join(classes.select("k", "n"), "k")
    typical = F.struct((F.col("weight") / _zone_column(F.col("n"))).alias("share"), "k").alias("typical")
    low = shared.where("low").select("token", "k", "df").join(weight.select("k", typical), "k")
    return settle(low.select("token", "k", "df", "typical"))


def hub_pairs(low: DataFrame) -> DataFrame:
    """Each set with the most typical set that has its low tokens, where they share two of these or more."""
    hubs = low.groupBy("token").agg(F.max("typical").alias("hub")).select("token", F.col("hub.k").alias("a"))
    met = low.select("token", "k").join(hubs, "token").where("k != a").groupBy("a", F.col("k").alias("b"))
    return met.agg(F.count(F.lit(1)).alias("both")).where("both > 1").select("a", "b")


def nearest_pairs(low: DataFrame, classes: DataFrame, labels: DataFrame, turn: int = 0) -> DataFrame:
    """For each component the nearest pairs with sets of the ``NEAREST`` larger ones that look nearest; most have none.

    A set meets those that stand for its frequent low tokens: the ``TYPICAL`` most typical sets and ``OTHERS`` by a hash, which
    changes with the ``turn``. Sets that rare tokens alone bring together are few and left to ``candidate_pairs``.
    """
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    own = labels.join(sizes, "component").select(F.col("node").alias("k"), F.col("component").alias("c"), "size")
    placed = low.where(F.col("df") >= RARE).join(own, "k", "left").select(
        "token", "k", "typical", F.coalesce("c", "k").alias("c"), F.coalesce("size", F.lit(1)).alias("size")
    )
    mixed = placed.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("token")
    placed = settle(placed.join(mixed, "token"))
    by_token = Window.partitionBy("token")
    first = placed.select("token", "k", F.row_number().over(by_token.orderBy(F.desc("typical"))).alias("at")).where(F.col("at") <= TYPICAL)
    dealt = F.xxhash64("k", "token", F.lit(turn))
    others = placed.select("token", "k", F.row_number().over(by_token.orderBy(dealt, "k")).alias("at")).where(F.col("at") <= OTHERS)
    stand = first.unionByName(others).select("token", "k").distinct()
    seen = placed.drop("typical").join(classes.select("k", "n", *_SKETCH), "k")
    kept = ["k", "n", "c", "size", *_SKETCH]
    x = seen.select("token", *[F.col(c).alias(f"{c}_a") for c in kept])
    y = seen.join(stand, ["token", "k"]).select("token", *[F.col(c).alias(f"{c}_b") for c in kept])
    met = x.join(y, "token").where(f"c_a != c_b AND (size_a < size_b OR size_a = size_b AND c_a < c_b) AND {_close()}")
    far = F.expr(f"{_differ()} / (n_a + n_b)")
    best = met.groupBy("c_a", "c_b").agg(F.min(F.struct(far.alias("far"), F.col("k_a").alias("a"), F.col("k_b").alias("b"))).alias("best"))
    at = F.row_number().over(Window.partitionBy("c_a").orderBy("best"))
    return best.select("best", at.alias("at")).where(F.col("at") <= NEAREST).select("best.a", "best.b")


def joined_components(documents: DataFrame, shared: DataFrame, classes: DataFrame, seed: int = 0) -> DataFrame:
    """Components (``node``, ``component``) by the links to hubs, then by those that rounds of nearest pairs find."""
    low = low_tokens(shared, classes)
    labels = connected_components(verified(documents, hub_pairs(low), classes, seed))
    for turn in range(ROUNDS):
        links = verified(documents, nearest_pairs(low, classes, labels, turn), classes, seed)
        found = links.count()
        if not found:
            break
        labels = connected_components(_with_links(labels, links), "node", "component")
        if found < RARE:  # the rest are few pairs
            break
    return labels


def _with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components stand for their members: edges from these to them, and the links."""
    return labels.unionByName(links.select(F.col("a").alias("node"), F.col("b").alias("component")))


def _components(documents: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """The set table; per class its key ``k``, ``first_id`` and component ``c``; the seed in use. Other tables are deleted."""
    spark = documents.sparkSession
    with passing(spark):
        with small_batches(spark):
            sets = settle(set_table(documents, seed), stays=True)
        classes = sets.where("n > 0").groupBy("k").agg(
            F.min("id").alias("first_id"), F.max("n").alias("n"), F.min("k2").alias("low2"), F.max("k2").alias("high2"),
            *[F.min(c).alias(c) for c in _SKETCH],
        )
        classes = settle(classes)
        if not classes.where("low2 != high2").isEmpty():  # two sets with the same first half of the digest
            return _components(documents, seed + 1)
        total = classes.agg(F.sum(_zone_column(F.col("n")))).first()[0] or 0
        buckets = max(MIN_BUCKETS, -(-int(total) // BUCKET_POSTINGS))
        with small_batches(spark):
            shared = settle(shared_tokens(documents, buckets, seed))
        labels = joined_components(documents, shared, classes, seed)
        rest = verified(documents, candidate_pairs(shared, classes, labels), classes, seed)
        final = connected_components(_with_links(labels, rest), "node", "component")
        named = classes.join(final.select(F.col("node").alias("k"), "component"), "k", "left")
        named = settle(named.select("k", "first_id", F.coalesce("component", "k").alias("c")), stays=True)
    return sets.drop(*_SKETCH), named, seed


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_shingles`` and ``component_id`` of every row."""
    sets, named, _ = _components(_documents(df, id_column, text_column))
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(least, "c").select("k", "component_id")
    return sets.join(of_set, "k", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are: of each component one, with the smallest id, and all without words."""
    sets, named, seed = _components(_documents(df, id_column, text_column))
    # a null id comes last; of equal ids the smaller key stays
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "k"))
    keepers = named.groupBy("c").agg(first.alias("first")).select(F.col("first.k").alias("keep"), F.col("first.first_id").alias("keep_id"))
    keepers = keepers.select(F.struct("keep", "keep_id").alias("keep"))
    # only rows that have a like can go: the others needn't meet the keepers
    per_class = named.join(sets.where("n > 0").groupBy("k").agg(F.count(F.lit(1)).alias("rows")), "k")
    alike = per_class.groupBy("c").agg(F.sum("rows").alias("rows")).where("rows > 1").select("c")
    bits = df.sparkSession.sparkContext.broadcast(_wanted_bits(named.join(alike, "c").select("k")))
    rows = df.select(F.struct("*").alias("row"))
    places = {"id": df.columns.index(id_column), "text": df.columns.index(text_column)}

    def run(batches):
        wanted = bits.value
        size = len(wanted) * 32
        for batch in small_slices(with_fields(batches, places), size=SLICE_BYTES):
            keys = [digest(s)[0] if len(s) else None for s in shingle_sets(_texts(batch), seed)]
            spots = [None if k is None else k % size for k in keys]
            sole = [spot is None or not wanted[spot >> 5] >> np.uint32(spot & 31) & np.uint32(1) for spot in spots]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sole, pa.bool_()), batch.column(2)], ["k", "sole", "row"])

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("sole", T.BooleanType()), *rows.schema.fields])
    with small_batches(df.sparkSession):
        keyed = settle(rows.mapInArrow(run, schema))
    # key and id as one struct, in which nulls are equal: the join deals the rows as the grouping needs them
    own = F.struct(F.col("k").alias("keep"), F.col("row").getField(id_column).alias("keep_id"))
    met = keyed.where("NOT sole").withColumn("own", own).join(keepers, F.col("own") == F.col("keep"))
    one = met.groupBy("own").agg(F.first("row").alias("row"))
    return one.select("row.*").unionByName(keyed.where("sole").select("row.*"))
