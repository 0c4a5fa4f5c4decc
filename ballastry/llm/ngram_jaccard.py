"""Exact Jaccard self-join on 5-word shingles with prefix filters under several global orders.

Sets with Jaccard similarity of at least t share a token among the first floor((1 - t) n) + 1 of
each set, under any one total order of all tokens. ``ORDERS`` orders are used here: in each, tokens go by the
level (log2) of their frequency in the corpus, and within a level in keyed random order, another
key for each order. A pair is a candidate only if it shares a prefix token under every order:
pairs come from the groups of the first order's prefix tokens, and are intersected with the other orders'
filters before any text is looked at. Candidates are verified on whole sets.

Steps, all on classes of documents with equal sets:

1. Prefix tokens of the first order are grouped; tokens of one class are dropped by an aggregate.
2. Every class of a group is paired with one pivot of the group, the class with the most frequent tokens, which in
   a group of near copies is next to their source. That is linear in the rows however large a group is.
   Pairs that pass the filters and the check join most of each group of copies.
3. Tokens whose classes are in one component by now are dropped; a pair inside one component cannot change
   the components. While tokens of the rest are crowded on the whole, a turn pairs each row of those with more than ``CROWDED`` rows with another pivot and
   with the few rows of a small random group of its token, which is linear as well. Rows of other tokens stay where they are;
   their pairs that a turn has joined are dropped as pairs in the next step.
4. Of what is left, all pairs from different components are taken whose sizes and places of the token allow the similarity:
   if it is the first token that they share, what follows it bounds their overlap. The smaller set's place must be in its first
   seventh, and a pair is left to an earlier crowded token if it shares one of the last ``BEFORE``.

Filters of a pair, in turn: prefixes under the other orders, then bitmaps of the sets (two bits a token), which bound
the overlap from above. What passes has its texts fetched for the exact check.

Plan: shingles are hashed (64 bits) in numpy inside the scans. Shuffled are the prefix tokens of one order, once; then rows of
tokens that several classes have; bitmaps and prefixes (16 bits a token) of the classes in pairs; and texts of pairs that pass the filters.
What belongs to the classes of pairs is picked by a broadcast of their ids when a count allows it, else by a shuffled join. Tokens that are in
more than 2**``SALT_FROM`` sets are dealt out by salts, and a task sends a set once however often its rows repeat it. Frequencies are counted in ``2**BITS`` bins,
whatever the corpus: each task sends its compressed bins, and all tasks get one byte a bin. They steer the orders
only, so no count can lose a link.

A class is named by 64 bits of its set's 128-bit hash; if two sets of the corpus share a name, the other bits show it, and
all are named anew under another seed.

Defined results: null, empty and word-free texts have an empty set, link with nothing and form their
own component (component_id is their doc_id). Texts of one to four words have one shingle, all their
words. Rows that repeat a doc_id are judged by their own texts; rows without doc_id link like
others, but never name a component unless all its rows lack one (then it is null). An empty table
gives an empty result. Other columns are ignored; ``keep_one`` passes them through unless they are named ``_nj_*``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballastry.llm.common import checkpointed, gathered, table, tidy
from ballastry.llm.components import components

N = 5
PERCENT = 75
ORDERS = 3
BITS = 24
HOT = 8
CHANCE = 3
TOKENS_AT_ONCE = 1 << 20
SALT_FROM = 12
SEEN = 500_000
TURNS = 4
TOGETHER = 4
CROWDED = 16
BEFORE = 32
BROADCAST_ROWS = 1_000_000
BYTES_AT_ONCE = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A keyed bijection of 64-bit integers with good avalanche."""
    x = x ^ np.uint64(key * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = mix(np.arange(1, N + 1, dtype=np.uint64), 12) | np.uint64(1)
_SHORT = mix(np.arange(N + 1, dtype=np.uint64), 13)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] = _LOWER[97:123]  # A-Z as a-z
#: What a byte at one of the first places of a word adds to the word's hash.
_TABLE = mix((np.arange(64, dtype=np.uint64)[:, None] << np.uint64(8)) | _LOWER, 11).ravel()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of what mix() makes of each byte and its place in the word.

    No algebra ties the places together, unlike in polynomials of one base, so words of patterns collide no oftener than others.
    """
    begin = np.zeros(len(data), dtype=np.int64)
    begin[starts] = starts
    place = np.arange(len(data), dtype=np.int64) - np.maximum.accumulate(begin)
    each = _TABLE[np.minimum(place, 63) << 8 | data]
    late = np.flatnonzero(place > 63)
    each[late] = mix((place[late].astype(np.uint64) << np.uint64(8)) | _LOWER[data[late]], 11)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(each, out=sums[1:])
    return mix(sums[ends] - sums[starts])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode()
        if part and size + len(raw) > BYTES_AT_ONCE:
            out += _sets(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    return out + (_sets(part) if part else [])


def _sets(raws: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = word_hashes(data, starts, ends)
    firsts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    bounds = np.searchsorted(starts, firsts)
    n = max(len(words) - N + 1, 0)
    runs = np.zeros(n, dtype=np.uint64)
    for j in range(N):
        runs += words[j : j + n] * _STEPS[j]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= N:
            s = np.sort(runs[a : b - N + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = mix((words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHORT[b - a])
        else:
            s = words[:0]
        out.append(s)
    return out


def class_of(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """The 128-bit hash of a set, as two signed numbers."""
    h = xxhash.xxh3_128_digest(s.tobytes(), seed)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def bin_of(s: np.ndarray) -> np.ndarray:
    """The frequency bins of tokens."""
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def prefix(s: np.ndarray, order: int, levels: np.ndarray) -> np.ndarray:
    """The first tokens of a set in an order, as many as the filter needs; levels has each bin's."""
    n = len(s) - -(-len(s) * PERCENT // 100) + 1
    rank = (mix(s, order) >> np.uint64(6)) | (levels[bin_of(s)].astype(np.uint64) << np.uint64(58))
    first = np.argpartition(rank, n - 1)[:n] if n < len(s) else np.arange(len(s))
    return s[first[np.argsort(rank[first])]]


def bitmap(s: np.ndarray) -> bytes:
    """Bits of a set's tokens: at least two for each token, a power of two in number."""
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(s >> np.uint64(5)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(n: int, bits: bytes, m: int, other: bytes) -> bool:
    """False only if the bitmaps of two sets of n and m tokens rule their similarity out.

    Each bit of one set that the other lacks stands for a token at least that is not shared.
    """
    a, b = np.frombuffer(bits, "<u8"), np.frombuffer(other, "<u8")
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * both >= PERCENT * (n + m - both)


def share_a_token(a: bytes, b: bytes) -> bool:
    """False only if two prefixes, given in sorted 16 bits a token, have no token in common."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    at = np.searchsorted(x, y)
    return bool((x[np.minimum(at, len(x) - 1)] == y).any())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def with_keys(docs: DataFrame, one: str = "k1", two: str = "k2") -> DataFrame:
    """Adds 96 bits of hash that name a row by its id and text, in two columns."""
    return docs.withColumn(one, F.xxhash64("doc_id", "text")).withColumn(two, F.hash("text", "doc_id"))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in pieces, which bounds what a task holds, and the sets of their texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, shingle_sets(part["text"].to_pylist())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the texts of a task add to the bins, in compressed blocks of 65,536.

    A worker holds a byte a bin; what goes beyond is kept aside as (bin, number of 256s), at most one for 256 tokens.
    """
    bins, over, held, size = np.zeros(1 << BITS, dtype=np.uint8), [], [], 0

    def add() -> None:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        n += bins[found]
        bins[found] = n & 255
        more = n > 255
        over.append((found[more], n[more] >> 8))

    for _, sets in parts(batches):
        held += [bin_of(s).astype(np.uint32) for s in sets]
        size += sum(map(len, sets))
        if size > TOKENS_AT_ONCE:
            add()
            held, size = [], 0
    if held:
        add()
    at, n = (np.concatenate([x[i] for x in over] or [np.empty(0, dtype=np.int64)]) for i in range(2))
    step = min(1 << 16, len(bins))
    block = at // step
    names, data = [], []
    for k, b in enumerate(bins.reshape(-1, step)):
        own = np.flatnonzero(block == k)
        if len(own):
            b = b.astype("<u4")
            np.add.at(b, at[own] % step, (n[own] << 8).astype("<u4"))
        if b.any():
            names.append(k)
            data.append(zlib.compress(b.tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def stand_out(counts: np.ndarray) -> np.ndarray:
    """log2 of what each bin has over the median bin, where that is ``HOT`` at least and more than chance gives; else 0.

    Rare tokens fill the bins evenly, so a frequent token shows as an excess of a few times the square root of a bin's count.
    """
    usual = float(np.median(counts))
    over = counts - usual
    levels = np.frexp(np.maximum(over, 1))[1] - 1
    return np.where(over >= max(HOT, CHANCE * usual**0.5), levels, 0).astype(np.int8)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of whole blocks' sums; the rows of a block come one after the other."""
    rows = (row for batch in batches for row in zip(batch["block"].to_pylist(), batch["data"], strict=True))
    size = min(1 << 16, 1 << BITS)
    for block, own in groupby(rows, key=itemgetter(0)):
        sums = np.zeros(size, dtype=np.uint64)
        for _, data in own:
            raw = zlib.decompress(data.as_py())
            sums += np.frombuffer(raw, "u1" if len(raw) == size else "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([stand_out(sums).tobytes()], pa.binary())], ["block", "levels"])


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """A level for each bin: log2 of the frequency of what stands out in it, else 0."""
    counted = docs.select("text").mapInArrow(tidy(_counted), "block int, data binary").repartition("block").sortWithinPartitions("block")
    rows = counted.mapInArrow(tidy(_summed), "block int, levels binary").collect()  # a byte a bin in all
    levels = np.zeros((max(1, (1 << BITS) >> 16), min(1 << 16, 1 << BITS)), dtype=np.int8)
    for r in rows:
        levels[r["block"]] = np.frombuffer(r["levels"], np.int8)
    return levels.ravel()


CLASSES = "doc_id long, k1 long, k2 int, cls long, other long, n long, level double, bits binary, prefixes array<binary>"


def _classes(levels: Broadcast, orders: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in parts(batches):
            some = [s if len(s) else None for s in sets]
            names = [(None, None) if s is None else class_of(s, seed) for s in some]
            frequent = [None if s is None else float(levels.value[bin_of(s)].mean()) for s in some]
            firsts = [
                None if s is None else [np.sort(prefix(s, o, levels.value).astype("<u2")).tobytes() for o in range(2, orders + 1)] for s in some
            ]
            columns = [
                part["doc_id"],
                part["k1"],
                part["k2"],
                pa.array([a for a, _ in names], pa.int64()),
                pa.array([b for _, b in names], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(frequent, pa.float64()),
                pa.array([None if s is None else bitmap(s) for s in some], pa.binary()),
                pa.array(firsts, pa.list_(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "cls", "other", "n", "level", "bits", "prefixes"])

    return rows


def _prefix_rows(levels: Broadcast, seed: int):
    """(token, salt, cls, pos) of each set once a task; salts above 0 deal out tokens that are known to be very frequent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in parts(batches):
            if len(seen) > SEEN:
                seen.clear()
            new = {}
            for s in sets:
                if len(s) and (name := class_of(s, seed)[0]) not in seen:
                    new[name] = s
            if new:
                seen.update(new)
                tokens = [prefix(s, 1, levels.value) for s in new.values()]
                names = np.repeat(np.array(list(new)), [len(t) for t in tokens])
                places = np.concatenate([np.arange(1, len(t) + 1, dtype=np.int32) for t in tokens])
                tokens = np.concatenate(tokens)
                over = np.maximum(levels.value[bin_of(tokens)].astype(np.int64) - SALT_FROM, 0)
                salts = np.where(over > 0, 1 + (names & ((1 << over) - 1)), 0).astype(np.int32)
                columns = [pa.array(tokens.view(np.int64)), pa.array(salts), pa.array(names), pa.array(places)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "salt", "cls", "pos"])

    return rows


def _shared_rows(docs: DataFrame, levels: Broadcast, seed: int) -> DataFrame:
    """The rows (token, cls, pos) of prefix tokens that several classes may have, in one shuffle."""
    rows = docs.select("text").mapInArrow(tidy(_prefix_rows(levels, seed)), "token long, salt int, cls long, pos int")
    group = Window.partitionBy("token", "salt")
    rows = rows.withColumn("lo", F.min("cls").over(group)).withColumn("hi", F.max("cls").over(group)).where("salt > 0 or lo < hi")
    return rows.select("token", "salt", "cls", "pos").distinct().select("token", "cls", "pos")


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the pairs that are similar."""
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.iloc[k : k + 256]
            texts = list(dict.fromkeys([*part["text_a"], *part["text_b"]]))
            sets = dict(zip(texts, shingle_sets(texts), strict=True))
            keep = [similar(sets[x], sets[y]) for x, y in zip(part["text_a"], part["text_b"], strict=True)]
            yield part.loc[keep, ["a", "b"]]


def _filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the pairs that share prefix tokens under all other orders and whose bitmaps allow the similarity."""
    for batch in batches:
        rows = zip(batch["na"], batch["bits_a"], batch["prefixes_a"], batch["nb"], batch["bits_b"], batch["prefixes_b"], strict=True)
        keep = [all(map(share_a_token, p, q)) and may_be_similar(n, x, m, y) for n, x, p, m, y, q in rows]
        yield batch.loc[keep, PAIR]


def _small(df: DataFrame) -> DataFrame:
    """df to broadcast if a count shows that it is small, else df for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: A pair: two classes, and the keys of the rows that stand for them.
PAIR = ["a", "a1", "a2", "b", "b1", "b2"]


def _standing_for(pairs: DataFrame) -> DataFrame:
    """(cls, k1, k2): the classes of the pairs and the rows that stand for them."""
    one, two = pairs.select(*PAIR[:3]), pairs.select(*PAIR[3:])
    return _small(one.union(two).toDF("cls", "k1", "k2").distinct())


def signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each class of the pairs, with its size, bitmap and prefixes."""
    found = classes.join(_standing_for(pairs), ["cls", "k1", "k2"])
    return found.select("cls", "n", "bits", "prefixes").dropDuplicates(["cls"])


def candidates(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs that pass all filters; signed has their signatures."""
    columns = {"n": "n{}", "bits": "bits_{}", "prefixes": "prefixes_{}"}
    one, two = (signed.select(F.col("cls").alias(side), *[F.col(c).alias(to.format(side)) for c, to in columns.items()]) for side in "ab")
    return pairs.join(one, "a").join(two, "b").mapInPandas(tidy(_filtered), "a long, a1 long, a2 int, b long, b1 long, b2 int")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar. Texts move for those that pass all filters only."""
    pairs = gathered(pairs)
    pairs = gathered(candidates(pairs, signatures(pairs, classes)))
    texts = with_keys(docs).join(_standing_for(pairs), ["k1", "k2"]).select("cls", "text").dropDuplicates(["cls"])
    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInPandas(tidy(_verified), "a long, b long")


SIDE = ["cls", "comp", "n", "pos", "k1", "k2"]


def _side(name: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{name}") for c in SIDE]


def _possible_pairs(ends: DataFrame) -> DataFrame:
    """The distinct pairs of different components that can be similar if the row's token is the first they share."""
    most = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    fits = (F.col("comp_a") != F.col("comp_b")) & (most * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT)
    one, two = (F.struct(*[F.col(f"{c}_{x}").alias(c) for c in ("cls", "k1", "k2")]) for x in "ab")
    pairs = ends.where(fits).select(F.greatest(one, two).alias("x"), F.least(one, two).alias("y"))
    return pairs.select("x.*", "y.*").toDF(*PAIR).distinct()


def _mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows whose token stands in several components, with their components and m, the number of their token's rows."""
    rows = rows.drop("comp", "m").join(joined, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    return rows.join(mixed.select(F.col("token").alias("t"), "m"), F.col("token") == F.col("t")).drop("t")


def _sizes(rows: DataFrame) -> Row:
    """n, the number of rows, and m, the sum of theirs."""
    return rows.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count(F.lit(1)).alias("n")).first()


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs that are not in one component by now."""
    one, two = (joined.select(F.col("node").alias(f"node_{x}"), F.col("component").alias(f"comp_{x}")) for x in "ab")
    placed = pairs.join(one, F.col("a") == F.col("node_a"), "left").join(two, F.col("b") == F.col("node_b"), "left")
    return placed.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select(*PAIR)


def _with_pivots(rows: DataFrame, by: Column) -> DataFrame:
    """Every row beside its token's pivot, the row of the largest value of by."""
    pivot = rows.groupBy("token").agg(F.max(F.struct(by.alias("by"), *SIDE)).alias("p"))
    return rows.join(pivot, "token").select("token", *_side("a"), *[F.col(f"p.{c}").alias(f"{c}_b") for c in SIDE])


def _with_few(rows: DataFrame, turn: int) -> DataFrame:
    """Every row beside those of a small group of its token's rows, drawn anew each turn: ``TOGETHER`` rows on average, whatever m is."""
    drawn = F.when(F.col("m") > TOGETHER, F.pmod(F.xxhash64("cls", F.lit(turn)), F.ceil(F.col("m") / TOGETHER))).otherwise(0)
    rows = rows.withColumn("few", drawn)
    one, two = rows.select("token", "few", *_side("a")), rows.select("token", "few", *_side("b"))
    return one.join(two, ["token", "few"]).where("comp_a < comp_b").drop("few")


def _with_all(rows: DataFrame) -> DataFrame:
    """Every row beside those of its token's other components, if the smaller set's row can be of a similar pair at all.

    A pair that shares one of the last ``BEFORE`` crowded tokens before this one is left to that token.
    """
    crowded = F.col("m") > CROWDED
    order = Window.partitionBy("cls").orderBy("pos").rowsBetween(-BEFORE, -1)
    few = rows.where(~crowded).withColumn("before", F.array().cast("array<bigint>"))
    rows = few.unionByName(rows.where(crowded).withColumn("before", F.collect_list("token").over(order)))
    one = rows.where(f"(pos - 1) * {100 + PERCENT} <= n * {100 - PERCENT}").select("token", "before", *_side("a"))
    two = rows.select("token", F.col("before").alias("before_b"), *_side("b"))
    fits = f"(n_a < n_b OR n_a = n_b AND cls_a < cls_b) AND comp_a <> comp_b AND n_b * {PERCENT} <= n_a * 100"
    return one.join(two, "token").where(f"{fits} AND NOT arrays_overlap(before, before_b)").drop("before", "before_b")


def _named(docs: DataFrame, levels: Broadcast, orders: int) -> tuple[DataFrame, DataFrame, int]:
    """All rows with their classes, a row for each class, and the seed under which no two sets share a name."""
    for seed in range(8):
        classes = checkpointed(with_keys(docs).mapInArrow(tidy(_classes(levels, orders, seed)), CLASSES))
        reps = classes.where("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("least"),
            F.min(F.struct("k1", "k2")).alias("rep"),
            (F.min("other") != F.max("other")).alias("twice"),
            F.min("n").alias("n"),
            F.min("level").alias("level"),
        )
        reps = checkpointed(reps.select("cls", "least", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"), "twice", "n", "level"))
        if reps.where("twice").isEmpty():
            return classes, reps, seed
    raise RuntimeError("sets share their names under all seeds")


def jaccard_components(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """doc_id, its row's keys k1 and k2, n_shingles, component_id and component (a class, null for an empty set)."""
    docs = docs.select("doc_id", "text")
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))
    classes, reps, seed = _named(docs, levels, orders)

    rows = _shared_rows(docs, levels, seed).join(reps.select("cls", F.col("cls").alias("comp"), "n", "level", "k1", "k2"), "cls")
    rows = gathered(rows)
    links = gathered(verify(_possible_pairs(_with_pivots(rows, F.col("level"))), docs, classes))
    rows = gathered(_mixed(rows, components(links)))
    rest, crowd = rows.where(F.col("m") <= CROWDED), rows.where(F.col("m") > CROWDED)
    joined, few, many = None, _sizes(rest), _sizes(crowd)
    for turn in range(TURNS):
        if few["m"] + many["m"] <= CROWDED * (few["n"] + many["n"]):
            break
        ends = _with_pivots(crowd, F.xxhash64("cls", F.lit(turn))).unionByName(_with_few(crowd, turn))
        found = gathered(verify(_possible_pairs(ends), docs, classes))
        links = gathered(links.unionByName(found))
        joined = components(links)
        crowd, before = gathered(_mixed(crowd, joined)), many
        many = _sizes(crowd)
        if found.count() * 100 < before["n"]:
            break
    pairs = _possible_pairs(_with_all(rest.unionByName(crowd)))
    links = links.unionByName(verify(pairs if joined is None else _apart(pairs, joined), docs, classes))
    joined = checkpointed(components(links))

    groups = reps.join(joined, reps["cls"] == joined["node"], "left").select("cls", "least", F.coalesce("component", "cls").alias("comp"))
    smallest = groups.groupBy("comp").agg(F.min("least").alias("component_id"))
    groups = groups.join(smallest, "comp").select(F.col("cls").alias("c"), F.col("comp").alias("component"), "component_id")
    out = classes.join(groups, classes["cls"] == groups["c"], "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays.

    Of rows that repeat it, one stays, the same in every run. Rows whose set is empty all stay.
    """
    found = checkpointed(jaccard_components(docs))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    chosen = found.where("component is not null").groupBy("component").agg(F.min(order).alias("row")).select(F.col("row.k1").alias("_nj_a"), F.col("row.k2").alias("_nj_b"))
    keyed = with_keys(docs, "_nj_1", "_nj_2")
    # Rows may have one id and text, but other columns that differ: the smallest hash of those decides, in every run.
    rest = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = keyed.join(chosen, (F.col("_nj_1") == F.col("_nj_a")) & (F.col("_nj_2") == F.col("_nj_b")))
    one = one.groupBy("_nj_1", "_nj_2").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*rest)).alias("_nj_row")).select("_nj_row.*")
    empty = keyed.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return one.select(*docs.columns).unionByName(empty.select(*docs.columns))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') || chr(10) || least(len(w), 5) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) c ON c.d = d.doc_id
"""
