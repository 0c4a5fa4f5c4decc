"""The trie of conversations' prefixes, with what caching them would save, rolled up by pointer jumping.

Conversations are first rebuilt: the first h turns of conversation c - c % 100 stand in for the own first h of c, h being crc32(c) % 6.
A node is a distinct sequence of turns (role, text) that some rebuilt conversation starts with. Its key is a digest of the prefix: the sums, in
two 64-bit lanes, of what a mixer makes of each turn's 128-bit digest and its place. Sums can be split, so prefixes of a conversation of any length are
found by a two-level scan: rows are sorted by range over all tasks, each task sums its own, and the driver gets one row a
task to hand on what a conversation has gathered in the tasks before.

Each node has an edge to its parent's key. In round r a node hands its sums, which cover its descendants less than 2**r below it, to the ancestor
2**r above; then pointers jump to the pointer's pointer. So log2(depth) rounds give every node the leaves and savings of its subtree.

The ids that end at a node are hashed in order: tasks of a range sort join them to blocks, so that a node at which a third of all conversations end
sends its last task a few blocks, not its rows; that task streams them through SHA-256.

Plan: texts move once, in the range sort that orders turns; from there on a turn is its digest and length. A node's members are counted with partial
aggregation. Pairs that join on a node's key are many to one. Broadcast is one row a task.

Defined results: turns of a conversation are ordered by turn (null first), then role, then text; null role and text are empty first. Repeated rows are turns of their
own. Rows without conv_id belong to no conversation and are left out. A conversation may have no turns after it is rebuilt; it ends at the root. c % 100 has c's sign. An
empty table has no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.llm.common import checkpointed, gathered, table
from ballastry.llm.ngram_jaccard import mix

FAMILY = 100
MOST_SHARED = 6
BLOCK_ROWS = 10_000
KEY = ["a", "b"]


def term(digest: np.ndarray, place: np.ndarray, lane: int) -> np.ndarray:
    """What a turn at a place (from 1) adds to a lane of the keys of all prefixes that hold it."""
    return mix(digest.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 31 + lane)


def shared_turns(conv_id: Column) -> Column:
    """h: how many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string")) % MOST_SHARED).cast("int")


def _segments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal ids start, and the number of each row's run."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as (conv_id, part, at, d1, d2, chars); at counts a conversation's turns in this task."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["conv_id"].to_numpy()
        starts, run = _segments(ids)
        at = np.arange(len(ids)) - starts[run] + 1
        if ids[0] == last:
            at[run == 0] += count
        last, count = ids[-1], int(at[-1])
        digests, chars = bytearray(), []
        for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = role.encode()
            digests += hashlib.blake2b(len(own).to_bytes(8, "little") + own + text.encode(), digest_size=16).digest()
            chars.append(len(text))
        lanes = np.frombuffer(bytes(digests), dtype=np.int64).reshape(-1, 2)
        columns = [batch["conv_id"], pa.array(np.full(len(ids), part, np.int32)), pa.array(at), pa.array(lanes[:, 0]), pa.array(lanes[:, 1]), pa.array(chars, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "at", "d1", "d2", "chars"])


def _carried(ends: DataFrame, sums: list[str]) -> dict[int, tuple[int, list[int]]]:
    """For each task that begins inside a conversation: its conv_id, and what the tasks before have of it.

    ends has a row a task: its first conv_id, and its last with what it has gathered of it there.
    """
    out: dict[int, tuple[int, list[int]]] = {}
    open_, held = None, [0] * len(sums)
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        own = [r["last"][s] for s in sums]
        if r["first"] == open_:
            out[r["part"]] = (open_, held)
            if r["last"]["conv_id"] == open_:
                own = [x + y for x, y in zip(held, own, strict=True)]
        open_, held = r["last"]["conv_id"], own
    return out


def _ends(rows: DataFrame, order: str, sums: list[str]) -> DataFrame:
    columns = dict.fromkeys(["conv_id", order, *sums])
    return rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct(*columns)).alias("last"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, d1, d2, chars) of every turn, pos from 1 in the order of turn, role and text."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    rows = checkpointed(rows.mapInArrow(_numbered, "conv_id long, part int, at long, d1 long, d2 long, chars long"))
    before = _carried(_ends(rows, "at", ["at"]), ["at"])
    spark = conversations.sparkSession
    more = spark.createDataFrame([(p, c, n[0]) for p, (c, n) in before.items()], "p long, c long, more long")
    rows = rows.join(F.broadcast(more), (F.col("part") == F.col("p")) & (F.col("conv_id") == F.col("c")), "left")
    return rows.select("conv_id", (F.col("at") + F.coalesce("more", F.lit(0))).alias("pos"), "d1", "d2", "chars")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations with the keys of the prefixes that they take from the first of their family, from the root on."""
    for batch in batches:
        keys: tuple[list, list] = ([], [])
        chars = []
        for h, head in zip(batch["h"].to_pylist(), batch["head"].to_pylist(), strict=True):
            own = (head or [])[:h]
            place = np.arange(1, len(own) + 1)
            for lane, out in enumerate(keys):
                each = term(np.array([t[f"d{lane + 1}"] for t in own], dtype=np.int64), place, lane)
                out.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)]).view(np.int64))
            chars.append([t["chars"] for t in own])
        columns = [batch["conv_id"], batch["h"], batch["n"], *[pa.array(k, pa.list_(pa.int64())) for k in (*keys, chars)]]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "h", "n", "a", "b", "chars"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted own turns with the sums of their conversation in this task, up to each and before it."""
    part, last, held = TaskContext.get().partitionId(), None, [np.uint64(0)] * 2
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, place = batch["conv_id"].to_numpy(), batch["depth"].to_numpy()
        starts, run = _segments(ids)
        sums = []
        for lane in range(2):
            each = term(batch[f"d{lane + 1}"].to_numpy(), place, lane)
            total = np.cumsum(each, dtype=np.uint64)
            total -= (total[starts] - each[starts])[run]
            if ids[0] == last:
                total[run == 0] += held[lane]
            held[lane] = total[-1]
            sums += [total.view(np.int64), (total - each).view(np.int64)]
        last = ids[-1]
        kept = [c for c in batch.schema.names if c not in ("d1", "d2")]
        columns = [*[batch[c] for c in kept], pa.array(np.full(len(ids), part, np.int32)), *[pa.array(s) for s in sums]]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "part", "la", "pla", "lb", "plb"])


def _wrapped(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def _own_prefixes(before: dict[int, tuple[int, list[int]]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch["conv_id"].to_numpy(), batch["part"].to_numpy()
            keys = []
            for lane, name in enumerate(KEY):
                more = batch[f"{name}0"].to_numpy().copy()
                for p in set(parts.tolist()) & before.keys():
                    conv, sums = before[p]
                    more[(parts == p) & (ids == conv)] += np.int64(_wrapped(sums[lane]))
                keys += [pa.array(more + batch[f"l{name}"].to_numpy()), pa.array(more + batch[f"pl{name}"].to_numpy())]
            a, pa_, b, pb = keys
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["depth"], a, b, pa_, pb, batch["chars"], batch["ends"]], ["conv_id", "depth", "a", "b", "pa", "pb", "chars", "ends"])

    return rows


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, a, b, pa, pb, chars) of every prefix but the root, and (conv_id, a, b), where each conversation ends."""
    h = shared_turns(F.col("conv_id"))
    heads = turns.where(f"conv_id % {FAMILY} = 0 AND pos < {MOST_SHARED}").groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "d1", "d2", "chars"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))
    taken = convs.join(heads, "base", "left").select("conv_id", "h", "n", "head")
    taken = gathered(taken.mapInArrow(_prefixes, "conv_id long, h int, n long, a array<long>, b array<long>, chars array<long>"))

    inner = taken.select("conv_id", F.posexplode("chars").alias("k", "c"), "a", "b")
    inner = inner.select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), *[F.expr(f"{c}[k + 1]").alias(c) for c in KEY], *[F.expr(f"{c}[k]").alias(f"p{c}") for c in KEY], F.col("c").alias("chars"))
    begun = taken.where("n > h").select("conv_id", "n", F.size("chars").alias("k"), *[F.element_at(c, -1).alias(f"{c}0") for c in KEY])
    own = turns.where(F.col("pos") > h).join(begun, "conv_id")
    own = own.select("conv_id", (F.col("pos") - h + F.col("k")).alias("depth"), "d1", "d2", "chars", "a0", "b0", (F.col("pos") == F.col("n")).alias("ends"))
    own = own.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    own = checkpointed(own.mapInArrow(_running, "conv_id long, depth long, chars long, a0 long, b0 long, ends boolean, part int, la long, pla long, lb long, plb long"))
    before = _carried(_ends(own, "depth", ["la", "lb"]), ["la", "lb"])
    own = own.mapInArrow(_own_prefixes(before), "conv_id long, depth long, a long, b long, pa long, pb long, chars long, ends boolean")
    ends = own.where("ends").select("conv_id", *KEY).unionByName(taken.where("n <= h").select("conv_id", *[F.element_at(c, -1).alias(c) for c in KEY]))
    return inner.unionByName(own.drop("ends")), ends


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, values): the sums of values over each node's subtree, by pointer jumping.

    nodes has a, b, its parent's pa and pb, depth (0 at roots, whose parent is not looked at) and values.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select(*KEY, *values)
    ups = nodes.where("depth > 0").select(*KEY, "depth", F.col("pa").alias("ja"), F.col("pb").alias("jb"))  # ancestors step above
    step = 1
    while step <= deepest:
        gains = ups.join(sums, KEY).groupBy("ja", "jb").agg(*[F.sum(v).alias(f"more_{v}") for v in values]).withColumnsRenamed({"ja": "a", "jb": "b"})
        sums = gathered(sums.join(gains, KEY, "left").select(*KEY, *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]))
        above = ups.select(F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("na"), F.col("jb").alias("nb"))
        step *= 2
        if step <= deepest:
            ups = gathered(ups.where(F.col("depth") >= step).join(above, ["ja", "jb"]).select(*KEY, "depth", F.col("na").alias("ja"), F.col("nb").alias("jb")))
    return sums


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv_id) as blocks of ids joined by commas: (a, b, least, ids)."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(k, BLOCK_ROWS)
            a, b, ids = (part[c].to_numpy() for c in (*KEY, "conv_id"))
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            names = list(map(str, ids.tolist()))
            joined = [",".join(names[x:y]) for x, y in zip(starts, [*starts[1:], len(names)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v[starts]) for v in (a, b, ids)] + [pa.array(joined, pa.string())], [*KEY, "least", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's blocks, which come in order."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for a, b, ids in zip(*[batch[c].to_pylist() for c in (*KEY, "ids")], strict=True):
            if (a, b) == node:
                state.update(f",{ids}".encode())
                continue
            if node:
                out.append((*node, state.hexdigest()))
            node, state = (a, b), hashlib.sha256(ids.encode())
        yield _of_rows(out)
    if node:
        yield _of_rows([(*node, state.hexdigest())])


def _of_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "b": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes at which conversations end."""
    order = [*KEY, "conv_id"]
    blocks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, "a long, b long, least long, ids string")
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie."""
    turns = numbered_turns(conversations)
    prefixes, ends = rebuilt(turns)
    ends = gathered(ends)
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.selectExpr("0L AS a", "0L AS b", "0L AS depth", "CAST(NULL AS LONG) AS pa", "CAST(NULL AS LONG) AS pb", "conv_id", "n_convs", "0L AS chars")
    nodes = prefixes.groupBy(*KEY).agg(
        F.min("depth").alias("depth"),
        F.min(F.struct("pa", "pb")).alias("up"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"),
    )
    nodes = gathered(nodes.select(*KEY, "depth", "up.pa", "up.pb", "conv_id", "n_convs", "chars").unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = gathered(nodes)

    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.drop("n_leaves", "saved_tokens").join(sums, KEY).join(ends_hashed(ends), KEY, "left").join(parents, ["pa", "pb"], "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id::VARCHAR AS s, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS own FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, s, 0 AS k, 4294967295::BIGINT AS v FROM c
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN w % 2 = 1 THEN xor(w // 2, 3988292384::BIGINT) ELSE w // 2 END
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE v END AS w FROM crc WHERE k < 8 * length(s))),
h AS (SELECT conv_id, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 8 * length(s)),
re AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:h.h], c.own[h.h + 1:]) AS turns
  FROM c JOIN h ON h.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, d, turns[1:d] AS key, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM re)),
n AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY key, d),
kids AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.key = n.key),
sums AS (
  SELECT key[1:e] AS key, e, sum((n_children = 0)::BIGINT) AS n_leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(key[d].x) END) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children,
  sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN sums ON sums.key = m.key AND sums.e = m.d LEFT JOIN m up ON m.d > 0 AND up.key = m.key[1:m.d - 1] AND up.d = m.d - 1
"""
