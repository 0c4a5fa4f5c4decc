"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form random product codes: space is rotated by random signs and Hadamard steps,
cut into two parts, and each part has a random code; a filter is one code word from each part,
and its direction their concatenation. A vector belongs to all filters whose inner product with it
exceeds ``alpha``. They are found by list decoding: the code words of each part are sorted by their
product, and only leading runs that can still exceed alpha are combined. Several codes, each with its own rotation,
share the filters among them, so that a vector that lies badly for one of them is well placed for others.
Vectors that share a filter are compared in double precision.

The codes grow with the table: alpha is set so that a filter holds about ``LOAD`` random vectors, and
the number of filters so that two vectors at the threshold share ``SHARED`` of them on average. Recall is
measured against brute force in the tests.

Plan: equal vectors are one class with a count. Each class is decoded once, and kept with its filters. A row (filter,
class, vector, the class's filters) is shuffled for each filter of a class. Filters with more than ``BLOCK`` classes are split:
classes fall into chunks by hash, and every pair of chunks is a task group of its own, so no group has
more than about 2 * BLOCK rows. A pair that shares several filters is counted in the smallest of them
only. Groups are compared in stripes, and give link counts by class and a spanning forest of their links, never the pairs: a tight
group of m vectors costs m rows, not m * m.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component. Vectors of another length than the most common one are compared
among equals only. Equal vectors link with each other. Rows that repeat a vec_id count as vectors of
their own; a null vec_id never names a component unless all its rows lack one. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.llm.common import checkpointed, table
from ballastry.llm.components import components

THRESHOLD = 0.9
LOAD = 500
SHARED = 6.0
MAX_TAIL = 0.25
ROTATIONS = 128
BLOCK = 2048
STRIPE = 512
SEED = 5


class ProductCode:
    """Seeded product codes for vectors of one length, sized for n vectors."""

    def __init__(self, dim: int, n: int, threshold: float = THRESHOLD) -> None:
        size = max(2, 1 << (dim - 1).bit_length())
        self.alpha = NormalDist().inv_cdf(1 - min(MAX_TAIL, LOAD / max(n, 1)))
        wanted = SHARED / _joint_tail(self.alpha, threshold)
        self.words = max(2, math.ceil(math.sqrt(wanted / ROTATIONS)))
        self.rotations = math.ceil(wanted / self.words**2)
        rng = np.random.default_rng([SEED, dim])
        half, directions = size // 2, []
        for _ in range(self.rotations):
            turn = np.eye(dim, size)
            for signs in rng.choice([-1.0, 1.0], size=(3, size)):
                turn = _hadamard(turn * signs)
            code = rng.standard_normal((2, self.words, half))
            directions += [turn[:, :half] @ code[0].T, turn[:, half:] @ code[1].T]
        #: The code words of every rotation and part as directions of the vectors' own space.
        self.directions = np.concatenate(directions, axis=1)

    def filters(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filter numbers of all unit vectors, one vector after the other and sorted, and how many each has."""
        products = (x @ self.directions).reshape(len(x), self.rotations, 2, self.words)
        order = np.argsort(-products, axis=3)
        ranked = np.take_along_axis(products, order, axis=3)
        rows, names = [], []
        for r in range(self.rotations):
            one, two = ranked[:, r, 0], ranked[:, r, 1]
            a = int((one + two[:, :1] >= self.alpha).sum(axis=1).max(initial=0))
            b = int((two + one[:, :1] >= self.alpha).sum(axis=1).max(initial=0))
            row, i, j = np.nonzero(one[:, :a, None] + two[:, None, :b] >= self.alpha)
            rows.append(row)
            names.append((r * self.words + order[row, r, 0, i]) * self.words + order[row, r, 1, j])
        row, name = np.concatenate(rows), np.concatenate(names)
        return name[np.lexsort((name, row))], np.bincount(row, minlength=len(x))


def _hadamard(y: np.ndarray) -> np.ndarray:
    n, step = y.shape[1], 1
    while step < n:
        y = y.reshape(len(y), -1, 2, step)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(y), -1)
        step *= 2
    return y / math.sqrt(n)


def _joint_tail(alpha: float, rho: float) -> float:
    """P(X > alpha, Y > alpha) of standard normals with correlation rho, by Simpson's rule."""
    normal, s = NormalDist(), math.sqrt(1 - rho * rho)
    steps = 400
    h = 8.0 / steps
    f = [normal.pdf(alpha + i * h) * (1 - normal.cdf((alpha - rho * (alpha + i * h)) / s)) for i in range(steps + 1)]
    return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _decoded(sizes: dict[int, int], threshold: float):
    """Adds the list of filters; batches may mix vectors of several lengths."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in codes:
                    codes[dim] = ProductCode(dim, sizes[dim], threshold)
                at = np.flatnonzero(dims == dim)
                for k in range(0, len(at), 256):
                    part = batch.take(pa.array(at[k : k + 256]))
                    names, counts = codes[dim].filters(_unit(_vectors(part["embedding"], dim)))
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(ends, pa.array(names.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "filters"])

    return rows


def _first_shared(a: list[np.ndarray], rows: np.ndarray, b: list[np.ndarray], cols: np.ndarray, here: int) -> np.ndarray:
    """Whether `here` is the smallest filter that rows' and columns' lists share, for linked pairs."""
    before_a = [f[: np.searchsorted(f, here)] for f in a]
    before_b = [f[: np.searchsorted(f, here)] for f in b]
    names = np.unique(np.concatenate([*before_a, *before_b])) if before_a or before_b else np.empty(0, dtype=np.int64)
    if not len(names):
        return np.ones(len(rows), dtype=bool)
    words = (len(names) + 63) // 64

    def bits(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), words), dtype=np.uint64)
        for k, f in enumerate(lists):
            at = np.searchsorted(names, f)
            np.bitwise_or.at(out[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return out

    x, y = bits(before_a), bits(before_b)
    ok = np.empty(len(rows), dtype=bool)
    for k in range(0, len(rows), 1 << 16):
        ok[k : k + (1 << 16)] = ~(x[rows[k : k + (1 << 16)]] & y[cols[k : k + (1 << 16)]]).any(axis=1)
    return ok


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of x and y with a cosine of at least threshold; both hold unit vectors."""
    product = x @ y.T
    r, c = np.nonzero(product >= threshold - 1e-12)
    exact = np.ones(len(r), dtype=bool)
    close = np.flatnonzero(product[r, c] <= threshold + 1e-12)  # the order of summation decides no other pair
    for k in range(0, len(close), 1 << 14):
        at = close[k : k + (1 << 14)]
        exact[at] = np.einsum("nd,nd->n", x[r[at]], y[c[at]]) >= threshold
    return r[exact], c[exact]


def _joined(root: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The roots after the pairs' components are joined; each is the smallest row of its component."""
    while True:
        a, b = root[r], root[c]
        if np.array_equal(a, b):
            return root
        root, least = root.copy(), np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while not np.array_equal(root, nearer := root[root]):
            root = nearer


def _links_in(here: int, x: np.ndarray, n: np.ndarray, lists: list[np.ndarray], side: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and roots, by rows, of one filter's group (or of one pair of its chunks)."""
    one = np.flatnonzero(side == i)
    two = one if i == j else np.flatnonzero(side == j)
    links, root = np.zeros(len(n), dtype=np.int64), np.arange(len(n))
    for k in range(0, len(one), STRIPE):
        rows = one[k : k + STRIPE]
        r, c = linked(x[rows], x[two], threshold)
        if i == j:
            later = c > r + k
            r, c = r[later], c[later]
        if not len(r):
            continue
        (a, at), (b, beside) = np.unique(r, return_inverse=True), np.unique(c, return_inverse=True)
        mine = _first_shared([lists[m] for m in rows[a]], at, [lists[m] for m in two[b]], beside, here)
        r, c = rows[r[mine]], two[c[mine]]
        links += np.bincount(r, weights=n[c], minlength=len(n)).astype(np.int64) + np.bincount(c, weights=n[r], minlength=len(n)).astype(np.int64)
        root = _joined(root, r, c)
    return links, root


KEY = ["dim", "filter", "i", "j"]


def _linked(threshold: float):
    """Runs over rows sorted by group; a group spans batches, and is held alone."""

    def found(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(group).combine_chunks()
        if rows.num_rows < 2:
            return
        dim, here, i, j = (rows[c][0].as_py() for c in KEY)
        own = rows.to_batches()[0]
        ends = own["filters"].offsets.to_numpy()
        names = own["filters"].values.to_numpy()
        lists = [names[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        links, root = _links_in(here, _unit(_vectors(own["vector"], dim)), own["n"].to_numpy(), lists, own["chunk"].to_numpy(), i, j, threshold)
        has = np.flatnonzero(links > 0)
        if len(has):
            yield pa.RecordBatch.from_arrays([own["cls"].take(pa.array(has)), pa.array(links[has]), own["cls"].take(pa.array(root[has]))], ["cls", "links", "other"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in KEY], axis=1)
            starts = np.flatnonzero(np.concatenate([[last is None or not np.array_equal(keys[0], last)], (keys[1:] != keys[:-1]).any(axis=1)]))
            cuts = [0, *starts[starts > 0].tolist(), batch.num_rows]
            if held and len(starts) and starts[0] == 0:
                yield from found(held)
                held = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a > 0:
                    yield from found(held)
                    held = []
                held.append(batch.slice(a, b - a))
            last = keys[-1]
        if held:
            yield from found(held)

    return rows


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links and component_id of every row of vectors (vec_id, embedding)."""
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    fit = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    name = F.struct(F.xxhash64("embedding", F.size("embedding")).alias("h"), F.xxhash64(F.lit(SEED), "embedding").alias("g"))
    named = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).withColumn("cls", F.when(fit, name))
    classes = named.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = checkpointed(classes.withColumn("dim", F.size("embedding")))
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row a length
    schema = f"dim int, cls struct<h:bigint,g:bigint>, n long, embedding array<{kind}>, filters array<bigint>"
    decoded = checkpointed(classes.select("dim", "cls", "n", "embedding").mapInArrow(_decoded(sizes, threshold), schema))
    heavy = decoded.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    heavy = heavy.select("dim", "filter", F.ceil(F.col("m") / block).cast("int").alias("chunks"))
    rows = decoded.select("dim", F.explode("filters").alias("filter"), "cls", "n", F.col("embedding").alias("vector"), "filters")
    rows = rows.join(heavy, ["dim", "filter"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.hash("cls"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("i", F.least("chunk", "o")).withColumn("j", F.greatest("chunk", "o")).drop("o", "chunks")
    found = rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_linked(threshold), "cls struct<h:bigint,g:bigint>, links long, other struct<h:bigint,g:bigint>")
    found = checkpointed(found)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")).where("a <> b").distinct())
    groups = classes.join(joined, classes["cls"] == joined["node"], "left").select("cls", "n", "least", F.coalesce("component", "cls").alias("comp"))
    smallest = groups.groupBy("comp").agg(F.min("least").alias("component_id"))
    groups = groups.join(smallest, "comp").join(links, "cls", "left")
    groups = groups.select(F.col("cls").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = named.join(groups, named["cls"] == groups["c"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9::DOUBLE),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT reach.d, link.b FROM reach JOIN link ON reach.r = link.a),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON d = vec_id LEFT JOIN n ON a = vec_id
"""
