"""Whitening of embeddings: exact statistics by merged moments, components on the driver, a second pass that verifies.

Entries are put on a grid first, x = floor(256 c), so that equal vectors are equal numbers. The fit list is each distinct
x-vector once. Each partition of it gives its count, its exact sums, its mean and its scatter about that mean; Chan's formula merges two such
states (the scatter of the union is the sum of both and of the outer product of the means' difference, weighted by the counts), and treeReduce
merges all of them, so the driver receives a few states of d x d numbers. There ``eigh`` gives the components. The second pass projects the
fit list, merges the moments of the projections in the same way, and takes their largest distance from the identity.

Plan: one Arrow scan packs the vectors (two bytes an entry where they fit); one shuffle of packed vectors with partial aggregation makes the
fit list, which is kept in the shared folder; two treeReduces over it; and one scan of all rows, without a join, for the result.

Defined results: rows whose vector is null or has null, NaN or infinite entries are dropped. Vectors of different lengths are
whitened apart, each length by its own fit list; the driver holds a d x d matrix for each length. An empty vector has no components, so no rows. Entries
beyond +-2**54 count as +-2**54, which is +-2**62 on the grid. A component whose eigenvalue is 0 to double precision has whitened null and is left out of
identity_error (null if none is left); explained is null where all vectors are equal. Deviations that no long can hold are null. Rows that repeat an id are judged by
their own vectors; a null id is an id like any other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ballastry.llm.common import checkpointed, table

GRID = 256
COMPONENTS = 4
ROWS_AT_ONCE = 4096
MOST = 2.0**62
WIDTHS = ("<i2", "<i4", "<i8")

#: Count, exact sums, mean and scatter of some vectors of one length.
State = tuple[int, list[int], np.ndarray, np.ndarray]


def on_grid(c: np.ndarray) -> np.ndarray:
    """floor(256 c) of finite numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(GRID * c.astype(np.float64)), -MOST, MOST).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """A vector in the narrowest of three widths, so equal vectors are equal bytes; the first byte is the width."""
    for k, kind in enumerate(WIDTHS):
        if k == len(WIDTHS) - 1 or not len(x) or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return bytes([k]) + x.astype(kind).tobytes()
    raise AssertionError


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, WIDTHS[data[0]], offset=1).astype(np.int64)


def grids(batch: pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """The x-vector of each row, None for those that are dropped."""
    out: list[np.ndarray | None] = []
    for a in range(0, batch.num_rows, ROWS_AT_ONCE):
        lists = batch[column].slice(a, ROWS_AT_ONCE)
        for v in lists:
            c = np.array([] if not v.is_valid else v.values.to_numpy(zero_copy_only=False), dtype=np.float64)  # null entries become NaN
            out.append(on_grid(c) if v.is_valid and np.isfinite(c).all() else None)
    return out


def by_length(vectors: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(d, matrix of the vectors of length d)."""
    own: dict[int, list[np.ndarray]] = {}
    for x in vectors:
        own.setdefault(len(x), []).append(x)
    for d, rows in own.items():
        yield d, np.stack(rows)


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and int(np.abs(x).max(initial=0)) > (2**62) // len(x):
        return [int(s) for s in x.astype(object).sum(axis=0)]
    return x.sum(axis=0).tolist()


def state_of(x: np.ndarray) -> State:
    """The state of some rows, centred on their own mean before anything is multiplied."""
    rows = x.astype(np.float64)
    mean = rows.mean(axis=0)
    rows = rows - mean
    sums = exact_sums(x) if x.dtype == np.int64 else []
    return len(x), sums, mean, rows.T @ rows


def merged(a: State, b: State) -> State:
    """Chan's formula for two states."""
    n = a[0] + b[0]
    apart = b[2] - a[2]
    scatter = a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)
    return n, [x + y for x, y in zip(a[1], b[1], strict=True)], a[2] + apart * (b[0] / n), scatter


def merged_all(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    out = dict(a)
    for d, own in b.items():
        out[d] = merged(out[d], own) if d in out else own
    return out


def moments(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray | None]) -> dict[int, State]:
    """The merged state of each length over the column x of fit; project says what is measured of a matrix of vectors."""

    def of_partition(rows: Iterator) -> Iterator[dict[int, State]]:
        state: dict[int, State] = {}
        held: list[np.ndarray] = []

        def add() -> None:
            nonlocal state, held
            for d, x in by_length(held):
                values = project(x)
                if values is not None:
                    state = merged_all(state, {d: state_of(values)})
            held = []

        for r in rows:
            held.append(unpack(bytes(r["x"])))
            if len(held) >= ROWS_AT_ONCE:
                add()
        add()
        yield state

    parts = fit.rdd.getNumPartitions()
    if not parts:  # an empty table's plan may have none
        return {}
    return fit.rdd.mapPartitions(of_partition).treeReduce(merged_all, depth=max(2, (parts - 1).bit_length() // 3))


class Whitener:
    """What the driver finds for one length: n, S, the first components, their eigenvalues and the trace."""

    def __init__(self, state: State, components: int) -> None:
        self.n, self.sums, _, scatter = state
        covariance = scatter / self.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        self.values, self.vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        self.trace = float(np.trace(covariance))
        self.zero = self.values <= len(values) * np.finfo(np.float64).eps * max(self.trace, 0.0)
        self.mean = np.array([s / self.n for s in self.sums])
        self.error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on the components, over the roots of their eigenvalues; NaN where those are 0."""
        root = np.sqrt(np.where(self.zero, 1.0, self.values))
        return np.where(self.zero, np.nan, (x - self.mean) @ self.vectors / root)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n x - S)**2, exactly."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(len(self.sums), 1) < 2**63:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit_list(vectors: DataFrame, column: str) -> DataFrame:
    """Each distinct x-vector once, in packed form (column x)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {pack(x) for x in grids(batch, column) if x is not None}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.binary())], ["x"])

    return vectors.select(column).mapInArrow(packed, "x binary").distinct()


def fitted(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitener]:
    """The whitener of each vector length, verified by a second pass over the fit list."""
    fit = checkpointed(fit_list(vectors, column))
    found = {d: Whitener(state, components) for d, state in moments(fit, lambda x: x).items() if d}

    def projected(x: np.ndarray) -> np.ndarray | None:
        own = found.get(x.shape[1])
        return None if own is None or own.zero.all() else own.project(x)[:, ~own.zero]

    for d, (n, _, _, scatter) in moments(fit, projected).items():
        found[d].error = float(np.abs(scatter / n - np.eye(len(scatter))).max())
    return found


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: its whitened coordinate beside the fit's figures."""
    rows = vectors.select(id_column, column)
    found = fitted(rows, column, components)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                own = grids(part, column)
                for d, model in found.items():
                    at = [k for k, x in enumerate(own) if x is not None and len(x) == d]
                    if not at:
                        continue
                    x = np.stack([own[k] for k in at])
                    c, white = len(model.values), model.project(x)
                    explained = model.values / model.trace if model.trace > 0 else np.full(c, np.nan)
                    columns = [
                        part[id_column].take(pa.array(np.repeat(at, c))),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(at))),
                        pa.array([model.n] * (len(at) * c), pa.int64()),
                        pa.array([v for v in model.deviations(x) for _ in range(c)], pa.int64()),
                        pa.array(white.ravel(), pa.float64(), from_pandas=True),
                        pa.array(np.tile(explained, len(at)), pa.float64(), from_pandas=True),
                        pa.array([model.error] * (len(at) * c), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [id_column, *[f.split()[0] for f in RESULT.split(", ")]])

    return rows.mapInArrow(result, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, {RESULT}")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
