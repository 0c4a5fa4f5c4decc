"""Matrix kernels for one period each: clustering order, minimum variance, eigenvalues.

Each runs as a grouped map over the covariances of a period, whose number of assets bounds the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def square(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Symbols in id order, and their covariances. Ids are ranks where given, else label order."""
    ids = dict(zip(pdf["i"], pdf["id_i"], strict=True)) if "id_i" in pdf else {}
    names = sorted(set(pdf["i"]) | set(pdf["j"]), key=lambda s: (ids.get(s, 0), s))
    at = {s: k for k, s in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
    out[i, j] = out[j, i] = pdf["cov"].to_numpy()
    return names, out


def distances(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.sqrt(np.maximum(0.0, (1 - cov / np.outer(sd, sd)) / 2))
    d[~np.isfinite(d)] = 0.0
    np.fill_diagonal(d, 0.0)
    return d


def single_linkage(dist: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size). Leaves are 0..n-1 and merge k is n + k; left is the smaller id.

    Of equal distances the pair with the smaller ids merges first. Each merge takes one pass over the clusters.
    """
    n = len(dist)
    d = dist.copy().astype(float)
    np.fill_diagonal(d, np.inf)
    ids, size, out = np.arange(n), np.ones(n, dtype=int), []  # by row; a merged cluster lives on in one row
    alive, near = np.ones(n, dtype=bool), d.min(axis=1) if n else np.empty(0)
    for k in range(n - 1):
        least = near[alive].min()
        tied = np.flatnonzero(alive & (near == least))
        x = tied[np.argmin(ids[tied])]
        tied = np.flatnonzero(alive & (d[x] == least))
        y = tied[np.argmin(ids[tied])]
        size[x] += size[y]
        out.append((int(ids[x]), int(ids[y]), float(least), int(size[x])))
        d[x] = np.minimum(d[x], d[y])
        d[:, x] = d[x]
        d[x, x] = np.inf
        alive[y] = False
        d[y], d[:, y] = np.inf, np.inf
        # the nearest distances of other clusters stay, for a cluster that was near is now part of x
        near[x], ids[x] = d[x].min(), n + k
    return out


def leaf_order(n: int, merges: list[tuple[int, int, float, int]]) -> list[int]:
    """Leaves from left to right."""
    order = {k: [k] for k in range(n)}
    for k, (left, right, _, _) in enumerate(merges):
        order[n + k] = order.pop(left) + order.pop(right)
    return next(iter(order.values())) if n else []


def shortest_order(dist: np.ndarray, merges: list[tuple[int, int, float, int]]) -> list[int]:
    """The leaf order of the tree, over all flips of its clusters, whose neighbours' distances have the least sum.

    best[u, w] is the least length of a cluster's order that starts at u and ends at w; each pair of leaves is cut apart
    by one cluster alone, so one matrix holds all clusters. Of equal lengths the smaller ids are taken, from the root down.
    """
    n = len(dist)
    if n < 2:
        return list(range(n))
    parts: dict[int, tuple[int, int]] = {n + k: (left, right) for k, (left, right, _, _) in enumerate(merges)}
    leaves = {k: [k] for k in range(n)}
    best = np.zeros((n, n))

    def ends(node: int) -> np.ndarray:
        """Lengths by (start, end) of a cluster's leaves; inf where no order has these ends."""
        own = leaves[node]
        if node < n:
            return np.zeros((1, 1))
        first = np.isin(own, leaves[parts[node][0]])
        return np.where(first[:, None] != first[None, :], best[np.ix_(own, own)], np.inf)

    for node, (left, right) in parts.items():
        x, y = leaves[left], leaves[right]
        leaves[node] = sorted(x + y)
        from_left, to_right, between = ends(left), ends(right), dist[np.ix_(x, y)]
        across = np.stack([(row[:, None] + between).min(axis=0) for row in from_left])
        best[np.ix_(x, y)] = np.stack([(row[:, None] + to_right).min(axis=0) for row in across])
        best[np.ix_(y, x)] = best[np.ix_(x, y)].T

    def walk(root: int) -> list[int]:
        whole = ends(root)
        u, w = np.unravel_index(np.argmin(whole), whole.shape)
        todo, out = [(root, leaves[root][u], leaves[root][w])], []
        while todo:
            node, start, end = todo.pop()
            if node < n:
                out.append(node)
                continue
            left, right = parts[node] if start in leaves[parts[node][0]] else parts[node][::-1]
            x, y = leaves[left], leaves[right]
            total = ends(left)[x.index(start)][:, None] + dist[np.ix_(x, y)] + ends(right)[:, y.index(end)][None, :]
            m, k = np.unravel_index(np.argmin(total), total.shape)
            todo += [(right, y[k], end), (left, start, x[m])]
        return out

    return walk(2 * n - 2)


def bisected(cov: np.ndarray, order: list[int]) -> np.ndarray:
    """Weights by halving the order and sharing by inverse cluster variance."""
    weights = np.ones(len(cov))

    def variance(part: list[int]) -> float:
        own = cov[np.ix_(part, part)]
        w = 1 / np.diag(own)
        w /= w.sum()
        return float(w @ own @ w)

    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = variance(left), variance(right)
        alpha = 1 - a / (a + b)
        weights[left] *= alpha
        weights[right] *= 1 - alpha
        todo += [left, right]
    return weights


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    """Long-only weights of least variance: an active-set solution of min x'Cx/2 - 1'x, x >= 0, normalised."""
    n = len(cov)
    scale = float(np.trace(cov)) / max(n, 1)
    c = cov / scale if scale > 0 else np.eye(n)
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(10 * n + 10):
        gain = 1 - c @ x
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-12:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            own = c[np.ix_(at, at)]
            try:
                s = np.linalg.solve(own, np.ones(len(at)))
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(own, np.ones(len(at)), rcond=None)[0]
            if s.min() > 0:
                break
            low = s <= 0
            step = np.min(x[at][low] / (x[at][low] - s[low]))
            x[at] += step * (s - x[at])
            used[at[low & (x[at] <= 1e-14)]] = False
            x[~used] = 0.0
        x[:] = 0.0
        x[at] = s
    return x / x.sum()


def hrp_by_period(cov: DataFrame) -> DataFrame:
    """(period, symbol, pos, weight) from (period, i, j, cov[, id_i])."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, c = square(pdf)
        order = leaf_order(len(c), single_linkage(distances(c)))
        w = bisected(c, order)
        return pd.DataFrame({"period": pdf["period"].iloc[0], "symbol": [names[k] for k in order], "pos": range(len(order)), "weight": w[order]})

    return cov.groupBy("period").applyInPandas(run, "period long, symbol string, pos long, weight double")


def shortest_order_by_period(cov: DataFrame) -> DataFrame:
    """(period, symbol, pos, gap): leaves in the shortest order of the tree; gap is the distance to the leaf before, null for the first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, c = square(pdf)
        d = distances(c)
        order = shortest_order(d, single_linkage(d))
        gaps = [None, *(float(d[a, b]) for a, b in zip(order, order[1:], strict=False))]
        return pd.DataFrame({"period": pdf["period"].iloc[0], "symbol": [names[k] for k in order], "pos": range(len(order)), "gap": gaps})

    return cov.groupBy("period").applyInPandas(run, "period long, symbol string, pos long, gap double")


def linkage_by_period(cov: DataFrame) -> DataFrame:
    """(period, step, left, right, dist, size) of the tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, c = square(pdf)
        rows = [(k, *m) for k, m in enumerate(single_linkage(distances(c)))]
        return pd.DataFrame(rows, columns=["step", "left", "right", "dist", "size"]).assign(period=pdf["period"].iloc[0])

    return cov.groupBy("period").applyInPandas(run, "period long, step long, left long, right long, dist double, size long")


def mvp_by_period(cov: DataFrame) -> DataFrame:
    """(period, symbol, weight) of least variance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, c = square(pdf)
        return pd.DataFrame({"period": pdf["period"].iloc[0], "symbol": names, "weight": minimum_variance(c)})

    return cov.groupBy("period").applyInPandas(run, "period long, symbol string, weight double")


def eigenvalues_by_group(cov: DataFrame) -> DataFrame:
    """(period, rank, value): eigenvalues, largest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.linalg.eigvalsh(square(pdf)[1])[::-1]
        return pd.DataFrame({"period": pdf["period"].iloc[0], "rank": range(1, len(values) + 1), "value": values})

    return cov.groupBy("period").applyInPandas(run, "period long, rank long, value double")
