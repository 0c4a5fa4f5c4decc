"""The shortest leaf order against all flips of the tree."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballastry.operators import kernels
from ballastry.plans.panels import market
from ballastry.plans.queries import QUERIES
from test_portfolio import SF


def all_orders(n, merges):
    orders = {k: [[k]] for k in range(n)}
    for k, (left, right, _, _) in enumerate(merges):
        orders[n + k] = [p for a in orders[left] for b in orders[right] for p in (a + b, b + a)]
    return orders[2 * n - 2] if n else [[]]


def length(dist, order):
    return sum(dist[a, b] for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("n", range(9))
def test_no_flip_is_shorter(n):
    for seed in range(6):
        rng = np.random.default_rng(100 * n + seed)
        dist = rng.integers(0, 4, (n, n)) / 4 if seed % 2 else rng.uniform(size=(n, n))  # with ties, and without
        dist = np.triu(dist, 1) + np.triu(dist, 1).T
        merges = kernels.single_linkage(dist)
        got = kernels.shortest_order(dist, merges)
        orders = all_orders(n, merges)
        assert got in orders
        assert length(dist, got) == pytest.approx(min(length(dist, o) for o in orders), abs=1e-12)
        assert got == kernels.shortest_order(dist, merges)


def test_query_orders_every_period(spark):
    got = QUERIES["cluster_plot_order"](spark, SF).toPandas()
    m = market(spark, SF)
    gaps = {}
    for (period, symbol), row in kernels.hrp_by_period(m.cov).toPandas().set_index(["period", "symbol"]).iterrows():
        gaps.setdefault(period, {})[row["pos"]] = symbol
    dist = {}
    for period, pdf in m.cov.where(F.col("period") % 20 == 0).toPandas().groupby("period"):
        names, c = kernels.square(pdf)
        dist[period] = (names, kernels.distances(c))
    assert set(got["period"]) == set(gaps)
    for period, own in got.groupby("period"):
        own = own.sort_values("pos")
        assert sorted(own["symbol"]) == sorted(gaps[period].values()) and list(own["pos"]) == list(range(len(own)))
        if period in dist:
            names, d = dist[period]
            plain = [names.index(gaps[period][k]) for k in range(len(names))]
            mine = [names.index(s) for s in own["symbol"]]
            assert own["gap"].sum() == pytest.approx(length(d, mine), abs=1e-6)
            assert length(d, mine) <= length(d, plain) + 1e-12
            # every cluster of the tree is a run of the order
            where, sets = {k: p for p, k in enumerate(mine)}, {k: {k} for k in range(len(names))}
            for k, (left, right, _, _) in enumerate(kernels.single_linkage(d)):
                sets[len(names) + k] = sets[left] | sets[right]
                places = [where[x] for x in sets[len(names) + k]]
                assert max(places) - min(places) == len(places) - 1
