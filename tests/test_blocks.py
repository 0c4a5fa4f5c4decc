"""Covariances from block states and bisections as tables, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from ballastry.operators import blocks, hierarchy, kernels, moments, panel
from ballastry.plans.oracles import ORACLES
from ballastry.plans.queries import QUERIES
from compare import differences
from test_portfolio import SF, market, random_walks


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("name", ["cov_matrix", "hrp_nodes", "hrp_path_weights"])
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


@pytest.mark.parametrize(("train", "step"), [(8, 4), (9, 6), (7, 3), (5, 5), (4, 8)])
def test_blocks_equal_whole_windows(spark, train, step):
    walks = random_walks(4, 40, seed=train)
    walks["GAP"] = [None if k in (11, 30) else v for k, v in enumerate(walks["S01"])]
    walks["FLAT"] = [7.0] * 40
    px = panel.indexed(market(spark, walks, train, step).px.select("d", "symbol", "close"))
    rets, windows = panel.returns(px), panel.Windows.over(px, train, step)
    got = table(blocks.merged_covariances(rets, windows), "period", "i", "j")
    want = table(moments.covariances(rets, windows), "period", "i", "j")
    assert windows.periods > 2 and got.keys() == want.keys()
    assert {k[0] for k in got if "GAP" in k} < {k[0] for k in got}
    for key, row in want.items():
        assert got[key]["cov"] == pytest.approx(row["cov"], rel=1e-10, abs=1e-18)
    assert all(row["cov"] == 0 for key, row in got.items() if "FLAT" in key)


def test_pair_rows_do_not_grow_with_windows(spark):
    m = market(spark, random_walks(5, 61), 20, 4)
    pairs = blocks.pair_blocks(blocks.symbol_blocks(m.rets, 4))
    assert pairs.count() == 15 * (60 // 4)


def test_no_rows_and_single_dates(spark):
    m = market(spark, random_walks(3, 10), 4)
    assert blocks.merged_covariances(m.rets.limit(0), m.windows).collect() == []
    ones = blocks.merged_covariances(m.rets, panel.Windows(1, 1, 3)).collect()
    assert len(ones) == 18 and all(r["cov"] is None for r in ones)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 13])
def test_bisection_equals_recursion(spark, n):
    rng = np.random.default_rng(n)
    c = np.cov(rng.normal(size=(n, 40)) * rng.uniform(0.5, 2, (n, 1)), ddof=1).reshape(n, n)
    names = [f"S{k:02d}" for k in range(n)]
    cov = spark.createDataFrame([(p, names[i], names[j], float(c[i, j]) * (p + 1)) for p in (0, 3) for i in range(n) for j in range(i, n)], "period long, i string, j string, cov double")
    order = [int(k) for k in rng.permutation(n)]
    placed = spark.createDataFrame([(p, names[k], pos) for p in (0, 3) for pos, k in enumerate(order)], "period long, symbol string, pos long")
    paths = hierarchy.bisection_paths(placed)
    nodes = hierarchy.bisection_nodes(paths, cov)
    found = table(nodes, "period", "node")

    def check(node, part, scale):
        own = c[np.ix_(part, part)] * scale
        w = 1 / np.diag(own)
        w /= w.sum()
        row = found[{1: 0, 4: 3}[scale], node]
        assert row["n_leaves"] == len(part) and order[row["lo"]] == part[0]
        assert row["variance"] == pytest.approx(float(w @ own @ w), rel=1e-12)
        half = len(part) // 2
        return 1 + (check(2 * node, part[:half], scale) + check(2 * node + 1, part[half:], scale) if half else 0)

    assert check(1, order, 1) + check(1, order, 4) == len(found) == 2 * (2 * n - 1)
    want = kernels.bisected(c, order)
    for (_, symbol), row in table(hierarchy.bisection_weights(paths, nodes), "period", "symbol").items():
        assert row["weight"] == pytest.approx(want[names.index(symbol)], rel=1e-12)


def test_assets_without_variance(spark):
    rows = [("A", "A", 0.0), ("A", "B", 0.0), ("A", "C", 0.0), ("B", "B", 2.0), ("B", "C", 0.5), ("C", "C", 1.0)]
    cov = spark.createDataFrame([(0, *r) for r in rows], "period long, i string, j string, cov double")
    paths = hierarchy.bisection_paths(spark.createDataFrame([(0, "A", 0), (0, "B", 1), (0, "C", 2)], "period long, symbol string, pos long"))
    nodes = hierarchy.bisection_nodes(paths, cov)
    found = table(nodes, "node")
    assert found[(2,)]["variance"] is None and found[(2,)]["share"] is None and found[(3,)]["share"] is None
    assert found[(6,)]["share"] + found[(7,)]["share"] == pytest.approx(1)
    assert all(r["weight"] is None for r in hierarchy.bisection_weights(paths, nodes).collect())
