"""Portfolio operators: kernels against plain NumPy, hand-made panels, and queries against SQL."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballastry.functions.numeric import compounded
from ballastry.operators import backtest, kernels, metrics, moments, panel, strategies, transition
from ballastry.plans.oracles import ORACLES
from ballastry.plans.queries import QUERIES
from compare import differences

SF = "/root/testdata/sf0.01"
DAY = dt.date(2024, 1, 1)


def prices(spark, table: dict[str, list]):
    rows = [(DAY + dt.timedelta(days=k), s, None if v is None else float(v)) for s, own in table.items() for k, v in enumerate(own) if v is not None]
    return spark.createDataFrame(rows, "d date, symbol string, close double")


def market(spark, table, train, step=1, periods=1):
    px = panel.indexed(prices(spark, table)).persist()
    return strategies.Market(px, panel.returns(px).persist(), panel.Windows(train, step, periods))


def weights(df):
    return {r["symbol"]: r["weight"] for r in df.collect()}


def random_walks(n, days, seed=0):
    rng = np.random.default_rng(seed)
    return {f"S{k:02d}": list(100 * np.cumprod(1 + rng.normal(0, 0.01 * (k + 1), days))) for k in range(n)}


@pytest.mark.parametrize(
    "name",
    [
        "returns_nofill", "returns_pad_rowdrop", "price_grid", "calendar_windows", "training_rows", "corr_matrix", "ivp_weights", "mvp_kkt", "hrp_weights", "csm_momentum", "tsm_ma_voltarget",
        "rmm_weights", "mh_weights", "metrics_full", "transition_decision", "carry_backtest", "leaderboard", "monte_carlo_frontier", "normal_overlay", "event_klines", "upsert_by_key", "profile_summary", "listing_topn",
    ],
)
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_gaps(spark):
    table = {"A": [10, 11, None, 12, 24, 24], "B": [None, None, 5, 10, 10, 5], "C": [1, 2, 4, 8, None, None]}
    px = panel.indexed(prices(spark, table))
    got = {(r["symbol"], r["t_idx"]): r["ret"] for r in panel.returns(px).collect()}
    assert set(got) == {("A", 1), ("A", 4), ("A", 5), ("B", 3), ("B", 4), ("B", 5), ("C", 1), ("C", 2), ("C", 3)}
    assert got["A", 4] == 1.0 and got["B", 5] == -0.5
    padded = {(r["symbol"], r["t_idx"]): r["ret"] for r in panel.returns_padded(px).collect()}
    assert {t for _, t in padded} == {3, 4, 5} and padded["C", 4] == 0.0
    assert padded["A", 3] == pytest.approx(12 / 11 - 1)
    observed = {(r["symbol"], r["d"].day): r["ret"] for r in panel.returns_observed(prices(spark, table)).collect()}
    assert observed["A", 4] == pytest.approx(12 / 11 - 1) and observed["B", 3] is None
    assert panel.densify(px).count() == 18


def test_window_periods(spark):
    px = panel.indexed(prices(spark, {"A": range(1, 31)}))
    w = panel.Windows.over(px, 10, 3)
    assert w.periods == (30 - 10 - 3) // 3
    got = {(r["period"], r["t_idx"]) for r in w.training(px).select("period", "t_idx").collect()}
    assert got == {(p, t) for p in range(w.periods) for t in range(p * 3 + 1, p * 3 + 11)}
    got = {(r["period"], r["t_idx"]) for r in w.testing(px).select("period", "t_idx").collect()}
    assert got == {(p, t) for p in range(w.periods) for t in range(p * 3 + 11, p * 3 + 14)}


def test_moments(spark):
    table = random_walks(4, 40)
    m = market(spark, table, 39)
    x = np.array([np.diff(v) / np.array(v[:-1]) for v in table.values()])
    cov = np.cov(x)
    names = list(table)
    got = {(r["i"], r["j"]): r["cov"] for r in m.cov.collect()}
    assert all(got[names[i], names[j]] == pytest.approx(cov[i, j]) for i in range(4) for j in range(i, 4))
    flat = market(spark, table | {"Z": [5.0] * 40}, 39)
    corr = {(r["i"], r["j"]): (r["corr"], r["dist"]) for r in moments.correlations(flat.cov).collect()}
    assert corr["S00", "Z"] == (None, 0.0)


def test_kernels():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 25):
        x = rng.standard_normal((3 * n + 5, n)) @ rng.standard_normal((n, n))
        cov = np.atleast_2d(np.cov(x.T))
        w = kernels.minimum_variance(cov)
        g = cov @ w
        v = w @ g
        assert w.sum() == pytest.approx(1) and w.min() >= 0
        assert np.abs(g[w > 1e-9] - v).max() <= 1e-6 * v and g.min() >= v * (1 - 1e-6)
        order = kernels.leaf_order(n, kernels.single_linkage(kernels.distances(cov)))
        assert sorted(order) == list(range(n))
        h = kernels.bisected(cov, order)
        assert h.sum() == pytest.approx(1) and h.min() > 0
        assert np.allclose(h, kernels.bisected(cov * 9, order))
        assert w @ cov @ w <= h @ cov @ h + 1e-12
    diagonal = np.diag([1.0, 4.0, 2.0, 8.0])
    ivp = (1 / np.diag(diagonal)) / (1 / np.diag(diagonal)).sum()
    assert np.allclose(kernels.bisected(diagonal, [2, 0, 3, 1]), ivp) and np.allclose(kernels.minimum_variance(diagonal), ivp)
    singular = np.ones((3, 3))
    assert kernels.minimum_variance(singular).sum() == pytest.approx(1)
    d = np.array([[0, 1, 5, 6], [1, 0, 4, 7], [5, 4, 0, 2], [6, 7, 2, 0]], dtype=float)
    assert kernels.single_linkage(d) == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 4.0, 4)]


def test_strategy_rules(spark):
    table = random_walks(10, 70, 5)
    m = market(spark, table, 69)
    x = {s: np.diff(v) / np.array(v[:-1]) for s, v in table.items()}
    score = {s: np.prod(1 + r[-22:-1]) - 1 for s, r in x.items()}
    rank = sorted(score, key=lambda s: (-score[s], s))
    got = weights(strategies.cross_sectional(m))
    assert {s for s, w in got.items() if w > 0} == set(rank[:3]) and got[rank[0]] == pytest.approx(1 / 3)
    got = weights(strategies.cross_sectional(m, scheme="inverse_vol"))
    inverse = {s: 1 / x[s].std(ddof=1) for s in rank[:3]}
    assert all(got[s] == pytest.approx(inverse[s] / sum(inverse.values())) for s in rank[:3])
    chosen = {r["symbol"] for r in strategies.momentum_selection(m).where("chosen").collect()}
    assert chosen == set(rank[:5])
    for name, rule in strategies.STRATEGIES.items():
        own = weights(rule(m))
        assert sum(own.values()) == pytest.approx(1), name
        assert min(own.values()) >= -1e-12
    scaled = strategies.risk_managed(m).first()
    raw = np.mean([x[s] for s in rank[:3]], axis=0)[-63:]
    assert scaled["realized_vol"] == pytest.approx(raw.std(ddof=1) * math.sqrt(365))
    assert 0.25 <= scaled["scale"] <= 2.0
    with pytest.raises(ValueError):
        strategies.cross_sectional(m, scheme="other")
    with pytest.raises(ValueError):
        strategies.time_series(m, signal="other")


def test_falling_prices_fall_back_to_equal_weights(spark):
    m = market(spark, {s: [100 * (1 - 0.01 * (k + 1)) ** t for t in range(40)] for k, s in enumerate("ABC")}, 39)
    assert all(w == pytest.approx(1 / 3) for w in weights(strategies.time_series(m)).values())


def test_metrics_edges(spark):
    up = spark.createDataFrame([("up", t, 0.01 * (t + 1)) for t in range(5)] + [("flat", t, 0.0) for t in range(5)], "strategy string, t_idx long, ret double")
    got = {r["strategy"]: r for r in metrics.full_metrics(up).collect()}
    assert got["up"]["sortino"] == got["up"]["calmar"] == got["up"]["profit_factor"] == math.inf
    assert got["up"]["win_rate_pct"] == 100 and got["flat"]["sharpe"] == 0.0
    dd = [r["dd"] for r in metrics.drawdowns(metrics.cumulative(up)).collect()]
    assert all(-1 <= x <= 0 for x in dd)
    one = spark.range(1).select(F.lit(None).cast("double").alias("r"))
    assert one.agg(compounded(F.col("r")).alias("x")).first()["x"] == 0.0


def test_turnover_and_decision(spark):
    m = market(spark, random_walks(3, 40, 7), 39)
    frame = lambda rows: spark.createDataFrame(rows, "strategy string, period long, symbol string, weight double")
    old = frame([("X", 0, "S00", 0.5), ("X", 0, "GONE", 0.5)])
    new = frame([("X", 0, "S00", 0.25), ("X", 0, "S01", 0.75)])
    assert transition.turnover_union(old, new).first()["turnover"] == pytest.approx(1.5)
    cost = transition.costs(old, new, m.universe).first()
    assert cost["turnover"] == pytest.approx(1.0) and cost["cost"] == pytest.approx(0.001)
    out = transition.analyze(old, new, m).first()
    assert out["recommendation"] == (out["sharpe_improvement"] > 0.001)
    assert transition.analyze(old, new, m, threshold=None).first()["recommendation"] is True


def test_carried_costs_equal_a_fold(spark):
    m = market(spark, random_walks(4, 60, 9), 20, 6, 6)
    w = strategies.weights_of(m, ["IVP"]).persist()
    rows = backtest.carried(m, w).orderBy("t_idx").collect()
    drift = {(r["period"], r["symbol"]): r["weight"] for r in backtest.drifted(m, w).collect()}
    own = {(r["period"], r["symbol"]): r["weight"] for r in w.collect()}
    value, want = 1.0, []
    for p in sorted({r["period"] for r in rows}):
        cost = 0.001 * sum(abs(v - drift[p - 1, s]) for (q, s), v in own.items() if q == p) if p else 0.0
        if p:
            value -= cost
            want[-1] -= cost
        for r in rows:
            if r["period"] == p:
                value *= 1 + r["ret"]
                want.append(value)
    assert np.allclose([r["cum"] for r in rows], want)


def test_all_periods_against_numpy(spark):
    m = QUERIES["training_rows"].__globals__["market"](spark, SF)
    rows = m.train.select("period", "t_idx", "symbol", "ret").toPandas()
    whole = {p: own.pivot(index="t_idx", columns="symbol", values="ret").dropna(axis=1) for p, own in rows.groupby("period")}
    whole = {p: x for p, x in whole.items() if len(x) == m.windows.train and x.shape[1] > 1}
    assert len(whole) == m.windows.periods > 1
    got = {n: QUERIES[n](spark, SF).toPandas() for n in ("second_order_distance", "hrp_leaf_order", "hrp_weights", "tsm_growth_index", "mh_weights", "monte_carlo_frontier", "frontier_argmax")}
    got["eigenvalues"] = QUERIES["eigenvalues_all"](spark, SF).toPandas()
    by = {n: dict(list(df.groupby("period"))) for n, df in got.items()}
    assert all(set(own) == set(whole) for own in by.values())
    unit = lambda *key: int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32
    for p, x in whole.items():
        names, cov = list(x.columns), np.cov(x.to_numpy().T)
        dist = kernels.distances(cov)
        far = by["second_order_distance"][p]
        at = [[names.index(s) for s in far[c]] for c in ("i", "j")]
        assert np.allclose(far["dist2"], np.linalg.norm(dist[at[0]] - dist[at[1]], axis=1), atol=1e-6) and len(far) == len(names) * (len(names) - 1) // 2
        order = kernels.leaf_order(len(names), kernels.single_linkage(dist))
        assert by["hrp_leaf_order"][p].sort_values("pos")["symbol"].tolist() == [names[k] for k in order]
        w = by["hrp_weights"][p].set_index("symbol")["weight"]
        assert np.allclose(w[names], kernels.bisected(cov, order), atol=1e-7)
        g = by["tsm_growth_index"][p].pivot(index="t_idx", columns="symbol", values="growth")
        assert np.allclose(g[names], (1 + x).cumprod(), rtol=1e-6)
        score = ((1 + x.iloc[-22:-1]).prod() - 1).to_dict()
        won = sorted(names, key=lambda s: (-score[s], s))[: max(5, int(len(names) * 0.4))]
        own = x[won].to_numpy()
        c = np.cov(own.T)
        want = dict.fromkeys(names, 0.0) | dict(zip(won, kernels.bisected(c, kernels.leaf_order(len(won), kernels.single_linkage(kernels.distances(c))))))
        w = by["mh_weights"][p].set_index("symbol")["weight"]
        assert np.allclose(w[names], [want[s] for s in names], atol=1e-7)
        front = by["monte_carlo_frontier"][p].sort_values("portfolio")
        u = np.array([[unit(k, s) for s in names] for k in front["portfolio"].head(20)])
        u /= u.sum(axis=1, keepdims=True)
        mean, vol = u @ x.mean().to_numpy(), np.sqrt(np.einsum("ki,ij,kj->k", u, cov, u))
        assert np.allclose(front["ret"].head(20), mean, rtol=1e-6, atol=1e-6) and np.allclose(front["vol"].head(20), vol, rtol=1e-6, atol=1e-6)
        ends = by["frontier_argmax"][p].iloc[0]
        at = front.set_index("portfolio")
        assert at["sharpe"][ends["max_sharpe"]] == at["sharpe"].max() and at["vol"][ends["min_vol"]] == at["vol"].min()
        named = sorted(names, key=lambda s: hashlib.md5(s.encode()).hexdigest())
        assert len(front) == 5000
        sizes = {min(k, len(names)) for k in (2, 5, 10, 20, 30, 40, len(names))}
        assert set(by["eigenvalues"][p]["size"]) == sizes
        for size, own in by["eigenvalues"][p].groupby("size"):
            part = [names.index(s) for s in named[:size]]
            assert np.allclose(own.sort_values("rank")["value"], np.linalg.eigvalsh(cov[np.ix_(part, part)])[::-1], rtol=1e-6, atol=1e-8)


def test_pivot_of_all_symbols(spark):
    px = QUERIES["price_grid"].__globals__["market"](spark, SF).px.toPandas()
    wide = QUERIES["price_pivot"](spark, SF).toPandas().set_index("d")
    want = px.assign(symbol=px["symbol"].str.lower().str.replace("#", "_")).pivot(index="d", columns="symbol", values="close")
    assert set(wide.columns) == set(want.columns) and len(wide.columns) > 3
    assert np.allclose(wide.loc[want.index, want.columns].astype(float), want.astype(float), atol=1e-4, equal_nan=True)
