"""The registered queries, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballastry.operators import analysis, backtest, hierarchy, kernels, metrics, moments, panel, strategies, transition
from ballastry.plans.panels import load, market
from ballastry.plans.panels import panel as prices_of
from ballastry.schema import STABLE_PAIRS
from ballastry.session import kept
from ballastry.sources import klines, prices, store
from ballastry.streaming.candles import candles

#: Strategies whose rules SQL can express for all periods at once.
PLAIN = ["IVP", "CS_MOM", "TS_MOM", "RM_MOM"]
QUERIES: dict = {}


#: Doubles from here on are rounded to nine digits in all, because compounded weekly panels grow past any fixed place.
LARGE = 1e4


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """df with its doubles rounded, and no negative zeros."""

    def near(c: str):
        plain = F.round(c, digits) + F.lit(0.0)
        return F.when(F.abs(plain) >= LARGE, F.format_string("%.8e", plain).cast("double")).otherwise(plain).alias(c)

    return df.select(*[near(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f):
    QUERIES[f.__name__] = f
    return f


def plain(spark: SparkSession, sf_dir: str):
    m = market(spark, sf_dir)
    return m, kept(strategies.weights_of(m, PLAIN))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w = plain(spark, sf_dir)
    return backtest.rolling(m, w)


# Panel and windows


@query
def returns_nofill(spark, sf_dir):
    return rounded(market(spark, sf_dir).rets.select("d", "symbol", "ret"))


@query
def returns_pad_rowdrop(spark, sf_dir):
    return rounded(panel.returns_padded(market(spark, sf_dir).px).select("d", "symbol", "ret"))


@query
def returns_grouped_pad(spark, sf_dir):
    return rounded(panel.returns_observed(prices_of(spark, sf_dir)).select("d", "symbol", "ret"))


@query
def universe_complete(spark, sf_dir):
    return market(spark, sf_dir).universe


@query
def symbols_null_after_date(spark, sf_dir):
    m = market(spark, sf_dir)
    grid = panel.densify(m.px).join(m.rets.select("symbol", "t_idx", "ret"), ["symbol", "t_idx"], "left")
    return panel.null_after(grid, F.lit("1999-01-01").cast("date"))


@query
def price_pivot(spark, sf_dir):
    """The prices of all symbols, a column each."""
    wide = market(spark, sf_dir).px.groupBy("d").pivot("symbol").agg(F.first("close"))
    return rounded(wide.withColumnsRenamed({c: c.lower().replace("#", "_") for c in wide.columns}), 4)


@query
def pivot_mean(spark, sf_dir):
    wide = load(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_discount"))
    return rounded(wide)


@query
def calendar_windows(spark, sf_dir):
    m = market(spark, sf_dir)
    return m.windows.table(m.px)


@query
def price_grid(spark, sf_dir):
    return rounded(panel.densify(market(spark, sf_dir).px).select("d", "symbol", "close"), 4)


@query
def training_rows(spark, sf_dir):
    return market(spark, sf_dir).train.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi"))


@query
def pair_generator(spark, sf_dir):
    names = prices_of(spark, sf_dir).select(F.concat("symbol", F.lit("USDT")).alias("symbol")).distinct()
    return panel.pair_names(names)


@query
def segment_returns(spark, sf_dir):
    return rounded(panel.returns(panel.indexed(prices_of(spark, sf_dir, "segment_day"))).select("d", "symbol", "ret"))


# Moments and strategies


@query
def cov_matrix(spark, sf_dir):
    return rounded(market(spark, sf_dir).cov, 10)


@query
def corr_matrix(spark, sf_dir):
    return rounded(moments.correlations(market(spark, sf_dir).cov).select("period", "i", "j", "corr"))


@query
def hrp_distance(spark, sf_dir):
    return rounded(moments.correlations(market(spark, sf_dir).cov).where("i < j").select("period", "i", "j", "dist"))


@query
def second_order_distance(spark, sf_dir):
    return rounded(moments.second_order_distance(moments.correlations(market(spark, sf_dir).cov)).where("i < j"), 7)


@query
def ivp_weights(spark, sf_dir):
    return rounded(strategies.inverse_variance(market(spark, sf_dir)))


@query
def mvp_kkt(spark, sf_dir):
    """Whether the optimality conditions of the minimum-variance weights hold, by period."""
    m = market(spark, sf_dir)
    w = kept(strategies.minimum_variance(m))
    full = moments.both_ways(m.cov)
    grad = full.join(w.select("period", F.col("symbol").alias("j"), "weight"), ["period", "j"]).groupBy("period", F.col("i").alias("symbol")).agg(F.sum(F.col("cov") * F.col("weight")).alias("g"))
    var = moments.quadratic(w, m.cov, ["period"])
    n = F.count(F.lit(1)).over(strategies.by_period())
    even = moments.quadratic(w.withColumn("weight", 1.0 / n), m.cov, ["period"]).withColumnRenamed("var", "even")
    rows = w.join(grad, ["period", "symbol"]).join(var, "period").join(even, "period")
    return rows.groupBy("period").agg(
        (F.abs(F.sum("weight") - 1) < 1e-9).alias("sum_ok"),
        (F.min("weight") >= -1e-12).alias("nonneg_ok"),
        ((F.max(F.when(F.col("weight") > 1e-9, F.abs(F.col("g") - F.col("var")) / F.col("var"))) <= 1e-6) & (F.min(F.col("g") / F.col("var")) >= 1 - 1e-6)).alias("kkt_ok"),
        (F.max(F.col("var") - F.col("even")) <= 1e-15).alias("best_ok"),
    )


@query
def mvp_weights(spark, sf_dir):
    return rounded(strategies.minimum_variance(market(spark, sf_dir)))


@query
def hrp_leaf_order(spark, sf_dir):
    return kernels.hrp_by_period(market(spark, sf_dir).cov).select("period", "symbol", "pos")


@query
def hrp_weights(spark, sf_dir):
    return rounded(strategies.hierarchical(market(spark, sf_dir)))


@query
def hrp_linkage(spark, sf_dir):
    return rounded(kernels.linkage_by_period(market(spark, sf_dir).cov))


@query
def hrp_cluster_var(spark, sf_dir):
    """The inverse-variance portfolio's variance over the whole universe as one cluster, by period."""
    m = market(spark, sf_dir)
    return rounded(moments.quadratic(strategies.inverse_variance(m), m.cov, ["period"]).withColumnRenamed("var", "cluster_var"), 10)


@query
def cluster_plot_order(spark, sf_dir):
    """The order of a cluster plot: of all orders that the tree allows, the one with the nearest neighbours."""
    return rounded(kernels.shortest_order_by_period(market(spark, sf_dir).cov))


def bisected(spark, sf_dir):
    """Paths of all assets in the clustering's order, and all nodes of the bisection."""
    m = market(spark, sf_dir)
    paths = kept(hierarchy.bisection_paths(kernels.hrp_by_period(m.cov).select("period", "symbol", "pos")))
    return paths, hierarchy.bisection_nodes(paths, m.cov)


@query
def hrp_nodes(spark, sf_dir):
    """Variance and share of every cluster of the bisection, by period."""
    return rounded(bisected(spark, sf_dir)[1], 10)


@query
def hrp_path_weights(spark, sf_dir):
    """Hierarchical weights as products of shares along the paths."""
    return rounded(hierarchy.bisection_weights(*bisected(spark, sf_dir)))


@query
def csm_scores(spark, sf_dir):
    return rounded(market(spark, sf_dir).scores().select("period", "symbol", "score"))


@query
def csm_select(spark, sf_dir):
    return strategies.cross_sectional(market(spark, sf_dir)).where("weight > 0").select("period", "symbol")


@query
def csm_equal(spark, sf_dir):
    return rounded(strategies.cross_sectional(market(spark, sf_dir)))


@query
def csm_momentum(spark, sf_dir):
    return rounded(strategies.cross_sectional(market(spark, sf_dir), scheme="momentum"))


@query
def csm_inverse_vol(spark, sf_dir):
    return rounded(strategies.cross_sectional(market(spark, sf_dir), scheme="inverse_vol"))


@query
def tsm_growth_index(spark, sf_dir):
    return rounded(strategies.growth_index(market(spark, sf_dir)))


@query
def tsm_ma_equal(spark, sf_dir):
    return rounded(strategies.time_series(market(spark, sf_dir)))


@query
def tsm_ma_voltarget(spark, sf_dir):
    return rounded(strategies.time_series(market(spark, sf_dir), sizing="volatility_target"))


@query
def tsm_abs_equal(spark, sf_dir):
    return rounded(strategies.time_series(market(spark, sf_dir), signal="absolute"))


@query
def tsm_abs_voltarget(spark, sf_dir):
    return rounded(strategies.time_series(market(spark, sf_dir), signal="absolute", sizing="volatility_target"))


@query
def rmm_raw(spark, sf_dir):
    return rounded(strategies.risk_managed(market(spark, sf_dir)).select("period", "symbol", "raw_weight"))


@query
def rmm_realized_vol(spark, sf_dir):
    return rounded(strategies.risk_managed(market(spark, sf_dir)).select("period", "realized_vol", "scale").distinct())


@query
def rmm_weights(spark, sf_dir):
    return rounded(strategies.risk_managed(market(spark, sf_dir)).select("period", "symbol", "weight", "scaled_weight"))


@query
def mh_select(spark, sf_dir):
    return strategies.momentum_selection(market(spark, sf_dir)).where("chosen").select("period", "symbol", "rn")


@query
def mh_weights(spark, sf_dir):
    return rounded(strategies.momentum_hierarchical(market(spark, sf_dir)))


@query
def hodl(spark, sf_dir):
    """The first two symbols, each held alone."""
    m = market(spark, sf_dir)
    held = [strategies.hold(m, s).withColumn("strategy", F.lit(f"HODL {s}")) for s in ("Brand#1", "Brand#10")]
    return rounded(metrics.cumulative(backtest.static(m, held[0].unionByName(held[1]))))


# Series and metrics


@query
def portfolio_returns(spark, sf_dir):
    return rounded(series(spark, sf_dir))


@query
def cumulative(spark, sf_dir):
    return rounded(metrics.cumulative(series(spark, sf_dir)).select("strategy", "t_idx", "cum"))


@query
def drawdowns(spark, sf_dir):
    return rounded(metrics.drawdowns(metrics.cumulative(series(spark, sf_dir))).select("strategy", "t_idx", "dd"))


@query
def rolling_sharpe(spark, sf_dir):
    return rounded(metrics.rolling_sharpe(series(spark, sf_dir)), 6)


@query
def metrics_full(spark, sf_dir):
    return rounded(metrics.full_metrics(series(spark, sf_dir)), 6)


@query
def metrics_basic(spark, sf_dir):
    return rounded(metrics.basic_metrics(series(spark, sf_dir)), 6)


@query
def effective_n(spark, sf_dir):
    return rounded(metrics.concentration(plain(spark, sf_dir)[1], ["strategy", "period"]), 6)


@query
def turnover_union(spark, sf_dir):
    w = plain(spark, sf_dir)[1]
    return rounded(transition.turnover_union(transition.previous(w), w))


@query
def transition_turnover_cost(spark, sf_dir):
    m, w = plain(spark, sf_dir)
    return rounded(transition.costs(transition.previous(w), w, m.universe))


@query
def transition_decision(spark, sf_dir):
    m, w = plain(spark, sf_dir)
    out = transition.analyze(transition.previous(w), w, m)
    flat = out.select(
        "strategy", "period", "recommendation", F.col("current_portfolio.expected_return").alias("c_return"), F.col("current_portfolio.volatility").alias("c_vol"),
        F.col("proposed_portfolio.sharpe_ratio").alias("p_sharpe"), "transaction_costs", "adjusted_sharpe_ratio", "sharpe_improvement", "turnover",
    )
    return rounded(flat, 7)


@query
def static_backtest(spark, sf_dir):
    m, w = plain(spark, sf_dir)
    return rounded(metrics.cumulative(backtest.static(m, w)))


@query
def rolling_backtest_all(spark, sf_dir):
    """All seven strategies: series metrics, concentration and trading totals."""
    m = market(spark, sf_dir)
    return rounded(backtest.dynamic_metrics(m, kept(strategies.weights_of(m, list(strategies.STRATEGIES)))), 6)


@query
def turnover_table(spark, sf_dir):
    m, w = plain(spark, sf_dir)
    return rounded(backtest.turnover_table(m, w), 7)


@query
def drift_weights(spark, sf_dir):
    m = market(spark, sf_dir)
    return rounded(backtest.drifted(m, strategies.weights_of(m, ["IVP"])))


@query
def carry_backtest(spark, sf_dir):
    m = market(spark, sf_dir, extra=2)
    return rounded(backtest.carried(m, kept(strategies.weights_of(m, ["IVP"]))), 7)


@query
def carry_backtest_all(spark, sf_dir):
    m = market(spark, sf_dir, extra=2)
    return rounded(backtest.carried(m, kept(strategies.weights_of(m, ["HRP", "IVP", "MVP"]))), 7)


@query
def compare_vs_baseline(spark, sf_dir):
    return rounded(backtest.against(metrics.full_metrics(series(spark, sf_dir)), "IVP"), 6)


@query
def relative_performance(spark, sf_dir):
    return rounded(backtest.relative(series(spark, sf_dir), "IVP"))


# Charts and reports


@query
def log_growth(spark, sf_dir):
    return rounded(analysis.log_growth(series(spark, sf_dir)))


@query
def return_histogram(spark, sf_dir):
    return rounded(analysis.histogram(series(spark, sf_dir)))


@query
def weights_kde(spark, sf_dir):
    """The density of each strategy's weights over all periods."""
    return rounded(analysis.density(plain(spark, sf_dir)[1].select("strategy", F.col("weight").alias("value"))).withColumn("density", F.round("density", 6)))


@query
def normal_overlay(spark, sf_dir):
    return rounded(analysis.normal_overlay(series(spark, sf_dir)), 6)


@query
def risk_return(spark, sf_dir):
    return rounded(metrics.full_metrics(series(spark, sf_dir)).select("strategy", "annualized_vol_pct", "annualized_return_pct", "max_drawdown_pct", "sharpe"), 6)


@query
def top15_weights(spark, sf_dir):
    m, w = plain(spark, sf_dir)
    return rounded(analysis.top_weights(w.where(F.col("period") == m.windows.periods - 1)))


@query
def leaderboard(spark, sf_dir):
    m, w = plain(spark, sf_dir)
    return rounded(analysis.leaderboard(backtest.dynamic_metrics(m, w)), 6)


@query
def heatmap_z(spark, sf_dir):
    m, w = plain(spark, sf_dir)
    return rounded(analysis.heatmap(backtest.dynamic_metrics(m, w)), 6)


def _frontiers(spark, sf_dir):
    m = market(spark, sf_dir)
    means = m.train.join(m.universe, ["period", "symbol"], "left_semi").groupBy("period", "symbol").agg(F.avg("ret").alias("mu"))
    return analysis.monte_carlo_by_period(means, m.cov)


@query
def monte_carlo_frontier(spark, sf_dir):
    return rounded(_frontiers(spark, sf_dir), 7)


@query
def frontier_argmax(spark, sf_dir):
    return analysis.frontier_ends(_frontiers(spark, sf_dir), ["period"])


def _eigenvalues(spark, sf_dir):
    return analysis.sampled_eigenvalues_by_period(market(spark, sf_dir).cov, [2, 5, 10, 20, 30, 40])


@query
def eigen_invariants(spark, sf_dir):
    """By period and sample size: the sums of eigenvalues and of their squares, which are the trace and the squared norm, and whether they fall."""
    values = _eigenvalues(spark, sf_dir).withColumn("next", F.lead("value").over(Window.partitionBy("period", "size").orderBy("rank")))
    falls = F.min(F.coalesce(F.col("next") <= F.col("value"), F.lit(True)))
    out = values.groupBy("period", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("trace"), F.sum(F.col("value") * F.col("value")).alias("norm2"), falls.alias("descending"))
    return rounded(out)


@query
def eigenvalues_all(spark, sf_dir):
    """Eigenvalues by period and sample size, the last of which is all symbols."""
    return rounded(_eigenvalues(spark, sf_dir), 10)


# Sources


@query
def stablecoin_anti_join(spark, sf_dir):
    """The panel without the symbols of an exclusion list."""
    named = prices_of(spark, sf_dir).withColumn("symbol", F.when(F.col("symbol") == "Brand#13", STABLE_PAIRS[0]).otherwise(F.col("symbol")))
    return named.where(~F.col("symbol").isin(STABLE_PAIRS)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def _listing(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier")
    symbol = F.when(F.col("s_suppkey") % 10 == 0, "Usdt").otherwise(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return supplier.select(F.col("s_suppkey").cast("string").alias("id"), symbol.alias("symbol"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("market_cap"))


@query
def listing_topn(spark, sf_dir):
    return rounded(prices.without_stable(prices.top_coins(_listing(spark, sf_dir), 40)))


@query
def exchange_semi_join(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    wanted = nation.select(F.col("n_nationkey").cast("long").alias("ordinal"), F.concat("n_name", F.lit("USDT")).alias("symbol"))
    payload = nation.where("n_regionkey < 3").agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat("n_name", F.lit("USDT")).alias("symbol"))).alias("symbols"))).alias("payload"))
    return klines.existing_symbols(wanted, klines.quoted_symbols(payload)).select("ordinal", "symbol")


@query
def id_lookup(spark, sf_dir):
    symbols = spark.createDataFrame([(s,) for s in ("BTCUSDT", "SOLUSDT", "NULSUSDT", "NONEUSDT")], "symbol string")
    return symbols.select("symbol", prices.coin_id(F.col("symbol")).alias("coin_id"))


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "value")


@query
def event_klines(spark, sf_dir):
    return rounded(candles(_events(spark, sf_dir)), 6)


@query
def price_left_joins(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.col("event_type").alias("coin_id"), F.col("ts").alias("timestamp"), "event_id", "value")
    parts = [events.select("coin_id", "timestamp", F.col("value").alias("price")), events.where("event_id % 2 = 0").select("coin_id", "timestamp", F.col("value").alias("market_cap")), events.where("event_id % 3 = 0").select("coin_id", "timestamp", F.col("value").alias("volume"))]
    joined = prices.join_history(*parts, ["coin_id", "timestamp"])
    return rounded(joined.groupBy("coin_id").agg(F.count(F.lit(1)).alias("n"), F.count("market_cap").alias("caps"), F.count("volume").alias("volumes"), F.sum("price").alias("price_sum")), 4)


def _stored(spark, sf_dir):
    k = candles(_events(spark, sf_dir)).select("symbol", "open_time", "close", F.lit(0).cast("long").alias("version"))
    new = k.where("hour(open_time) >= 12 and symbol < 'm'").withColumn("version", F.lit(1).cast("long"))
    return k.where("hour(open_time) < 18"), new


@query
def upsert_by_key(spark, sf_dir):
    return rounded(store.upsert(*_stored(spark, sf_dir)), 6)


@query
def upsert_replace_symbol(spark, sf_dir):
    return rounded(store.upsert(*_stored(spark, sf_dir), mode="replace_symbol"), 6)


@query
def resume_points(spark, sf_dir):
    k = candles(_events(spark, sf_dir))
    return store.resume_points(k.withColumn("open_time", F.col("open_time").cast("timestamp")))


@query
def profile_summary(spark, sf_dir):
    return rounded(store.profile(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")), 6)


@query
def first_slice(spark, sf_dir):
    """Inverse-variance weights of the first window, held over the rest, on a monthly panel."""
    m = market(spark, sf_dir, "type_month", periods=1)
    w = strategies.weights_of(m, ["IVP"])
    return rounded(metrics.full_metrics(backtest.static(m, w)).select("strategy", "total_return_pct", "annualized_vol_pct", "sharpe", "max_drawdown_pct"), 6)
