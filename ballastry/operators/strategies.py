"""Portfolio strategies: weights (period, symbol, weight) for all training windows at once.

A strategy sees only its period's training window, so every rule is an aggregate or a window over
(period, symbol): no loop over periods. Ranks are by score, largest first, then by symbol.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ballastry.functions.numeric import YEAR, compounded, growth
from ballastry.operators import kernels
from ballastry.operators.blocks import merged_covariances
from ballastry.operators.panel import Windows, universe
from ballastry.session import kept


def by_period() -> WindowSpec:
    return Window.partitionBy("period")


def share(value: Column) -> Column:
    """value as a share of its period's total; equal shares where the total is 0."""
    total = F.sum(value).over(by_period())
    return F.when(total > 0, value / total).otherwise(1.0 / F.count(F.lit(1)).over(by_period()))


def ranked(scores: DataFrame) -> DataFrame:
    """scores (period, symbol, score) with rn from 1 and the number n of symbols."""
    by_score = by_period().orderBy(F.desc("score"), "symbol")
    return scores.withColumn("rn", F.row_number().over(by_score).cast("long")).withColumn("n", F.count(F.lit(1)).over(by_period()))


class Market:
    """Returns and training windows of a panel (d, t_idx, symbol, close), and what strategies share."""

    def __init__(self, px: DataFrame, rets: DataFrame, windows: Windows) -> None:
        self.px, self.rets, self.windows = px, rets, windows
        self._scores: dict[int, DataFrame] = {}

    @cached_property
    def train(self) -> DataFrame:
        return self.windows.training(self.rets)

    @cached_property
    def universe(self) -> DataFrame:
        """A row a symbol and period; kept, because every alignment reads it."""
        return kept(universe(self.train, self.windows))

    @cached_property
    def cov(self) -> DataFrame:
        """Kept, because kernels and quadratic forms of all strategies read it."""
        return kept(merged_covariances(self.rets, self.windows))

    def formation(self, rows: int) -> Column:
        """Whether a training row is in the formation window: `rows` rows, the last one left out.

        A window no longer than that is taken whole, last row included; one of exactly that length
        loses its last row.
        """
        hi, t = self.windows.last(), F.col("t_idx")
        if self.windows.train < rows:
            return F.lit(True)
        return (t > hi - rows - 1) & (t < hi)

    def scores(self, rows: int = 21) -> DataFrame:
        """(period, symbol, score, sd): momentum, and the deviation over the whole window, of the universe; kept, as four strategies read it."""
        if rows not in self._scores:
            self._scores[rows] = kept(self._scored(rows))
        return self._scores[rows]

    def _scored(self, rows: int) -> DataFrame:
        return (
            self.train.groupBy("period", "symbol")
            .agg(F.count("ret").alias("k"), compounded(F.when(self.formation(rows), F.col("ret"))).alias("score"), F.stddev_samp("ret").alias("sd"))
            .where(F.col("k") == self.windows.train)
            .drop("k")
        )


def inverse_variance(m: Market) -> DataFrame:
    var = m.train.groupBy("period", "symbol").agg(F.count("ret").alias("k"), F.var_samp("ret").alias("v")).where((F.col("k") == m.windows.train) & (F.col("v") > 0))
    return var.select("period", "symbol", share(1 / F.col("v")).alias("weight"))


def minimum_variance(m: Market) -> DataFrame:
    return kernels.mvp_by_period(m.cov)


def hierarchical(m: Market) -> DataFrame:
    return kernels.hrp_by_period(m.cov).select("period", "symbol", "weight")


def cross_sectional(m: Market, formation: int = 21, top: float = 0.3, bottom: float = 0.2, scheme: str = "equal", holding_period: int = 7) -> DataFrame:
    """Momentum winners: equal, momentum or inverse_vol weights. holding_period is accepted and unused."""
    if scheme not in ("equal", "momentum", "inverse_vol"):
        raise ValueError(f"unknown weighting scheme {scheme}")
    r = ranked(m.scores(formation))
    n_top = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(top)))
    n_out = F.floor(F.col("n") * F.lit(bottom))
    kept = F.when((n_out > 0) & (n_out < F.col("n")), F.least(n_top, F.col("n") - n_out)).otherwise(n_top)
    r = r.withColumn("chosen", F.col("rn") <= kept)
    if scheme == "equal":
        raw = F.lit(1.0)
    elif scheme == "momentum":
        raw = F.col("score") - F.min(F.when(F.col("chosen"), F.col("score"))).over(by_period()) + 0.001
    else:
        raw = F.coalesce(F.try_divide(F.lit(1.0), F.col("sd")), F.lit(0.0))
    r = r.withColumn("raw", F.when(F.col("chosen"), raw).otherwise(0.0))
    total, count = F.sum("raw").over(by_period()), F.sum(F.col("chosen").cast("int")).over(by_period())
    weight = F.when(~F.col("chosen"), 0.0).when(total > 0, F.col("raw") / total).otherwise(1.0 / count)
    return r.select("period", "symbol", weight.alias("weight"))


def growth_index(m: Market) -> DataFrame:
    """(period, t_idx, symbol, growth) over the training windows of the universe."""
    run = Window.partitionBy("period", "symbol").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    return m.train.join(m.universe, ["period", "symbol"], "left_semi").select("period", "t_idx", "symbol", growth(F.col("ret"), run).alias("growth"))


def trend_signals(m: Market, signal: str = "ma_crossover", fast: int = 7, slow: int = 28, lookback: int = 21) -> DataFrame:
    """(period, symbol, signal, sd) of the universe. A window shorter than `slow` has no crossover signal."""
    hi, t = m.windows.last(), F.col("t_idx")
    if signal == "ma_crossover":
        averages = growth_index(m).groupBy("period", "symbol").agg(
            F.avg(F.when(t > hi - fast, F.col("growth"))).alias("f"), F.avg(F.when(t > hi - slow, F.col("growth"))).alias("s")
        )
        enough = F.lit(m.windows.train >= max(fast, slow))
        signals = averages.select("period", "symbol", F.coalesce(enough & (F.col("f") > F.col("s")), F.lit(False)).alias("signal"))
    elif signal == "absolute":
        recent = m.train.groupBy("period", "symbol").agg(compounded(F.when(t > hi - lookback, F.col("ret"))).alias("x"))
        signals = recent.select("period", "symbol", (F.col("x") > 0).alias("signal"))
    else:
        raise ValueError(f"unknown signal type {signal}")
    return m.scores().select("period", "symbol", "sd").join(signals, ["period", "symbol"])


def time_series(m: Market, signal: str = "ma_crossover", fast: int = 7, slow: int = 28, lookback: int = 21, sizing: str = "equal", volatility_target: float = 0.15) -> DataFrame:
    """Trending assets, equal or by inverse volatility; all assets equally where none trends.

    volatility_target is accepted and cancels when weights are normalised.
    """
    s = trend_signals(m, signal, fast, slow, lookback)
    one = F.when(F.col("signal"), 1.0).otherwise(0.0)
    raw = one if sizing != "volatility_target" else one * F.coalesce(F.try_divide(F.lit(1.0), F.col("sd") * F.sqrt(F.lit(float(YEAR)))), F.lit(0.0))
    s = s.withColumn("one", one).withColumn("raw", raw)
    total, trending = F.sum("raw").over(by_period()), F.sum("one").over(by_period())
    weight = F.when(total > 0, F.col("raw") / total).when(trending > 0, F.col("one") / trending).otherwise(1.0 / F.count(F.lit(1)).over(by_period()))
    return s.select("period", "symbol", weight.alias("weight"))


def risk_managed(m: Market, formation: int = 21, vol_rows: int = 63, target: float = 0.12, most: float = 2.0, least: float = 0.25, top: float = 0.3) -> DataFrame:
    """(period, symbol, weight, raw_weight, realized_vol, scale, scaled_weight).

    The scale cancels in ``weight``, which is normalised; ``scaled_weight`` keeps it.
    """
    r = ranked(m.scores(formation)).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(top))))
    raw = r.select("period", "symbol", F.when(F.col("rn") <= F.col("k"), 1.0 / F.col("k")).otherwise(0.0).alias("raw_weight"))
    recent = m.train.where(F.col("t_idx") > m.windows.last() - vol_rows).join(raw, ["period", "symbol"])
    daily = recent.groupBy("period", "t_idx").agg(F.sum(F.col("ret") * F.col("raw_weight")).alias("r"))
    vol = daily.groupBy("period").agg((F.stddev_samp("r") * F.sqrt(F.lit(float(YEAR)))).alias("realized_vol"))
    scale = F.least(F.greatest(F.coalesce(F.try_divide(F.lit(target), F.col("realized_vol")), F.lit(1.0)), F.lit(least)), F.lit(most))
    out = raw.join(vol, "period").withColumn("scale", scale).withColumn("scaled_weight", F.col("raw_weight") * F.col("scale"))
    total = F.sum("scaled_weight").over(by_period())
    return out.select("period", "symbol", (F.col("scaled_weight") / total).alias("weight"), "raw_weight", "realized_vol", "scale", "scaled_weight")


def momentum_selection(m: Market, formation: int = 21, top: float = 0.4, bottom: float = 0.2, min_assets: int = 5) -> DataFrame:
    """(period, symbol, rn, chosen) for the hybrid strategy."""
    r = ranked(m.scores(formation))
    n_top = F.greatest(F.lit(min_assets), F.floor(F.col("n") * F.lit(top)))
    n_out = F.floor(F.col("n") * F.lit(bottom))
    kept = F.when((n_out > 0) & (n_out < F.col("n")), F.least(n_top, F.col("n") - n_out)).otherwise(F.least(n_top, F.col("n")))
    kept = F.when(kept < min_assets, F.least(F.lit(min_assets), F.col("n"))).otherwise(kept)
    return r.select("period", "symbol", "rn", (F.col("rn") <= kept).alias("chosen"))


def momentum_hierarchical(m: Market, formation: int = 21, top: float = 0.4, bottom: float = 0.2, min_assets: int = 5) -> DataFrame:
    """Hierarchical weights of momentum winners, whose ids are their ranks; 0 for the rest of the universe."""
    picked = momentum_selection(m, formation, top, bottom, min_assets)
    won = picked.where("chosen")
    i = won.select("period", F.col("symbol").alias("i"), F.col("rn").alias("id_i"))
    j = won.select("period", F.col("symbol").alias("j"), F.col("rn").alias("id_j"))
    cov = m.cov.join(i, ["period", "i"]).join(j, ["period", "j"])
    # kernels read ids from side i, on which every symbol stands at least with itself
    inside = kernels.hrp_by_period(cov.select("period", "i", "j", "cov", "id_i")).select("period", "symbol", "weight")
    return picked.select("period", "symbol").join(inside, ["period", "symbol"], "left").select("period", "symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def hold(m: Market, symbol: str) -> DataFrame:
    """All in one asset."""
    return m.windows.table(m.px).select("period", F.lit(symbol).alias("symbol"), F.lit(1.0).alias("weight"))


STRATEGIES = {
    "HRP": hierarchical,
    "IVP": inverse_variance,
    "MVP": minimum_variance,
    "CS_MOM": cross_sectional,
    "TS_MOM": time_series,
    "RM_MOM": lambda m: risk_managed(m).select("period", "symbol", "weight"),
    "MOM_HRP": momentum_hierarchical,
}


def weights_of(m: Market, names: list[str]) -> DataFrame:
    """(strategy, period, symbol, weight) of the named strategies; others may be added to ``STRATEGIES``."""
    parts = [STRATEGIES[n](m).select(F.lit(n).alias("strategy"), "period", "symbol", "weight") for n in names]
    return reduce(DataFrame.unionByName, parts)
