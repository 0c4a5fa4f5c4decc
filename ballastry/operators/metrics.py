"""Performance metrics of return series (strategy, t_idx, ret)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ballastry.functions.numeric import YEAR, complete, growth, ratio

INF = float("inf")


def by_strategy() -> WindowSpec:
    return Window.partitionBy("strategy").orderBy("t_idx")


def so_far() -> WindowSpec:
    return by_strategy().rowsBetween(Window.unboundedPreceding, 0)


def portfolio_returns(rets: DataFrame, weights: DataFrame, dates: DataFrame, keys: list[str]) -> DataFrame:
    """(strategy, t_idx, ret): the weighted sum of returns by date; missing ones count 0, and no date vanishes.

    keys are the columns that tie returns to weights: symbol, and period if weights change. dates has
    t_idx (and period).
    """
    by = [k for k in keys if k != "symbol"]
    summed = rets.join(weights, keys).groupBy("strategy", "t_idx").agg(F.sum(F.col("ret") * F.col("weight")).alias("r"))
    grid = dates.join(weights.select("strategy", *by).distinct(), by) if by else dates.crossJoin(weights.select("strategy").distinct())
    return grid.join(summed, ["strategy", "t_idx"], "left").select("strategy", "t_idx", F.coalesce("r", F.lit(0.0)).alias("ret"))


def cumulative(series: DataFrame) -> DataFrame:
    return series.withColumn("cum", growth(F.col("ret"), so_far()))


def drawdowns(cum: DataFrame) -> DataFrame:
    return cum.withColumn("dd", F.col("cum") / F.max("cum").over(so_far()) - 1)


def rolling_sharpe(series: DataFrame, rows: int = 90) -> DataFrame:
    w = by_strategy().rowsBetween(1 - rows, 0)
    mean, sd = complete(F.col("ret"), F.avg("ret"), rows, w), complete(F.col("ret"), F.stddev_samp("ret"), rows, w)
    return series.select("strategy", "t_idx", mean.alias("mean"), sd.alias("sd")).withColumn("sharpe", F.try_divide(F.col("mean") * YEAR, F.col("sd") * F.sqrt(F.lit(float(YEAR)))))


def full_metrics(series: DataFrame, risk_free: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """All series metrics, a row a strategy. Two aggregates: the second needs the first's VaR."""
    r = F.col("ret")
    dd = drawdowns(cumulative(series))
    tails = series.groupBy("strategy").agg(F.percentile("ret", 1 - confidence).alias("var"))
    base = dd.join(tails, "strategy").groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("cum", "t_idx").alias("last"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("downside"),
        F.min("dd").alias("mdd"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd") * 10000)).alias("ulcer_index"),
        F.first("var").alias("var"),
        F.avg(F.when(r <= F.col("var"), r)).alias("cvar"),
        F.skewness("ret").alias("skewness"),
        F.kurtosis("ret").alias("kurtosis"),
        F.count_if(r > 0).alias("wins"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("gains"),
        F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0)).alias("losses"),
    )
    year = F.sqrt(F.lit(float(YEAR)))
    annual = (F.pow("last", F.lit(float(YEAR)) / F.col("n")) - 1) * 100
    mean = F.col("mean") - risk_free / YEAR
    return base.select(
        "strategy",
        ((F.col("last") - 1) * 100).alias("total_return_pct"),
        annual.alias("annualized_return_pct"),
        (F.col("sd") * year * 100).alias("annualized_vol_pct"),
        (F.col("mdd") * 100).alias("max_drawdown_pct"),
        (F.col("var") * 100).alias("var95_pct"),
        (F.col("cvar") * 100).alias("cvar95_pct"),
        "ulcer_index",
        ratio(year * mean, F.col("sd"), 0.0).alias("sharpe"),
        F.when(F.col("downside").isNull(), INF).otherwise(F.try_divide(year * mean, F.col("downside"))).alias("sortino"),
        ratio(annual, F.abs(F.col("mdd") * 100), INF).alias("calmar"),
        "skewness",
        "kurtosis",
        (F.col("wins") / F.col("n") * 100).alias("win_rate_pct"),
        ratio(F.col("gains"), F.col("losses"), INF).alias("profit_factor"),
    )


def basic_metrics(series: DataFrame) -> DataFrame:
    """The six metrics as fractions."""
    m = full_metrics(series)
    return m.select(
        "strategy",
        (F.col("total_return_pct") / 100).alias("total_return"),
        (F.col("annualized_vol_pct") / 100).alias("volatility"),
        "sharpe",
        "sortino",
        (F.col("max_drawdown_pct") / 100).alias("max_drawdown"),
        "calmar",
    )


def concentration(weights: DataFrame, keys: list[str]) -> DataFrame:
    """effective_n, max_weight_pct and n_assets (weights over 0.001) by keys."""
    return weights.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.lit(1.0), F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("effective_n"),
        (F.max("weight") * 100).alias("max_weight_pct"),
        F.count_if(F.col("weight") > 0.001).alias("n_assets"),
    )
