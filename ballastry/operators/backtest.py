"""Backtests: held weights, rolling rebalancing, and rebalancing with drift and carried costs.

Periods are a key, never a loop. What one period hands to the next is the weights before it (a join on
period - 1) and a running product, for which there are windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballastry.operators.metrics import concentration, cumulative, full_metrics, portfolio_returns
from ballastry.operators.strategies import Market
from ballastry.operators.transition import RATE, costs, previous, turnover_union


def dates_of(m: Market) -> DataFrame:
    return m.px.select("t_idx").distinct()


def static(m: Market, weights: DataFrame) -> DataFrame:
    """(strategy, t_idx, ret): the first period's weights over all rows after its training window."""
    later = F.col("t_idx") > m.windows.train
    return portfolio_returns(m.rets.where(later), weights.where("period = 0").drop("period"), dates_of(m).where(later), ["symbol"])


def rolling(m: Market, weights: DataFrame) -> DataFrame:
    """(strategy, t_idx, ret): each period's weights over its test rows, without drift or cost."""
    return portfolio_returns(m.windows.testing(m.rets), weights, m.windows.testing(dates_of(m)), ["period", "symbol"])


def turnover_table(m: Market, weights: DataFrame, rate: float = RATE) -> DataFrame:
    """(strategy, total_turnover, avg_turnover, total_costs_pct, rebalances); the first period trades nothing but counts."""
    old = previous(weights)
    union = turnover_union(old, weights).groupBy("strategy").agg(F.sum("turnover").alias("total_turnover"), F.avg("turnover").alias("avg_turnover"), F.count(F.lit(1)).alias("rebalances"))
    paid = costs(old, weights, m.universe, rate).groupBy("strategy").agg((F.sum("cost") * 100).alias("total_costs_pct"))
    return union.join(paid, "strategy")


def dynamic_metrics(m: Market, weights: DataFrame) -> DataFrame:
    """Series metrics of the rolling backtest, concentration of the last weights, and trading totals."""
    last = weights.where(F.col("period") == m.windows.periods - 1)
    return full_metrics(rolling(m, weights)).join(concentration(last, ["strategy"]), "strategy").join(turnover_table(m, weights).drop("total_turnover"), "strategy")


def drifted(m: Market, weights: DataFrame, base: str = "first") -> DataFrame:
    """(strategy, period, symbol, weight) after the period's test rows.

    Prices count from the first test date, so that day's return is left out; base="entry" counts from
    the last training date. A missing price at either end leaves a null weight.
    """
    ends = m.windows.testing(dates_of(m)).groupBy("period").agg(F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi"))
    if base == "entry":
        ends = ends.withColumn("lo", F.col("lo") - 1)
    first = ends.join(m.px, F.col("lo") == F.col("t_idx")).select("period", "symbol", F.col("close").alias("p0"))
    final = ends.join(m.px, F.col("hi") == F.col("t_idx")).select("period", "symbol", F.col("close").alias("p1"))
    kept = weights.join(ends.select("period"), "period", "left_semi")
    moved = kept.join(first, ["period", "symbol"], "left").join(final, ["period", "symbol"], "left").withColumn("x", F.col("weight") * F.try_divide("p1", "p0"))
    return moved.withColumn("weight", F.try_divide("x", F.sum("x").over(Window.partitionBy("strategy", "period")))).select("strategy", "period", "symbol", "weight")


def carried(m: Market, weights: DataFrame, rate: float = RATE, drift_base: str = "first") -> DataFrame:
    """(strategy, period, t_idx, ret, cum): rebalancing from drifted weights, with costs taken from the index.

    With G the growth of a period, c its cost (none for the first) and P the product of G up to it,
    a period starts from P[p-1] * (1 - sum of c[k] / P[k-1] for k up to p). The last point of a period is
    published after the next period's cost. Periods without test rows have no trade.
    """
    by_period = Window.partitionBy("strategy").orderBy("period")
    series = rolling(m, weights)
    series = m.windows.testing(series)
    grown = series.groupBy("strategy", "period").agg(F.product(1 + F.col("ret")).alias("g"))
    old = drifted(m, weights, drift_base).withColumn("period", F.col("period") + 1)
    live = weights.join(grown.select("strategy", "period"), ["strategy", "period"], "left_semi").where("period > 0")
    paid = costs(old.join(live.select("strategy", "period").distinct(), ["strategy", "period"], "left_semi"), live, m.universe, rate).select("strategy", "period", "cost")
    steps = grown.join(paid, ["strategy", "period"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    steps = steps.withColumn("before", F.coalesce(F.product("g").over(by_period.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    steps = steps.withColumn("lost", F.sum(F.col("cost") / F.col("before")).over(by_period.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("base", F.col("before") * (1 - F.col("lost"))).withColumn("next_cost", F.coalesce(F.lead("cost").over(by_period), F.lit(0.0)))
    inside = Window.partitionBy("strategy", "period").orderBy("t_idx")
    out = series.join(steps.select("strategy", "period", "base", "next_cost"), ["strategy", "period"])
    out = out.withColumn("own", F.product(1 + F.col("ret")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.lead("t_idx").over(inside).isNull()
    return out.select("strategy", "period", "t_idx", "ret", (F.col("base") * F.col("own") - F.when(final, F.col("next_cost")).otherwise(0.0)).alias("cum"))


def against(metrics: DataFrame, baseline: str) -> DataFrame:
    """Differences of Sharpe and total return to one strategy, absolute and in % of its size (0 where that is 0)."""
    base = metrics.where(F.col("strategy") == baseline).select(F.col("sharpe").alias("s0"), F.col("total_return_pct").alias("r0"))
    pct = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.try_divide(F.col(a) - F.col(b), F.abs(F.col(b))) * 100)
    return metrics.crossJoin(F.broadcast(base)).select(  # the baseline is one row
        "strategy", (F.col("sharpe") - F.col("s0")).alias("sharpe_diff"), (F.col("total_return_pct") - F.col("r0")).alias("return_diff"), pct("sharpe", "s0").alias("sharpe_change_pct"), pct("total_return_pct", "r0").alias("return_change_pct")
    )


def relative(series: DataFrame, baseline: str) -> DataFrame:
    """(strategy, t_idx, relative): growth over the baseline's growth."""
    cum = cumulative(series)
    base = cum.where(F.col("strategy") == baseline).select("t_idx", F.col("cum").alias("base"))
    return cum.join(base, "t_idx").select("strategy", "t_idx", (F.col("cum") / F.col("base")).alias("relative"))
