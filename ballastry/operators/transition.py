"""Changes from one weight vector to the next: turnover, cost, Sharpe ratios and the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballastry.functions.numeric import YEAR
from ballastry.operators.moments import quadratic
from ballastry.operators.strategies import Market

RATE = 0.001


def previous(weights: DataFrame) -> DataFrame:
    """Each period's current weights: those of the period before, and its own for the first."""
    later = weights.withColumn("period", F.col("period") + 1)
    last = weights.agg(F.max("period").alias("_last"))
    return weights.where("period = 0").unionByName(later.join(last, F.col("period") <= F.col("_last")).drop("_last"))


def turnover_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """(strategy, period, turnover) over the union of assets."""
    keys = ["strategy", "period", "symbol"]
    a, b = old.withColumnRenamed("weight", "a"), new.withColumnRenamed("weight", "b")
    change = F.abs(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))
    return a.join(b, keys, "full_outer").groupBy("strategy", "period").agg(F.sum(change).alias("turnover"))


def aligned(old: DataFrame, new: DataFrame, universe: DataFrame) -> DataFrame:
    """(strategy, period, symbol, c, p): old and new weights on the training universe; missing ones are 0, others are left out."""
    keys = ["strategy", "period", "symbol"]
    strategies = new.select("strategy", "period").distinct()
    rows = universe.join(strategies, "period").join(old.withColumnRenamed("weight", "c"), keys, "left").join(new.withColumnRenamed("weight", "p"), keys, "left")
    return rows.select(*keys, F.coalesce("c", F.lit(0.0)).alias("c"), F.coalesce("p", F.lit(0.0)).alias("p"))


def costs(old: DataFrame, new: DataFrame, universe: DataFrame, rate: float = RATE) -> DataFrame:
    """(strategy, period, turnover, cost) on the training universe."""
    change = F.sum(F.abs(F.col("p") - F.col("c")))
    return aligned(old, new, universe).groupBy("strategy", "period").agg(change.alias("turnover")).withColumn("cost", F.col("turnover") * rate)


def analyze(old: DataFrame, new: DataFrame, m: Market, rate: float = RATE, threshold: float | None = 0.001) -> DataFrame:
    """The analysis of each change, with the portfolios as structs. Without a threshold all changes are recommended.

    Returns and volatilities are annualised over the training window.
    """
    both = aligned(old, new, m.universe)
    means = m.train.groupBy("period", "symbol").agg(F.avg("ret").alias("mu"))
    gains = both.join(means, ["period", "symbol"]).groupBy("strategy", "period").agg(
        (F.sum(F.col("mu") * F.col("c")) * YEAR).alias("c_return"),
        (F.sum(F.col("mu") * F.col("p")) * YEAR).alias("p_return"),
        F.sum(F.abs(F.col("p") - F.col("c"))).alias("turnover"),
    )
    joined = gains.join(quadratic(both, m.cov, ["strategy", "period"], ("c", "p")), ["strategy", "period"])
    joined = joined.withColumn("cost", F.col("turnover") * rate)
    for k in "cp":
        joined = joined.withColumn(f"{k}_vol", F.sqrt(F.greatest(F.col(f"{k}_var"), F.lit(0.0)) * YEAR))
        joined = joined.withColumn(f"{k}_sharpe", F.when(F.col(f"{k}_vol") > 0, F.try_divide(f"{k}_return", f"{k}_vol")).otherwise(0.0))
    adjusted = F.when(F.col("p_vol") > 0, F.try_divide(F.col("p_return") - F.col("cost"), F.col("p_vol"))).otherwise(0.0)
    joined = joined.withColumn("adjusted", adjusted).withColumn("gain", F.col("adjusted") - F.col("c_sharpe"))
    own = lambda k: F.struct(F.col(f"{k}_return").alias("expected_return"), F.col(f"{k}_vol").alias("volatility"), F.col(f"{k}_sharpe").alias("sharpe_ratio"))
    return joined.select(
        "strategy",
        "period",
        (F.lit(True) if threshold is None else F.col("gain") > threshold).alias("recommendation"),
        own("c").alias("current_portfolio"),
        own("p").alias("proposed_portfolio"),
        F.col("cost").alias("transaction_costs"),
        F.col("adjusted").alias("adjusted_sharpe_ratio"),
        F.col("gain").alias("sharpe_improvement"),
        "turnover",
    )
