"""The data behind charts and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballastry.operators import kernels
from ballastry.operators.metrics import cumulative

HEATMAP = ["sharpe", "sortino", "calmar", "total_return_pct", "max_drawdown_pct", "annualized_vol_pct", "win_rate_pct", "avg_turnover"]
#: Portfolios of a block of random draws.
DRAWS = 1000
LOWER_IS_BETTER = ["max_drawdown_pct", "annualized_vol_pct", "avg_turnover"]


def log_growth(series: DataFrame) -> DataFrame:
    """(strategy, t_idx, log_cum, final_roi): log1p of growth, and the final return as a label."""
    all_rows = Window.partitionBy("strategy")
    cum = cumulative(series)
    return cum.select("strategy", "t_idx", F.log1p("cum").alias("log_cum"), (F.max_by("cum", "t_idx").over(all_rows) - 1).alias("final_roi"))


def histogram(series: DataFrame, bins: int = 50) -> DataFrame:
    """(strategy, bin, n, density) of returns in %, from each strategy's least to its largest."""
    x = series.select("strategy", (F.col("ret") * 100).alias("x"))
    ends = x.groupBy("strategy").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1))
    counted = x.join(ends, "strategy").withColumn("bin", F.coalesce(at, F.lit(0)).cast("long"))
    return counted.groupBy("strategy", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"), F.first(width).alias("w")).select(
        "strategy", "bin", "n", F.try_divide("n", F.col("total") * F.col("w")).alias("density")
    )


def normal_overlay(series: DataFrame, points: int = 100) -> DataFrame:
    """(strategy, k, x, pdf): the normal density on points from mean - 4 sd to mean + 4 sd, in %."""
    m = series.groupBy("strategy").agg((F.avg("ret") * 100).alias("mu"), (F.stddev_samp("ret") * 100).alias("sd"))
    at = m.select("strategy", "mu", "sd", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("k"))
    x = F.col("mu") - 4 * F.col("sd") + F.col("k") * 8 * F.col("sd") / (points - 1)
    z = (F.col("x") - F.col("mu")) / F.col("sd")
    return at.withColumn("x", x).select("strategy", "k", "x", (F.exp(-z * z / 2) / (F.col("sd") * F.sqrt(2 * F.pi()))).alias("pdf"))


def density(values: DataFrame, points: int = 100) -> DataFrame:
    """(strategy, k, x, density): a Gaussian kernel density of (strategy, value), on points from 3 bandwidths below the
    least value to 3 above the largest. The bandwidth is the sample deviation times n ** -0.2."""
    h = F.stddev_samp("value") * F.pow(F.count(F.lit(1)), F.lit(-0.2))
    ends = values.groupBy("strategy").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), h.alias("h"), F.count(F.lit(1)).alias("n"))
    ends = ends.withColumn("lo", F.col("lo") - 3 * F.col("h")).withColumn("hi", F.col("hi") + 3 * F.col("h"))
    at = values.join(ends, "strategy").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    at = at.withColumn("x", F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1))
    z = F.try_divide(F.col("x") - F.col("value"), F.col("h"))
    summed = at.groupBy("strategy", "k", "x", "n", "h").agg(F.sum(F.exp(-z * z / 2)).alias("s"))
    return summed.select("strategy", "k", "x", F.try_divide("s", F.col("n") * F.col("h") * F.sqrt(2 * F.pi())).alias("density"))


def top_weights(weights: DataFrame, k: int = 15) -> DataFrame:
    """(strategy, rank, symbol, weight, label) of the largest weights over 0.001; the first three have a label."""
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("weight"), "symbol")).cast("long")
    out = weights.where(F.col("weight") > 0.001).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("strategy", "rank", "symbol", "weight", F.when(F.col("rank") <= 3, F.substring("symbol", 1, 6)).alias("label"))


def leaderboard(metrics: DataFrame, k: int = 3) -> DataFrame:
    """(metric, rank, strategy, value): best Sharpe, Sortino and drawdown, and least turnover."""
    tall = metrics.unpivot("strategy", ["sharpe", "sortino", "max_drawdown_pct", "avg_turnover"], "metric", "value")
    value = F.round("value", 9)  # equal portfolios differ in their last bits only
    order = F.when(F.col("metric") == "avg_turnover", value).otherwise(-value)
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(order, "strategy")).cast("long")
    return tall.withColumn("rank", rank).where(F.col("rank") <= k).select("metric", "rank", "strategy", "value")


def heatmap(metrics: DataFrame, by: str = "strategy") -> DataFrame:
    """(strategy, metric, z): z-scores within each strategy, or with by="metric" within each metric; signs
    of three metrics are turned so that higher is better (drawdowns by strategy as well, as drawn)."""
    tall = metrics.unpivot("strategy", HEATMAP, "metric", "value")
    own = Window.partitionBy(by)
    z = F.try_divide(F.col("value") - F.avg("value").over(own), F.stddev_samp("value").over(own))
    turned = LOWER_IS_BETTER if by == "strategy" else ["annualized_vol_pct", "avg_turnover"]
    return tall.select("strategy", "metric", F.when(F.col("metric").isin(turned), -z).otherwise(z).alias("z"))


def hashed_unit(*keys: Column) -> Column:
    """A number in [0, 1) from the md5 of keys; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 8), 16, 10).cast("long") / float(2**32)


def monte_carlo(means: DataFrame, cov: DataFrame, portfolios: int = 5000) -> DataFrame:
    """(portfolio, ret, vol, sharpe) of random normalised weights over assets (symbol, mu); cov has i <= j."""
    zero = F.lit(0).cast("long")
    return monte_carlo_by_period(means.withColumn("period", zero), cov.withColumn("period", zero), portfolios).drop("period")


def monte_carlo_by_period(means: DataFrame, cov: DataFrame, portfolios: int = 5000) -> DataFrame:
    """(period, portfolio, ret, vol, sharpe) over assets (period, symbol, mu); each period has the same draws.

    Draws are made once for each distinct universe, in blocks of DRAWS portfolios; a row then holds a period, a block and the period's covariances,
    and gives its portfolios by one matrix product. Pairs without a covariance count as 0.
    """
    spark = means.sparkSession
    own = means.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("symbol", "mu"))).alias("own"))
    own = own.select("period", F.col("own.symbol").alias("names"), F.col("own.mu").alias("mu"))
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(max(portfolios - 1, 0) // DRAWS).cast("long"))
    drawn = own.select("names").distinct().select("names", F.explode(blocks).alias("block"))
    drawn = drawn.repartition(spark.sparkContext.defaultParallelism, "names", "block")  # small rows, much work each
    ids = F.sequence(F.col("block") * DRAWS, F.least((F.col("block") + 1) * DRAWS, F.lit(portfolios).cast("long")) - 1)
    drawn = drawn.select("names", F.col("block"), F.transform(ids, lambda k: F.transform("names", lambda s: hashed_unit(k, s))).alias("u"))
    pairs = cov.groupBy("period").agg(F.collect_list(F.struct("i", "j", "cov")).alias("c"))
    pairs = pairs.select("period", F.col("c.i").alias("i"), F.col("c.j").alias("j"), F.col("c.cov").alias("cov"))
    rows = own.join(pairs, "period").join(drawn, "names").where(F.lit(portfolios > 0))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                place = {s: k for k, s in enumerate(r.names)}
                matrix = np.zeros((len(place), len(place)))
                for i, j, c in zip(r.i, r.j, r.cov, strict=True):
                    if i in place and j in place:
                        matrix[place[i], place[j]] = matrix[place[j], place[i]] = c
                w = np.stack(r.u)
                w = w / w.sum(axis=1, keepdims=True)
                first = r.block * DRAWS
                yield pd.DataFrame({"period": r.period, "portfolio": np.arange(first, first + len(w)), "ret": w @ np.asarray(r.mu), "vol": np.sqrt(((w @ matrix) * w).sum(axis=1))})

    out = rows.select("period", "block", "names", "mu", "i", "j", "cov", "u").mapInPandas(measured, "period long, portfolio long, ret double, vol double")
    return out.select("period", "portfolio", "ret", "vol", F.try_divide("ret", "vol").alias("sharpe"))


def frontier_ends(frontier: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The portfolios of highest Sharpe ratio and of least volatility, by keys; ties go to the smaller number."""
    return frontier.groupBy(*keys or []).agg(F.min_by("portfolio", F.struct(-F.col("sharpe"), "portfolio")).alias("max_sharpe"), F.min_by("portfolio", F.struct("vol", "portfolio")).alias("min_vol"))


def sampled_eigenvalues_by_period(cov: DataFrame, sizes: list[int]) -> DataFrame:
    """(period, size, rank, value) for samples of each period's symbols with the smallest md5, and for all its symbols."""
    by_md5 = Window.partitionBy("period").orderBy(F.md5("symbol"))
    symbols = cov.where("i = j").select("period", F.col("i").alias("symbol")).withColumn("order", F.row_number().over(by_md5))
    symbols = symbols.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("period")))
    own = F.array_distinct(F.array(*[F.least(F.lit(s).cast("long"), F.col("n")) for s in sizes], F.col("n")))
    sized = symbols.select("period", "symbol", "order", F.explode(own).alias("size")).where("order <= size")
    sized = sized.withColumn("id", F.col("period") * F.lit(2**20) + F.col("size"))
    a, b = sized.select("period", "id", F.col("symbol").alias("i")), sized.select("id", F.col("symbol").alias("j"))
    values = kernels.eigenvalues_by_group(cov.join(a, ["period", "i"]).join(b, ["id", "j"]).select(F.col("id").alias("period"), "i", "j", "cov"))
    return values.select(F.floor(F.col("period") / 2**20).alias("period"), (F.col("period") % 2**20).alias("size"), "rank", "value")
