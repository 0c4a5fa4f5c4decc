"""Covariances and correlations of complete windows, by period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballastry.operators.panel import Windows


def covariances(rets: DataFrame, windows: Windows) -> DataFrame:
    """(period, i, j, cov) for i <= j of the symbols whose training window is complete.

    Returns are paired once by date, and the pairs then go to their periods; a pair has as many rows
    as the window exactly when both symbols are complete, so no universe join is needed.
    """
    a = rets.select("t_idx", F.col("symbol").alias("i"), F.col("ret").alias("x"))
    b = rets.select("t_idx", F.col("symbol").alias("j"), F.col("ret").alias("y"))
    pairs = windows.training(a.join(b, "t_idx").where("i <= j"))
    grouped = pairs.groupBy("period", "i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("n") == windows.train).select("period", "i", "j", "cov")


def correlations(cov: DataFrame) -> DataFrame:
    """(period, i, j, cov, corr, dist); a constant side has no correlation and distance 0."""
    var = cov.where("i = j").select("period", F.col("i").alias("s"), F.col("cov").alias("v"))
    x = var.select("period", F.col("s").alias("i"), F.col("v").alias("vi"))
    y = var.select("period", F.col("s").alias("j"), F.col("v").alias("vj"))
    corr = F.try_divide(F.col("cov"), F.sqrt("vi") * F.sqrt("vj"))
    out = cov.join(x, ["period", "i"]).join(y, ["period", "j"]).withColumn("corr", corr)
    dist = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("corr")) / 2)), F.lit(0.0))
    return out.select("period", "i", "j", "cov", "corr", F.when(F.col("i") == F.col("j"), 0.0).otherwise(dist).alias("dist"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """The full square of a table with i <= j."""
    turned = pairs.where("i < j").withColumnsRenamed({"i": "_i", "j": "_j"}).withColumnsRenamed({"_i": "j", "_j": "i"})
    return pairs.unionByName(turned)


def second_order_distance(corr: DataFrame) -> DataFrame:
    """(period, i, j, dist2): the Euclidean distance of two symbols' rows of distances."""
    full = both_ways(corr.select("period", "i", "j", "dist"))
    a = full.select("period", F.col("i"), F.col("j").alias("k"), F.col("dist").alias("x"))
    b = full.select("period", F.col("i").alias("j"), F.col("j").alias("k"), F.col("dist").alias("y"))
    both = a.join(b, ["period", "k"]).where("i <= j")
    return both.groupBy("period", "i", "j").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("dist2"))


def quadratic(weights: DataFrame, cov: DataFrame, keys: list[str], columns: tuple[str, ...] = ("weight",)) -> DataFrame:
    """(keys.., var or <column>_var): w' cov w of each weight vector; keys hold period.

    Covariances meet the weights once, whatever the number of weight columns: cov w first, then w' (cov w).
    """
    full = both_ways(cov)
    b = weights.select(*keys, F.col("symbol").alias("j"), *columns)
    inner = full.join(b, ["period", "j"]).groupBy(*keys, F.col("i").alias("symbol")).agg(*[F.sum(F.col(c) * F.col("cov")).alias(f"_cov_{c}") for c in columns])
    names = ["var"] if columns == ("weight",) else [f"{c}_var" for c in columns]
    return weights.join(inner, [*keys, "symbol"]).groupBy(*keys).agg(*[F.sum(F.col(c) * F.col(f"_cov_{c}")).alias(n) for c, n in zip(columns, names, strict=True)])
