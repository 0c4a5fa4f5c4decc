"""Recursive bisection of an order of assets as tables: every cluster a row, all levels at once.

A cluster is a node: 1 is the whole order, and node k halves into 2k (the first half, rounded down) and 2k + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bisection_paths(order: DataFrame) -> DataFrame:
    """order (period, symbol, pos from 0) with `path`: the nodes from the root down to the asset by itself."""
    n = F.count(F.lit(1)).over(Window.partitionBy("period"))
    # an order of n assets is never deeper than n has binary digits; a fold that has reached one asset stays there
    levels = F.sequence(F.lit(1), F.length(F.bin("n")))
    node = lambda k, lo, hi, path: F.struct(k.alias("node"), lo.alias("lo"), hi.alias("hi"), path.alias("path"))
    root = node(F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("n"), F.array(F.lit(1).cast("long")))

    def deeper(at, _):
        middle = at["lo"] + F.floor((at["hi"] - at["lo"]) / 2)
        right = F.col("pos") >= middle
        child = at["node"] * 2 + right.cast("long")
        halved = node(child, F.when(right, middle).otherwise(at["lo"]), F.when(right, at["hi"]).otherwise(middle), F.concat(at["path"], F.array(child)))
        return F.when(at["hi"] - at["lo"] > 1, halved).otherwise(at)

    counted = order.select("period", "symbol", F.col("pos").cast("long").alias("pos"), n.alias("n"))
    return counted.withColumn("path", F.aggregate(levels, root, deeper, lambda at: at["path"])).drop("n")


def bisection_nodes(paths: DataFrame, cov: DataFrame) -> DataFrame:
    """(period, node, lo, n_leaves, variance, share) of every cluster, in one aggregate over the pairs of each period.

    variance is that of the cluster's inverse-variance portfolio: sum(c_ij / (v_i v_j)) / sum(1 / v_i) ^ 2. A pair of assets
    goes to the nodes that both paths share, two on average. share is the part of the parent's weight, 1 - variance / (variance
    + sibling's); the root has none. Assets of variance 0 are left out of their clusters' variances; a cluster of such assets
    alone has none, and neither it nor its sibling has a share.
    """
    v = cov.where("i = j").select("period", F.col("i").alias("symbol"), F.try_divide(F.lit(1.0), "cov").alias("u"))
    leaves = paths.join(v, ["period", "symbol"])
    i = leaves.select("period", F.col("symbol").alias("i"), "pos", F.col("u").alias("ui"), F.col("path").alias("pi"))
    j = leaves.select("period", F.col("symbol").alias("j"), F.col("u").alias("uj"), F.col("path").alias("pj"))
    pairs = cov.join(i, ["period", "i"]).join(j, ["period", "j"]).withColumn("node", F.explode(F.array_intersect("pi", "pj")))
    same = F.col("i") == F.col("j")
    nodes = pairs.groupBy("period", "node").agg(
        F.sum(F.when(same, 1.0).otherwise(2.0) * F.col("ui") * F.col("uj") * F.col("cov")).alias("s"),
        F.sum(F.when(same, F.col("ui"))).alias("t"),
        F.min(F.when(same, F.col("pos"))).alias("lo"),
        F.count(F.when(same, 1)).alias("n_leaves"),
    )
    nodes = nodes.withColumn("variance", F.try_divide("s", F.col("t") * F.col("t")))
    siblings = Window.partitionBy("period", F.shiftright("node", 1))
    both = (F.col("node") > 1) & (F.count("variance").over(siblings) == 2)
    share = F.when(both, 1 - F.try_divide("variance", F.sum("variance").over(siblings)))
    return nodes.select("period", "node", "lo", "n_leaves", "variance", share.alias("share"))


def bisection_weights(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(period, symbol, weight): the product of shares along each path; null where a node of the path has no share."""
    steps = paths.select("period", "symbol", F.explode("path").alias("node")).join(nodes.select("period", "node", "share"), ["period", "node"], "left")
    known = F.count("share") == F.count(F.lit(1)) - 1
    return steps.groupBy("period", "symbol").agg(F.when(known, F.coalesce(F.product("share"), F.lit(1.0))).alias("weight"))
