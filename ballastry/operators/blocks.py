"""Rolling covariances from block states: dates are cut into blocks once, and windows are merged from blocks.

A block has g dates, the greatest common divisor of window and step, so every window is a run of whole blocks.
Its state for a pair is (means, co-moment); states of equal blocks merge by Chan's formula, which for a run of
B blocks is the sum of their co-moments plus g * B times the population covariance of their means.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballastry.operators.panel import Windows


def block_rows(windows: Windows) -> int:
    """Dates of a block."""
    return gcd(windows.train, windows.step)


def symbol_blocks(rets: DataFrame, rows: int) -> DataFrame:
    """(symbol, block, mean, dev): blocks with a return on each of their dates; dev are the returns less their mean, by date.

    Block b has the dates b * rows < t_idx <= (b + 1) * rows. A block with a gap is in no complete window and is left out.
    """
    block = (F.ceil(F.col("t_idx") / rows) - 1).cast("long")
    own = rets.where("t_idx >= 1 and ret is not null").groupBy("symbol", block.alias("block")).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.array_sort(F.collect_list(F.struct("t_idx", "ret"))).alias("by_date")
    )
    dev = F.transform("by_date", lambda r: r["ret"] - F.col("mean"))
    return own.where(F.col("n") == rows).select("symbol", "block", "mean", dev.alias("dev"))


def pair_blocks(states: DataFrame) -> DataFrame:
    """(i, j, block, mx, my, comoment) for i <= j: one row a pair and block, whatever the number of windows over it."""
    a = states.select("block", F.col("symbol").alias("i"), F.col("mean").alias("mx"), F.col("dev").alias("dx"))
    b = states.select("block", F.col("symbol").alias("j"), F.col("mean").alias("my"), F.col("dev").alias("dy"))
    products = F.zip_with("dx", "dy", lambda x, y: x * y)
    comoment = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return a.join(b, "block").where("i <= j").select("i", "j", "block", "mx", "my", comoment.alias("comoment"))


def merged_covariances(rets: DataFrame, windows: Windows) -> DataFrame:
    """(period, i, j, cov) for i <= j of the symbols whose training window is complete, as ``moments.covariances``.

    Pair rows are never repeated by window: a frame over a pair's blocks merges their states. A window of
    one date has no covariance (null). rets has one row a symbol and date; null returns count as gaps.
    """
    rows = block_rows(windows)
    blocks = windows.train // rows
    run = Window.partitionBy("i", "j").orderBy("block").rangeBetween(1 - blocks, 0)
    between = F.covar_pop("mx", "my").over(run) * float(windows.train)
    merged = pair_blocks(symbol_blocks(rets, rows)).select(
        "i", "j", ((F.col("block") + 1) * rows - windows.train).alias("start"), F.count(F.lit(1)).over(run).alias("n"),
        F.try_divide(F.sum("comoment").over(run) + between, F.lit(float(windows.train - 1))).alias("cov"),
    )
    start, last = F.col("start"), (windows.periods - 1) * windows.step
    ends = (F.col("n") == blocks) & (start >= 0) & (start <= last) & (start % windows.step == 0)
    return merged.where(ends).select((start / windows.step).cast("long").alias("period"), "i", "j", "cov")
