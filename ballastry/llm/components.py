"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballastry.llm.common import checkpointed

ROWS_A_TASK = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges (u > v): relinks neighbours to the smallest one.

    Minima are aggregates with map-side combining; a node with very many neighbours only makes the
    join large, which Spark may split.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    moved = both.where("v > u" if large else "true").join(least, F.col("u") == F.col("k"))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    out = out.where("u > v")
    return out if large else out.distinct()  # what the large step repeats, the small one drops


def components(edges: DataFrame, max_steps: int = 50) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    edges has two columns of one ordered type. Each step is checkpointed, so plans stay short and
    a lost executor costs no earlier step. The driver sees one sum a step.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = checkpointed(now)
    last = None
    for _ in range(max_steps):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = mark
        tasks = max(8, -(-mark["n"] // ROWS_A_TASK))  # near-empty partitions cost files in every shuffle
        now = checkpointed(_star(_star(now.coalesce(tasks), True).coalesce(tasks), False).coalesce(tasks))
    raise RuntimeError(f"components did not settle in {max_steps} steps")
