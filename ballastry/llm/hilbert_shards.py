"""Sharding along a Hilbert curve.

Three metadata dimensions (language, source, size) are quantised to 32 levels each: names by a
hash, the size by its logarithm. Rows are sorted by their place on the three-dimensional Hilbert
curve through these cells, then by text hash, size and id, and the order is cut into runs of
equal row counts. Rows that are close in all dimensions share a shard, so a filter on any of them
touches few shards, which ``shard_statistics`` and ``shards_for`` tell. Rows of equal texts all take the least cell among them, so they are neighbours. The law is ``rows``: shard counts
differ by one at most, so a group of equal texts is cut only where a shard is full.

Plan: only (id, size, text hashes, cell) is range-partitioned for the placement, never the text. Cells of equal texts come from an
aggregate with map-side combining, of which only texts in several cells are joined back. A row's rank is its place in
its partition, which Spark's row ids give without a shuffle, plus the row counts of the partitions
before it: one number for each partition. The ordered rows are checkpointed, because range
boundaries come from a sample and must not be drawn twice. Range boundaries include the id, so a
hot cell or group of copies spreads over many partitions. ``write_shards`` moves whole rows once, and writes a folder a shard.

Defined results: a null text has size 1 and crc 0; it counts as equal to the empty text. A null language or source has level 0. Repeated rows each get a slot of their own. An empty table gives an empty result. Columns
other than doc_id, text, lang and source are not read by ``hilbert_shards``; ``write_shards`` writes all of them, save those named shard or slot (replaced).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballastry.llm.common import checkpointed, table

BITS = 5


def hilbert_index(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """Distances along the Hilbert curve of points with integer coordinates in [0, 2**bits).

    The transposed form of the index is found by undoing, from the highest bit down, the
    reflections and exchanges of axes of each subcube, followed by a Gray decoding.
    """
    axes = [np.asarray(c, dtype=np.int64).copy() for c in coordinates]
    n = len(axes)
    for bit in range(bits - 1, 0, -1):
        high, low = np.int64(1 << bit), np.int64((1 << bit) - 1)
        for i in range(n):
            flip = (axes[i] & high) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(flip, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    parity = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        parity ^= np.where((axes[-1] >> bit) & 1, np.int64((1 << bit) - 1), 0)
    axes = [a ^ parity for a in axes]
    out = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            out = (out << 1) | ((a >> bit) & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([x.to_numpy(), y.to_numpy(), z.to_numpy()], BITS))


def level_of_name(name: Column) -> Column:
    return F.when(name.isNull(), F.lit(0)).otherwise(F.pmod(F.crc32(name), F.lit(2**BITS)).cast("int"))


def level_of_size(size: Column) -> Column:
    """Half octaves of the size, from 16 bytes to 1 MB."""
    return F.least(F.greatest(F.floor(F.log2(size.cast("double")) * 2) - 8, F.lit(0)), F.lit(2**BITS - 1)).cast("int")


def _in_cells(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The rows with size, text_crc32, levels and cell; those of equal texts have the least cell of all."""
    text = F.coalesce("text", F.lit(""))
    cells = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        "lang",
        "source",
        F.xxhash64(text).alias("_hs_text"),
        *([F.struct(*carried).alias("_hs_doc")] if carried else []),
    )
    levels = (level_of_name(F.col("lang")), level_of_name(F.col("source")), level_of_size(F.col("size")))
    cells = cells.withColumn("curve", _curve(*levels))
    key = ["_hs_text", "text_crc32", "size"]
    apart = cells.groupBy(*key).agg(F.min("curve").alias("_hs_least"), F.max("curve").alias("_hs_most")).where("_hs_least < _hs_most").drop("_hs_most")
    return cells.join(apart, key, "left").withColumn("curve", F.coalesce("_hs_least", "curve")).drop("_hs_least")


def hilbert_shards(docs: DataFrame, shards: int = 16, carried: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, curve, shard and slot of every row, and a struct _hs_doc of the columns to carry."""
    cells = _in_cells(docs, carried or [])
    order = ["curve", "_hs_text", "size", "doc_id"]
    ordered = checkpointed(
        cells.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_hs_row", F.monotonically_increasing_id())
    )
    part = F.shiftright("_hs_row", 33)
    counts = ordered.groupBy(part.alias("part")).count().collect()  # one number a partition
    before, total = [], 0
    for row in sorted(counts, key=lambda r: r["part"]):
        before.append((row["part"], total))
        total += row["count"]
    starts = docs.sparkSession.createDataFrame(before, "_hs_part long, _hs_before long")
    rank = F.col("_hs_before") + F.col("_hs_row").bitwiseAND((1 << 33) - 1)
    ranked = ordered.join(F.broadcast(starts), part == F.col("_hs_part")).withColumn("_hs_rank", rank)
    # Rank r is in shard floor(r * shards / n), in whole numbers; the shard starts at ceil(shard * n / shards).
    shard = F.expr(f"_hs_rank * {shards}L div {max(total, 1)}L")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(cast(shard as bigint) * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("slot", (F.col("_hs_rank") - start).cast("long")).select(
        "doc_id", "size", "text_crc32", "lang", "source", "curve", "shard", "slot", *(["_hs_doc"] if carried else [])
    )


def shard_statistics(placed: DataFrame) -> DataFrame:
    """For each shard its rows and bytes, the range of sizes, and the levels of languages and sources (32 of each at most)."""
    return placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("size").alias("bytes"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.array_sort(F.collect_set(level_of_name(F.col("lang")))).alias("lang_levels"),
        F.array_sort(F.collect_set(level_of_name(F.col("source")))).alias("source_levels"),
    )


def shards_for(statistics: DataFrame, lang: str | None = None, source: str | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """The shards that may hold rows of a language, of a source, or of sizes from one to another; other shards need not be read."""
    keep = F.lit(True)
    if lang is not None:
        keep &= F.array_contains("lang_levels", level_of_name(F.lit(lang)))
    if source is not None:
        keep &= F.array_contains("source_levels", level_of_name(F.lit(source)))
    if sizes is not None:
        keep &= (F.col("min_size") <= sizes[1]) & (F.col("max_size") >= sizes[0])
    return statistics.where(keep).select("shard")


def write_shards(docs: DataFrame, folder: str, shards: int = 16) -> DataFrame:
    """Writes docs as Parquet to folder, a folder a shard, rows in order of their slots; the shards' statistics."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = hilbert_shards(docs, shards, names)
    placed.select("_hs_doc.*", "slot", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return shard_statistics(placed.drop("_hs_doc"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return hilbert_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
