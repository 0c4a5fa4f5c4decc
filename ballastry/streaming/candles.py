"""Candles from a stream of ticks, and a sink that merges them into stored candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.sources.store import merge_version, read_versioned


def candles(ticks: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(symbol, open_time, open, high, low, close, volume, num_trades) from ticks (symbol, ts, value).

    Works on batches and streams; `late` sets a stream's watermark. Ties in time go by value.
    """
    if late:
        ticks = ticks.withWatermark("ts", late)
    key = F.struct("ts", "value")
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", key).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", key).alias("close"),
            F.sum("value").alias("volume"),
            F.count(F.lit(1)).alias("num_trades"),
        )
        .select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "num_trades")
    )


def merge_into(path: str, stream: str | None = None):
    """A foreachBatch function that merges each batch into the table at path by (symbol, open_time).

    The table notes the last batch of each stream, so a batch that is replayed changes nothing, and one that was cut off is written
    again. stream names the source of the batches; by default it is the query's id, which its checkpoint keeps over restarts. A new
    checkpoint is a new stream, whose batches 0, 1, ... are taken after all that is stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        merge_version(batch, path, batch=(name, batch_id))

    return write


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return read_versioned(spark, path)
