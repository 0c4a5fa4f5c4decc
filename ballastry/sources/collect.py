"""Collecting candles into a stored table: resume, fetch, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballastry.sources.klines import PAUSE, historical_klines
from ballastry.sources.store import merge_version, newest, read_versioned, resume_points


def collect(spark: SparkSession, path: str, symbols: list[str], start: str, end: str, url: str, interval: str = "1d", mode: str = "merge", transport: str | None = None, pause: float = PAUSE, partitions: int = 1) -> DataFrame:
    """Goes on from the last stored candle of each symbol, and returns the table at path with what is new.

    New candles replace stored ones by (symbol, open_time); mode="replace_symbol" drops all older candles of a symbol
    that has new ones. Symbols that fail keep what is stored. Only slices with new candles are written again; what a lost run
    left unfinished is not read.
    """
    found = newest(spark, path)
    wanted = set(symbols)
    resume = {} if found is None else {r["symbol"]: r["start"] for r in resume_points(read_versioned(spark, path)).collect() if r["symbol"] in wanted}  # a row a symbol
    new = historical_klines(spark, symbols, interval, start, end, url, resume, transport, pause, partitions)
    merge_version(new, path, mode=mode)  # which fetches once
    return read_versioned(spark, path).orderBy("symbol", "open_time")
