"""Candles from an exchange's HTTP interface, as a Python data source.

    spark.dataSource.register(KlineSource)
    spark.read.format("klines").options(symbols="AAAUSDT,BBBUSDT", start="2023-01-01", end="2024-01-01", url=...).load()

Symbols are dealt to ``partitions`` tasks, and the pause between calls grows with their number, so the request rate is the
same on any cluster. A symbol is read page by page: the next page starts a millisecond after the last
candle; a start at or past the end, or an empty page, ends it. A symbol that fails, or gives a row
that is no candle, is left out whole, so that no part of it can replace what is stored; others go on. A task so holds the candles of one symbol. ``transport`` names a function
"module:function" that maps (url, parameters) to the decoded JSON; without it pages come by HTTP.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from http.client import HTTPException

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ballastry.schema import KLINES

PAGE = 1000
PAUSE = 0.1

Transport = Callable[[str, dict], object]


def http(url: str, parameters: dict) -> object:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(parameters)}", timeout=60) as answer:
        return json.load(answer)


def transport(name: str | None) -> Transport:
    if not name:
        return http
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def millis(day: str) -> int:
    return int(datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=UTC).timestamp() * 1000)


def pages(fetch: Transport, url: str, symbol: str, interval: str, start: int, end: int, pause: float = PAUSE) -> Iterator[list]:
    """The candles of a symbol, as the interface gives them."""
    while start < end:
        page = fetch(url, {"symbol": symbol, "interval": interval, "startTime": start, "endTime": end, "limit": PAGE})
        if not page:
            return
        yield from page
        start = int(page[-1][0]) + 1
        time.sleep(pause)


def candle(symbol: str, row: list) -> tuple:
    at = lambda ms: datetime.fromtimestamp(int(ms) / 1000, UTC)
    numbers = [float(x) for x in row[1:6]]
    return (symbol, at(row[0]), *numbers, at(row[6]), float(row[7]), int(row[8]), float(row[9]), float(row[10]), str(row[11]))


class SymbolPartition(InputPartition):
    def __init__(self, symbols: list[tuple[str, int]], pause: float) -> None:
        self.symbols, self.pause = symbols, pause


class KlineReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        """Symbols and their starts; ``resume`` is a JSON object of start times in ms that replace the start."""
        resume, o = json.loads(self.options.get("resume", "{}")), self.options
        start = millis(o["start"])
        symbols = [(s.strip(), int(resume.get(s.strip(), start))) for s in o["symbols"].split(",") if s.strip()]
        n = min(max(1, int(o.get("partitions", "1"))), len(symbols))
        return [SymbolPartition(symbols[k::n], float(o.get("pause", PAUSE)) * n) for k in range(n)]

    def read(self, partition: SymbolPartition) -> Iterator[tuple]:
        o = self.options
        fetch = transport(o.get("transport"))
        for symbol, start in partition.symbols:
            try:
                found = pages(fetch, o.get("url", ""), symbol, o.get("interval", "1d"), start, millis(o["end"]), partition.pause)
                rows = [candle(symbol, row) for row in found]
            except (OSError, HTTPException, ValueError, TypeError, LookupError):
                continue  # no answer, one that is no JSON, or rows that are no candles
            yield from rows


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return KLINES

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)


def historical_klines(spark: SparkSession, symbols: list[str], interval: str, start: str, end: str, url: str, resume: dict[str, int] | None = None, transport: str | None = None, pause: float = PAUSE, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(KlineSource)
    options = {"symbols": ",".join(symbols), "interval": interval, "start": start, "end": end, "url": url, "resume": json.dumps(resume or {}), "pause": str(pause), "partitions": str(partitions)}
    if transport:
        options["transport"] = transport
    return spark.read.format("klines").options(**options).load()


def parse_klines(payloads: DataFrame) -> DataFrame:
    """Candles from (symbol, payload), where a payload is the JSON of a page."""
    rows = payloads.select("symbol", F.explode(F.from_json("payload", "array<array<string>>")).alias("r"))
    names = ["open", "high", "low", "close", "volume"]
    return rows.select(
        "symbol",
        F.timestamp_millis(F.col("r")[0].cast("long")).alias("open_time"),
        *[F.col("r")[k + 1].cast("double").alias(n) for k, n in enumerate(names)],
        F.timestamp_millis(F.col("r")[6].cast("long")).alias("close_time"),
        F.col("r")[7].cast("double").alias("quote_volume"),
        F.col("r")[8].cast("long").alias("num_trades"),
        F.col("r")[9].cast("double").alias("taker_base_vol"),
        F.col("r")[10].cast("double").alias("taker_quote_vol"),
        F.col("r")[11].alias("ignore"),
    )


def quoted_symbols(exchange_info: DataFrame, quote: str = "USDT") -> DataFrame:
    """(symbol) from exchange-info payloads (payload), with the given quote currency."""
    rows = exchange_info.select(F.explode(F.from_json("payload", "symbols array<struct<symbol: string>>")["symbols"]).alias("s"))
    return rows.select(F.col("s.symbol").alias("symbol")).where(F.col("symbol").endswith(quote))


def existing_symbols(requested: DataFrame, listed: DataFrame) -> DataFrame:
    """requested (ordinal, symbol) that are listed, in their order, repeats kept."""
    return requested.join(listed, "symbol", "left_semi").orderBy("ordinal")
