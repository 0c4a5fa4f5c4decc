"""Price histories and listings of a price interface."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ballastry.operators.panel import indexed, returns_padded
from ballastry.schema import COIN_IDS, PRICES, STABLE_TICKERS
from ballastry.sources.klines import transport as transport_named

HISTORY = "struct<prices: array<array<double>>, market_caps: array<array<double>>, total_volumes: array<array<double>>>"


class CoinPartition(InputPartition):
    def __init__(self, coins: list[str]) -> None:
        self.coins = coins


class PriceReader(DataSourceReader):
    """Coins are dealt to few partitions, because the pause between calls is kept in each."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        coins = [c.strip() for c in self.options["coins"].split(",") if c.strip()]
        n = max(1, int(self.options.get("partitions", "1")))
        return [CoinPartition(coins[k::n]) for k in range(min(n, len(coins)))]

    def read(self, partition: CoinPartition) -> Iterator[tuple]:
        o = self.options
        fetch = transport_named(o.get("transport"))
        for k, coin in enumerate(partition.coins):
            if k:
                time.sleep(float(o.get("pause", "2.0")))
            try:
                data = fetch(f"{o.get('url', '')}/{coin}", {"vs_currency": o.get("currency", "usd"), "days": o.get("days", "365"), "interval": o.get("interval", "daily")})
            except (OSError, ValueError):
                continue  # a coin without an answer, or with one that is no JSON, is left out; others go on
            caps, volumes = dict(map(tuple, data.get("market_caps", []))), dict(map(tuple, data.get("total_volumes", [])))
            for ms, price in data.get("prices", []):
                yield coin, datetime.fromtimestamp(ms / 1000, UTC), float(price), caps.get(ms), volumes.get(ms)


class PriceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "price_history"

    def schema(self) -> str:
        return PRICES

    def reader(self, schema) -> PriceReader:
        return PriceReader(self.options)


def price_history(spark: SparkSession, coins: list[str], url: str, days: int = 365, currency: str = "usd", pause: float = 2.0, transport: str | None = None) -> DataFrame:
    spark.dataSource.register(PriceSource)
    options = {"coins": ",".join(coins), "url": url, "days": str(days), "currency": currency, "pause": str(pause)} | ({"transport": transport} if transport else {})
    return spark.read.format("price_history").options(**options).load()


def parse_history(payloads: DataFrame) -> DataFrame:
    """The price table from (coin_id, payload); market caps and volumes join by timestamp where there are any."""
    data = payloads.select("coin_id", F.from_json("payload", HISTORY).alias("p"))

    def series(field: str, name: str) -> DataFrame:
        points = data.select("coin_id", F.explode(F.col("p")[field]).alias("x"))
        return points.select("coin_id", F.timestamp_millis(F.col("x")[0].cast("long")).alias("timestamp"), F.col("x")[1].alias(name))

    keys = ["coin_id", "timestamp"]
    return join_history(series("prices", "price"), series("market_caps", "market_cap"), series("total_volumes", "volume"), keys)


def join_history(prices: DataFrame, caps: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    return prices.join(caps, keys, "left").join(volumes, keys, "left")


def top_coins(listing: DataFrame, limit: int = 100) -> DataFrame:
    """The largest coins by market cap (at most 250, a page), symbols in capitals, missing caps as 0."""
    cap = F.coalesce("market_cap", F.lit(0.0))
    return listing.withColumn("symbol", F.upper("symbol")).withColumn("market_cap", cap).orderBy(F.desc("market_cap"), "id").limit(min(limit, 250))


def without_stable(listing: DataFrame) -> DataFrame:
    return listing.where(~F.lower("symbol").isin(STABLE_TICKERS))


def coin_id(symbol: Column) -> Column:
    """The price interface's id of an exchange symbol; null if unknown."""
    pairs = [F.lit(x) for pair in COIN_IDS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), symbol)


def quoted_name(symbol: Column, quote: str = "USDT") -> Column:
    up = F.upper(symbol)
    return F.when(up.endswith(quote), up).otherwise(F.concat(up, F.lit(quote)))


def returns_matrix(prices: DataFrame, value: str = "price") -> DataFrame:
    """Padded returns (d, t_idx, symbol, ret) of coins, on the dates where all have one."""
    panel = prices.select(F.to_date("timestamp").alias("d"), quoted_name(F.col("coin_id")).alias("symbol"), F.col(value).alias("close"))
    return returns_padded(indexed(panel))


def chosen_coins(listing: DataFrame, n: int = 50, exclude_stable: bool = True) -> DataFrame:
    """The n largest coins of a listing, without stable ones."""
    coins = top_coins(listing, n + 20)
    return (without_stable(coins) if exclude_stable else coins).orderBy(F.desc("market_cap"), "id").limit(n)


def dataset(listing: DataFrame, history: DataFrame, n: int = 50, exclude_stable: bool = True) -> DataFrame:
    """The returns of the n largest coins without stable ones, from a listing and a history of its coins."""
    coins = chosen_coins(listing, n, exclude_stable).select(F.col("id").alias("coin_id"), "symbol")
    chosen = history.join(coins, "coin_id")
    return returns_matrix(chosen.select(F.col("symbol").alias("coin_id"), "timestamp", "price"))


def listing_of(spark: SparkSession, url: str, limit: int, currency: str = "usd", transport: str | None = None) -> DataFrame:
    """(id, symbol, name, market_cap) of the largest coins, from one page of the interface (250 rows at most)."""
    parameters = {"vs_currency": currency, "order": "market_cap_desc", "per_page": min(limit, 250), "page": 1}
    rows = transport_named(transport)(url, parameters)
    parts = [(str(r["id"]), r.get("symbol"), r.get("name"), None if r.get("market_cap") is None else float(r["market_cap"])) for r in rows]
    return spark.createDataFrame(parts, "id string, symbol string, name string, market_cap double")


def fetch_dataset(spark: SparkSession, listing_url: str, history_url: str, n: int = 50, days: int = 365, exclude_stable: bool = True, pause: float = 2.5, transport: str | None = None) -> DataFrame:
    """The whole way: listing, largest coins, no stable ones, their histories, returns."""
    listing = listing_of(spark, listing_url, n + 20, transport=transport)
    coins = [r["id"] for r in chosen_coins(listing, n, exclude_stable).collect()]  # n rows
    return dataset(listing, price_history(spark, coins, history_url, days, pause=pause, transport=transport), n, exclude_stable)
