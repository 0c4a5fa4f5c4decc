"""Price panels made from the star-schema tables: (symbol, d, close)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.operators.panel import Windows, indexed, returns
from ballastry.operators.strategies import Market
from ballastry.session import kept

#: (training rows, step) of each panel
SIZES = {"brand_week": (104, 4), "brand_day": (730, 30), "type_month": (24, 3), "size_month": (48, 3)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_prices(spark: SparkSession, sf_dir: str, column: str, unit: str) -> DataFrame:
    """Mean unit price of line items by a part's column and a unit of ship date."""
    items = load(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col(column).cast("string").alias("symbol"))
    day = F.to_date("l_shipdate") if unit == "day" else F.to_date(F.date_trunc(unit, "l_shipdate"))
    return (
        items.join(parts, items["l_partkey"] == parts["p_partkey"])
        .groupBy("symbol", day.alias("d"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    )


def panel(spark: SparkSession, sf_dir: str, name: str = "brand_week") -> DataFrame:
    kind, unit = name.split("_")
    if kind == "segment":
        orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
        buyers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
        joined = orders.join(buyers, orders["o_custkey"] == buyers["c_custkey"])
        return joined.groupBy("symbol", F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("close"))
    return unit_prices(spark, sf_dir, f"p_{kind}", unit)


def market(spark: SparkSession, sf_dir: str, name: str = "brand_week", periods: int | None = None, extra: int = 0) -> Market:
    """A panel with its windows. Prices and returns are kept, because every strategy reads them."""
    train, step = SIZES[name]
    px = kept(indexed(panel(spark, sf_dir, name)))
    windows = Windows.over(px, train, step, extra) if periods is None else Windows(train, step, periods)
    return Market(px, kept(returns(px)), windows)
