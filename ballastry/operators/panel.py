"""Price panels in long form: (d, symbol, close), one row an observed price.

Time is positional: t_idx is a date's place among the distinct dates of the panel. A missing return is
a missing row, so no dense grid is needed for the strategies: a window is complete for a symbol when
it has as many rows as the window has dates. ``densify`` makes the grid where a result shows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("t_idx")


def calendar(prices: DataFrame) -> DataFrame:
    """(d, t_idx). The dates are few, so their order is one small sort."""
    return prices.select("d").distinct().withColumn("t_idx", (F.row_number().over(Window.orderBy("d")) - 1).cast("long"))


def indexed(prices: DataFrame) -> DataFrame:
    """prices with t_idx. The calendar has a row a date."""
    return prices.join(calendar(prices), "d")


def duplicate_keys(prices: DataFrame) -> DataFrame:
    """(symbol, d, n) of keys that break the panel's uniqueness."""
    return prices.groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def returns(px: DataFrame) -> DataFrame:
    """(d, t_idx, symbol, ret) where this date and the one before it in the calendar have a price."""
    before, at = F.lag("close").over(by_symbol()), F.lag("t_idx").over(by_symbol())
    ret = F.when(at == F.col("t_idx") - 1, F.try_divide(F.col("close"), before) - 1)
    return px.select("d", "t_idx", "symbol", ret.alias("ret")).where("ret is not null")


def densify(px: DataFrame, value: str = "close") -> DataFrame:
    """Every symbol on every date, with null where there is no row."""
    dates = px.select("d", "t_idx").distinct()
    grid = px.groupBy("symbol").agg(F.min("t_idx").alias("_first")).drop("_first").crossJoin(dates)
    return grid.join(px.select("symbol", "t_idx", value), ["symbol", "t_idx"], "left")


def returns_padded(px: DataFrame, drop_rows: bool = True) -> DataFrame:
    """Returns on the dense grid with the last price carried forward; rows with a gap are dropped by date.

    A date stays if all symbols have a return on it.
    """
    filled = F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    grid = densify(px).withColumn("close", filled)
    out = grid.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1).select("d", "t_idx", "symbol", "ret")
    if not drop_rows:
        return out
    full = out.groupBy("t_idx").agg(F.count(F.lit(1)).alias("n"), F.count("ret").alias("k")).where("n = k").select("t_idx")
    return out.join(full, "t_idx", "left_semi")


def returns_observed(prices: DataFrame, value: str = "close") -> DataFrame:
    """Returns between successive rows of a symbol, nulls carried forward; the first row's is null."""
    by_date = Window.partitionBy("symbol").orderBy("d")
    filled = F.last(value, ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, 0))
    out = prices.withColumn("_filled", filled)
    return out.withColumn("ret", F.try_divide(F.col("_filled"), F.lag("_filled").over(by_date)) - 1).drop("_filled")


def null_after(rets: DataFrame, date: Column) -> DataFrame:
    """Symbols with a null return after a date."""
    return rets.where(F.col("d") > date).groupBy("symbol").agg(F.bool_or(F.col("ret").isNull()).alias("gap")).where("gap").select("symbol")


@dataclass(frozen=True)
class Windows:
    """Rolling windows in rows: `train` returns, then `step` returns to test, moving by `step`.

    Period p trains on p * step < t <= p * step + train and tests on the `step` rows after that.
    """

    train: int
    step: int
    periods: int

    @classmethod
    def over(cls, px: DataFrame, train: int, step: int, extra: int = 0) -> Windows:
        """As many periods as fit; the driver learns the number of dates."""
        n = px.agg(F.countDistinct("t_idx")).first()[0]
        return cls(train, step, max((n - train - step) // step, 0) + extra)

    def table(self, px: DataFrame) -> DataFrame:
        p = F.col("period")
        return px.sparkSession.range(self.periods).select(
            F.col("id").alias("period"),
            (F.col("id") * self.step + 1).alias("train_lo"),
            (F.col("id") * self.step + self.train).alias("train_hi"),
            (F.col("id") * self.step + self.train + 1).alias("test_lo"),
            (F.col("id") * self.step + self.train + self.step).alias("test_hi"),
        ).orderBy(p)

    def training(self, rows: DataFrame) -> DataFrame:
        """rows (t_idx) once for each period that trains on them: periods from arithmetic, not by a range join."""
        t = F.col("t_idx")
        first = F.greatest(F.lit(0), F.ceil((t - self.train) / self.step)).cast("long")
        last = F.least(F.lit(self.periods - 1), F.ceil(t / self.step) - 1).cast("long")
        # where windows leave dates out (train < step), those dates have first > last
        fits = (t >= 1) & (t <= (self.periods - 1) * self.step + self.train) & (first <= last)
        return rows.where(fits).withColumn("period", F.explode(F.sequence(first, last)))

    def testing(self, rows: DataFrame) -> DataFrame:
        """rows with the period that tests on them."""
        t = F.col("t_idx")
        return rows.where((t > self.train) & (t <= self.train + self.periods * self.step)).withColumn(
            "period", (F.ceil((t - self.train) / self.step) - 1).cast("long")
        )

    def last(self) -> Column:
        """The last training row of a row's period."""
        return F.col("period") * self.step + self.train


def universe(train: DataFrame, windows: Windows) -> DataFrame:
    """(period, symbol) with a return on every training date."""
    return train.groupBy("period", "symbol").agg(F.count("ret").alias("n")).where(F.col("n") == windows.train).select("period", "symbol")


def pair_names(symbols: DataFrame) -> DataFrame:
    """All ordered pairs of distinct symbols' bases, concatenated both ways: (pair)."""
    base = symbols.select(F.regexp_replace("symbol", "USDT$", "").alias("s")).distinct()
    a, b = base.select(F.col("s").alias("a")), base.select(F.col("s").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select(F.explode(F.array(F.concat("a", "b"), F.concat("b", "a"))).alias("pair"))
