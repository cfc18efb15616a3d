"""Bars of a period back from the latest bar, period returns, quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed, ratio

# Length of the periods in months, and of the return periods in days (None: from January 1st).
MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60}
RETURN_DAYS = {"1D": 1, "5D": 5, "1M": 30, "3M": 90, "6M": 180, "YTD": None, "1Y": 365, "5Y": 1825}
WIDENING = ("1mo", "3mo", "6mo", "1y")


def months_before(ts: Column, months: int) -> Column:
    return ts - F.make_ym_interval(F.lit(0), F.lit(months))


def with_last(bars: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Add `last_ts`, the time of the latest bar of the series."""
    return bars.join(bars.groupBy(*by).agg(F.max("ts").alias("last_ts")), list(by))


def in_period(bars: DataFrame, period: str, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Bars of the last `period` of each series, counted back from its own latest bar."""
    return with_last(bars, by).filter(F.col("ts") >= months_before(F.col("last_ts"), MONTHS[period])).drop("last_ts")


def first_period_with_bars(bars: DataFrame, as_of: Column, periods: Sequence[str] = WIDENING) -> DataFrame:
    """Bars of the shortest of `periods` (back from `as_of`) that holds any bar, per instrument, with its name."""
    known = bars.filter(F.col("ts") <= as_of)
    newest = known.groupBy("instrument").agg(F.max("ts").alias("_newest"))
    chosen = F.coalesce(*[F.when(F.col("_newest") >= months_before(as_of, MONTHS[p]), F.lit(p)) for p in periods])
    start = F.coalesce(*[F.when(F.col("period") == p, months_before(as_of, MONTHS[p])) for p in periods])
    picked = newest.withColumn("period", chosen).filter(F.col("period").isNotNull()).drop("_newest")
    return known.join(picked, "instrument").filter(F.col("ts") >= start)


def period_returns(bars: DataFrame) -> DataFrame:
    """Percent change from the first bar on or after the start of each period to the latest bar; one column each."""
    last = F.col("last_ts")
    start = {
        name: F.date_trunc("year", last) if days is None else last - F.make_dt_interval(F.lit(days))
        for name, days in RETURN_DAYS.items()
    }
    inside = {name: F.when(F.col("ts") >= s, F.col("ts")) for name, s in start.items()}
    grouped = with_last(bars).groupBy("instrument").agg(
        F.max_by("close", "ts").alias("current_price"),
        *[F.min_by("close", ts).alias(f"_{name}") for name, ts in inside.items()],
    )
    change = {name: (F.col("current_price") - F.col(f"_{name}")) / F.nullif(F.col(f"_{name}"), F.lit(0.0)) * 100 for name in RETURN_DAYS}
    return grouped.select("instrument", "current_price", *[fixed(x, 2).alias(name) for name, x in change.items()])


def quotes(bars: DataFrame) -> DataFrame:
    """Latest close, the close before it, and the change; the change is 0 without a positive earlier close.

    Two rows per instrument survive the row number; Spark applies that limit before the shuffle too.
    """
    newest = Window.partitionBy("instrument").orderBy(F.desc("ts"))
    two = bars.select("instrument", "ts", "close").withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= 2)
    at = lambda rank, x: F.max(F.when(F.col("_rank") == rank, F.col(x)))
    pair = two.groupBy("instrument").agg(
        at(1, "ts").alias("ts"), at(1, "close").alias("current_price"), F.coalesce(at(2, "close"), F.lit(0.0)).alias("previous_close")
    )
    moved = F.col("previous_close") > 0
    change = F.col("current_price") - F.col("previous_close")
    return pair.withColumns(
        {
            "change": F.when(moved, change).otherwise(0.0),
            "change_percent": F.when(moved, ratio(change, F.col("previous_close")) * 100).otherwise(0.0),
            "currency": F.lit("USD"),
        }
    )


def chart_extents(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument").agg(
        (F.min("low") * 0.99).alias("y_min"), (F.max("high") * 1.01).alias("y_max"), F.max("volume").alias("volume_max")
    )
