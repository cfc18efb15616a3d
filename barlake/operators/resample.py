"""Bars from ticks or from finer bars, and stacking of several grains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ohlcv(key: Column, open_: str, high: str, low: str, close: str, volume: str) -> list[Column]:
    """The five bar aggregates. `key` orders the rows of a bar; a fixed-width type keeps them in a hash aggregate."""
    return [
        F.min_by(open_, key).alias("open"),
        F.max(high).alias("high"),
        F.min(low).alias("low"),
        F.max_by(close, key).alias("close"),
        F.sum(volume).alias("volume"),
    ]


def bars_from_ticks(ticks: DataFrame, grain: str, by: Sequence[str] = ("instrument",), key: str = "ts") -> DataFrame:
    """Open, high, low, close and volume per `grain` (day, week, month, hour, ...). Partial aggregates are made before
    the shuffle, so a hot instrument costs no more than its number of bars."""
    prices = ohlcv(F.col(key), "price", "price", "price", "price", "volume")
    return ticks.groupBy(*by, F.date_trunc(grain, "ts").alias("ts")).agg(*prices)


def coarser_bars(bars: DataFrame, grain: str, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Daily -> weekly -> monthly bars."""
    prices = ohlcv(F.col("_ts"), "open", "high", "low", "close", "volume")
    return (
        bars.withColumnRenamed("ts", "_ts").groupBy(*by, F.date_trunc(grain, "_ts").alias("ts")).agg(*prices)
    )


def stack_grains(frames: dict[str, DataFrame]) -> DataFrame:
    """One frame with a `grain` column from several frames of the same shape."""
    parts = [df.withColumn("grain", F.lit(grain)) for grain, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
