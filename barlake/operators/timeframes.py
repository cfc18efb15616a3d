"""Signals of several grains and their blend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed
from barlake.functions.votes import timeframe_scores, timeframe_signal
from barlake.operators.indicators import latest_indicators
from barlake.operators.resample import stack_grains

# Weight of each timeframe, and the least number of bars for a signal.
WEIGHTS = {"day": 0.40, "week": 0.35, "month": 0.25}
LEAST_BARS = 30
NEEDED = ("rsi", "macd", "macd_signal", "stoch_k", "adx", "sma_20", "sma_50", "bb_upper", "bb_lower")


def timeframe_signals(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per instrument and grain: points, signal and confidence on the latest bar. Series with fewer than 30
    bars are NEUTRAL with confidence 0."""
    bars = stack_grains({grain: df.select("instrument", "ts", "open", "high", "low", "close", "volume") for grain, df in frames.items()})
    last = latest_indicators(bars, NEEDED, by=("instrument", "grain"), fill=True)
    scored = last.withColumns(timeframe_scores())
    voted = scored.withColumns(timeframe_signal(F.col("buy_score"), F.col("sell_score")))
    enough = F.col("n") >= LEAST_BARS
    return voted.withColumns(
        {
            "signal": F.when(enough, F.col("signal")).otherwise("NEUTRAL"),
            "confidence": F.when(enough, F.col("confidence")).otherwise(0.0),
        }
    )


def blend(signals: DataFrame) -> DataFrame:
    """Weighted signal of the three grains per instrument, with their agreement."""
    side = F.when(F.col("signal") == "BUY", 1).when(F.col("signal") == "SELL", -1).otherwise(0)
    weight = F.coalesce(*[F.when(F.col("grain") == g, F.lit(w)) for g, w in WEIGHTS.items()])
    counted = signals.groupBy("instrument").agg(
        F.sum(F.round(weight * 100).cast("long") * side).alias("_points"),
        F.count_if(F.col("signal") == "BUY").alias("buys"),
        F.count_if(F.col("signal") == "SELL").alias("sells"),
    )
    strong = lambda n, text: F.when(F.col(n) == len(WEIGHTS), F.lit("STRONG " + text)).otherwise(F.lit(text))
    others = F.lit(len(WEIGHTS)) - F.col("buys") - F.col("sells")
    return counted.select(
        "instrument",
        F.when(F.col("_points") > 20, strong("buys", "BUY")).when(F.col("_points") < -20, strong("sells", "SELL")).otherwise("HOLD").alias("combined_signal"),
        fixed(F.greatest("buys", "sells").cast("double") / len(WEIGHTS) * 100, 1).alias("combined_confidence"),
        F.format_string("%dB/%dS/%dN", F.col("buys"), F.col("sells"), others).alias("agreement"),
    )
