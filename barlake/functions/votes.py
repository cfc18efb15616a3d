"""Rule columns: votes, signals, recommendations and the texts that go with them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

UP, DOWN, NEUTRAL = "UP", "DOWN", "NEUTRAL"


def _vote(up: Column, down: Column) -> Column:
    return F.when(up, F.lit(UP)).when(down, F.lit(DOWN)).otherwise(F.lit(NEUTRAL))


def model_vote(prediction: Column) -> Column:
    return _vote(prediction > 0.55, prediction < 0.45)


def rsi_vote(rsi: Column) -> Column:
    return _vote(rsi < 35, rsi > 65)


def macd_vote(macd: Column, signal: Column) -> Column:
    return _vote(macd > signal, macd < signal)


def trend_vote(price: Column, average: Column) -> Column:
    """More than 1% away from the average; no vote where the average is zero."""
    gap = F.try_divide(price - average, average)
    return _vote(gap > 0.01, gap < -0.01)


def sentiment_vote(score: Column) -> Column:
    return _vote(score > 0.15, score < -0.15)


def majority(votes: Mapping[str, Column]) -> dict[str, Column]:
    """Counts, direction, confidence in percent of the active votes, and strength of a set of vote columns."""
    count = lambda what: sum((F.when(v == what, 1).otherwise(0) for v in votes.values()), F.lit(0))
    up, down = count(UP), count(DOWN)
    winner = F.greatest(up, down)
    decided = up != down
    share = F.try_divide(winner.cast("double"), (up + down).cast("double")) * 100
    direction = F.when(up > down, F.lit(UP)).when(down > up, F.lit(DOWN)).otherwise(F.lit("UNCERTAIN"))
    size = F.when(winner >= 4, F.lit("STRONG_")).when(winner >= 3, F.lit("LIKELY_")).otherwise(F.lit("WEAK_"))
    return {
        "up_votes": up.cast("long"),
        "down_votes": down.cast("long"),
        "neutral_votes": count(NEUTRAL).cast("long"),
        "direction": direction,
        "confidence": F.when(decided, F.round(share)).otherwise(F.lit(0.0)).cast("long"),
        "strength": F.when(decided, F.concat(size, direction)).otherwise(F.lit("NO_CLEAR_SIGNAL")),
    }


def combined_votes(prediction: str, price: str, rsi: str, macd: str, macd_signal: str, average: str, sentiment: str) -> dict[str, Column]:
    """The five voters over columns of one row; missing inputs take neutral values (0.5, 50, 0, 0, price, 0)."""
    c = lambda name, default: F.coalesce(F.col(name), default if isinstance(default, Column) else F.lit(float(default)))
    return {
        "ml_vote": model_vote(c(prediction, 0.5)),
        "rsi_vote": rsi_vote(c(rsi, 50)),
        "macd_vote": macd_vote(c(macd, 0), c(macd_signal, 0)),
        "trend_vote": trend_vote(F.col(price), c(average, F.col(price))),
        "sentiment_vote": sentiment_vote(c(sentiment, 0)),
    }


OVERSOLD, OVERBOUGHT = "OVERSOLD (BUY)", "OVERBOUGHT (SELL)"


def indicator_signals() -> dict[str, Column]:
    """Texts of the six indicators on a row with the indicator columns."""
    c = F.col
    atr_percent = F.try_divide(c("atr"), c("close")) * 100
    return {
        "rsi_signal": F.when(c("rsi") < 30, OVERSOLD).when(c("rsi") > 70, OVERBOUGHT).otherwise(NEUTRAL),
        "macd_text": F.when(c("macd") > c("macd_signal"), "BUY").otherwise("SELL"),
        "bb_signal": F.when(c("close") > c("bb_upper"), OVERBOUGHT).when(c("close") < c("bb_lower"), OVERSOLD).otherwise(NEUTRAL),
        "atr_percent": atr_percent,
        "atr_signal": F.when(atr_percent > 3, "HIGH VOLATILITY").when(atr_percent < 1, "LOW VOLATILITY").otherwise("NORMAL"),
        "stoch_signal": F.when((c("stoch_k") > 80) & (c("stoch_d") > 80), OVERBOUGHT)
        .when((c("stoch_k") < 20) & (c("stoch_d") < 20), OVERSOLD)
        .when(c("stoch_k") > c("stoch_d"), "BULLISH (BUY)")
        .otherwise("BEARISH (SELL)"),
        "williams_signal": F.when(c("williams_r") > -20, OVERBOUGHT).when(c("williams_r") < -80, OVERSOLD).otherwise(NEUTRAL),
    }


def recommendation() -> dict[str, Column]:
    """Five of the six texts vote (volatility does not); buys are looked at first."""
    voting = ("rsi_signal", "macd_text", "bb_signal", "stoch_signal", "williams_signal")
    buys = sum((F.col(v).contains("BUY").cast("long") for v in voting), F.lit(0))
    sells = sum((F.col(v).contains("SELL").cast("long") for v in voting), F.lit(0))
    text = (
        F.when(buys >= 3, "STRONG BUY").when(buys >= 2, "BUY").when(sells >= 3, "STRONG SELL").when(sells >= 2, "SELL").otherwise("HOLD")
    )
    return {"buy_signals": buys.cast("long"), "sell_signals": sells.cast("long"), "recommendation": text}


def timeframe_scores() -> dict[str, Column]:
    """Buy and sell points of one bar from RSI, MACD, stochastic and the moving averages."""
    c = F.col
    above, below = c("close") > c("sma_20"), c("close") < c("sma_20")
    rising, falling = above & (c("sma_20") > c("sma_50")), below & (c("sma_20") < c("sma_50"))
    macd_up = c("macd") > c("macd_signal")
    buy = _points((c("rsi") < 30, 2), (c("rsi") < 40, 1)) + _points((macd_up, 1)) + _points((c("stoch_k") < 20, 2), (c("stoch_k") < 30, 1))
    sell = _points((c("rsi") > 70, 2), (c("rsi") > 60, 1)) + _points((c("stoch_k") > 80, 2), (c("stoch_k") > 70, 1))
    sell = sell + F.when(macd_up, 0).otherwise(1)
    return {
        "buy_score": (buy + _points((rising, 2), (falling, 0), (above, 1))).cast("long"),
        "sell_score": (sell + _points((rising, 0), (falling, 2), (above, 0), (below, 1))).cast("long"),
        "price_vs_sma20": (F.try_divide(c("close"), c("sma_20")) - 1) * 100,
        "price_vs_sma50": (F.try_divide(c("close"), c("sma_50")) - 1) * 100,
        "bb_position": F.when(c("bb_upper") > c("bb_lower"), (c("close") - c("bb_lower")) / F.nullif(c("bb_upper") - c("bb_lower"), F.lit(0.0))).otherwise(0.5),
    }


def _points(*rules: tuple[Column, int]) -> Column:
    """Points of the first rule that holds, else 0."""
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(0))


def timeframe_signal(buy: Column, sell: Column) -> dict[str, Column]:
    share = F.try_divide(F.greatest(buy, sell).cast("double"), (buy + sell).cast("double")) * 100
    return {
        "signal": F.when(buy > sell, "BUY").when(sell > buy, "SELL").otherwise(NEUTRAL),
        "confidence": F.when(buy == sell, F.lit(0.0)).otherwise(share),
    }


def trading_signal(prediction: Column, buy_above: float = 0.52, sell_below: float | None = None) -> Column:
    """1 buy, -1 sell, 0 hold; by default symmetric around one half."""
    low = 1 - buy_above if sell_below is None else sell_below
    return F.when(prediction > buy_above, 1).when(prediction < low, -1).otherwise(0)


def simple_signal(prediction: Column) -> dict[str, Column]:
    return {"signal": F.when(prediction > 0.5, "BUY").otherwise("SELL"), "confidence": F.abs(prediction - 0.5) * 200}


def alert_condition(alert_type: Column, value: Column) -> Column:
    text = value.cast("string")
    return (
        F.when(alert_type == "price_above", F.concat(F.lit("Price > $"), text))
        .when(alert_type == "price_below", F.concat(F.lit("Price < $"), text))
        .when(alert_type == "rsi_above", F.concat(F.lit("RSI > "), text))
        .when(alert_type == "rsi_below", F.concat(F.lit("RSI < "), text))
        .otherwise(alert_type)
    )


def direction_correct(signal: Column, before: Column, after: Column) -> Column:
    """BUY wants a higher price, SELL a lower one, anything else is always right."""
    return F.when(signal == "BUY", after > before).when(signal == "SELL", after < before).otherwise(F.lit(True))


def legacy_direction(text: Column) -> Column:
    upper = F.upper(text)
    return F.when(upper.contains("BUY"), UP).when(upper.contains("SELL"), DOWN).otherwise("UNCERTAIN")


def record_id(instrument: Column, at: Column) -> Column:
    return F.concat_ws("_", instrument, F.date_format(at, "yyyyMMdd_HHmmss"))
