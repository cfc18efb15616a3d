"""Votes, signals, timeframes, period returns and quotes over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed, fixed_text
from barlake.functions.votes import indicator_signals, legacy_direction, model_vote, recommendation, rsi_vote, trend_vote
from barlake.operators.indicators import indicators, latest_indicators
from barlake.operators.periods import RETURN_DAYS, chart_extents, first_period_with_bars, in_period, period_returns, quotes
from barlake.operators.timeframes import blend, timeframe_signals
from barlake.plans.indicator_queries import DAY
from barlake.plans.registry import register
from barlake.plans.sqltext import PLACES, TICKS, bars, day, div, filled, indicator_chain, r, weekly, with_
from barlake.sources import bindings

SIX = ("rsi", "macd", "macd_signal", "bb_upper", "bb_lower", "atr", "stoch_k", "stoch_d", "williams_r")

RSI_VOTE = "CASE WHEN rsi < 35 THEN 'UP' WHEN rsi > 65 THEN 'DOWN' ELSE 'NEUTRAL' END"
TREND_VOTE = f"""CASE WHEN {div('close - sma_20', 'sma_20')} > CAST(0.01 AS DOUBLE) THEN 'UP'
  WHEN {div('close - sma_20', 'sma_20')} < CAST(-0.01 AS DOUBLE) THEN 'DOWN' ELSE 'NEUTRAL' END"""


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    frame = indicators(bindings.series(spark, folder), ["rsi", "sma_20"])
    return frame.select(
        "instrument", F.expr(DAY), rsi_vote(F.col("rsi")).alias("rsi_vote"), trend_vote(F.col("close"), F.col("sma_20")).alias("trend_vote")
    )


register("rsi_and_trend_votes", _votes, with_(*weekly(), *indicator_chain(), select=f"SELECT instrument, {day()} AS day, {RSI_VOTE} AS rsi_vote, {TREND_VOTE} AS trend_vote FROM ind"))


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    frame = latest_indicators(bindings.bars(spark, folder), ["sma_20", "rsi"], fill=True)
    return frame.select(
        "instrument", F.expr(DAY), "close", fixed("sma_20").alias("sma_20"), fixed("rsi").alias("rsi"),
        rsi_vote(F.col("rsi")).alias("rsi_vote"), trend_vote(F.col("close"), F.col("sma_20")).alias("trend_vote"),
    )


register(
    "latest_rsi_and_trend",
    _latest,
    with_(
        *weekly(), *indicator_chain(), filled(["sma_20", "rsi"]),
        select=f"SELECT instrument, {day()} AS day, close, {r('sma_20')} AS sma_20, {r('rsi')} AS rsi, {RSI_VOTE} AS rsi_vote, {TREND_VOTE} AS trend_vote FROM filled WHERE pos = n",
    ),
)

SIGNAL_SQL = """signals AS (SELECT *,
  CASE WHEN rsi < 30 THEN 'OVERSOLD (BUY)' WHEN rsi > 70 THEN 'OVERBOUGHT (SELL)' ELSE 'NEUTRAL' END AS rsi_signal,
  CASE WHEN macd > macd_signal THEN 'BUY' ELSE 'SELL' END AS macd_text,
  CASE WHEN close > bb_upper THEN 'OVERBOUGHT (SELL)' WHEN close < bb_lower THEN 'OVERSOLD (BUY)' ELSE 'NEUTRAL' END AS bb_signal,
  atr / close * 100 AS atr_percent,
  CASE WHEN atr / close * 100 > 3 THEN 'HIGH VOLATILITY' WHEN atr / close * 100 < 1 THEN 'LOW VOLATILITY' ELSE 'NORMAL' END AS atr_signal,
  CASE WHEN stoch_k > 80 AND stoch_d > 80 THEN 'OVERBOUGHT (SELL)' WHEN stoch_k < 20 AND stoch_d < 20 THEN 'OVERSOLD (BUY)'
    WHEN stoch_k > stoch_d THEN 'BULLISH (BUY)' ELSE 'BEARISH (SELL)' END AS stoch_signal,
  CASE WHEN williams_r > -20 THEN 'OVERBOUGHT (SELL)' WHEN williams_r < -80 THEN 'OVERSOLD (BUY)' ELSE 'NEUTRAL' END AS williams_signal
  FROM filled),
voted AS (SELECT *,
  CAST(rsi_signal LIKE '%BUY%' AS BIGINT) + CAST(macd_text LIKE '%BUY%' AS BIGINT) + CAST(bb_signal LIKE '%BUY%' AS BIGINT)
    + CAST(stoch_signal LIKE '%BUY%' AS BIGINT) + CAST(williams_signal LIKE '%BUY%' AS BIGINT) AS buy_signals,
  CAST(rsi_signal LIKE '%SELL%' AS BIGINT) + CAST(macd_text LIKE '%SELL%' AS BIGINT) + CAST(bb_signal LIKE '%SELL%' AS BIGINT)
    + CAST(stoch_signal LIKE '%SELL%' AS BIGINT) + CAST(williams_signal LIKE '%SELL%' AS BIGINT) AS sell_signals FROM signals)"""
RECOMMEND = """CASE WHEN buy_signals >= 3 THEN 'STRONG BUY' WHEN buy_signals >= 2 THEN 'BUY' WHEN sell_signals >= 3 THEN 'STRONG SELL'
  WHEN sell_signals >= 2 THEN 'SELL' ELSE 'HOLD' END AS recommendation"""
TEXTS = ("rsi_signal", "macd_text", "bb_signal", "atr_signal", "stoch_signal", "williams_signal", "buy_signals", "sell_signals")


def _signals(last_only: bool):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        frame = latest_indicators(bindings.bars(spark, folder), SIX, fill=True) if last_only else indicators(bindings.series(spark, folder), SIX, fill=True)
        out = frame.withColumns(indicator_signals()).withColumns(recommendation())
        return out.select("instrument", F.expr(DAY), "close", fixed("atr_percent").alias("atr_percent"), *TEXTS, "recommendation")

    check = with_(
        *weekly(), *indicator_chain(), filled(SIX), SIGNAL_SQL,
        select=f"SELECT instrument, {day()} AS day, close, {r('atr_percent')} AS atr_percent, {', '.join(TEXTS)}, {RECOMMEND} FROM voted"
        + (" WHERE pos = n" if last_only else ""),
    )
    return build, check


register("latest_indicator_signals", *_signals(True))
register("indicator_signal_history", *_signals(False))

PERIODS = {"day": ("6mo", 6), "week": ("2y", 24), "month": ("5y", 60)}


def _timeframes(spark: SparkSession, folder: str) -> DataFrame:
    bars = bindings.grains(spark, folder)
    frames = {grain: in_period(bars[grain], period) for grain, (period, _) in PERIODS.items()}
    return timeframe_signals(frames)


TIMEFRAME_SQL = [
    PLACES,
    TICKS,
    *[bars(g, f"bars_{g}") for g in PERIODS],
    "bars AS ("
    + " UNION ALL ".join(
        f"SELECT instrument || '|{g}' AS instrument, sector, ts, open, high, low, close, volume FROM bars_{g} b"
        f" WHERE ts >= (SELECT max(ts) FROM bars_{g} m WHERE m.instrument = b.instrument) - INTERVAL {months} MONTH"
        for g, (_, months) in PERIODS.items()
    )
    + ")",
    *indicator_chain(),
    filled(("rsi", "macd", "macd_signal", "stoch_k", "sma_20", "sma_50", "bb_upper", "bb_lower")),
    """scored AS (SELECT *, split_part(instrument, '|', 1) AS name, split_part(instrument, '|', 2) AS grain,
  CASE WHEN rsi < 30 THEN 2 WHEN rsi < 40 THEN 1 ELSE 0 END + CASE WHEN macd > macd_signal THEN 1 ELSE 0 END
  + CASE WHEN stoch_k < 20 THEN 2 WHEN stoch_k < 30 THEN 1 ELSE 0 END
  + CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 2 WHEN close < sma_20 AND sma_20 < sma_50 THEN 0 WHEN close > sma_20 THEN 1 ELSE 0 END AS buy_score,
  CASE WHEN rsi > 70 THEN 2 WHEN rsi > 60 THEN 1 ELSE 0 END + CASE WHEN macd > macd_signal THEN 0 ELSE 1 END
  + CASE WHEN stoch_k > 80 THEN 2 WHEN stoch_k > 70 THEN 1 ELSE 0 END
  + CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 0 WHEN close < sma_20 AND sma_20 < sma_50 THEN 2
    WHEN close > sma_20 THEN 0 WHEN close < sma_20 THEN 1 ELSE 0 END AS sell_score
  FROM filled WHERE pos = n)""",
    f"""sided AS (SELECT *,
  CASE WHEN n < 30 THEN 'NEUTRAL' WHEN buy_score > sell_score THEN 'BUY' WHEN sell_score > buy_score THEN 'SELL' ELSE 'NEUTRAL' END AS signal,
  CASE WHEN n < 30 OR buy_score = sell_score THEN CAST(0 AS DOUBLE)
    ELSE {div('greatest(buy_score, sell_score)', 'buy_score + sell_score')} * 100 END AS confidence FROM scored)""",
]

register(
    "timeframe_signals",
    lambda spark, folder: _timeframes(spark, folder).select(
        "instrument", "grain", "buy_score", "sell_score", "signal", fixed("confidence", 1).alias("confidence"),
        *[fixed(x).alias(x) for x in ("price_vs_sma20", "price_vs_sma50", "bb_position")],
    ),
    with_(
        *TIMEFRAME_SQL,
        select=f"""SELECT name AS instrument, grain, CAST(buy_score AS BIGINT) AS buy_score, CAST(sell_score AS BIGINT) AS sell_score, signal,
  {r('confidence', 1)} AS confidence, {r(f"({div('close', 'sma_20')} - 1) * 100")} AS price_vs_sma20,
  {r(f"({div('close', 'sma_50')} - 1) * 100")} AS price_vs_sma50,
  {r(f"CASE WHEN bb_upper > bb_lower THEN {div('close - bb_lower', 'bb_upper - bb_lower')} ELSE CAST(0.5 AS DOUBLE) END")} AS bb_position FROM sided""",
    ),
)
register(
    "timeframe_blend",
    lambda spark, folder: blend(_timeframes(spark, folder)),
    with_(
        *TIMEFRAME_SQL,
        """counted AS (SELECT name AS instrument, count(*) FILTER (signal = 'BUY') AS buys, count(*) FILTER (signal = 'SELL') AS sells,
  sum(CASE grain WHEN 'day' THEN 40 WHEN 'week' THEN 35 ELSE 25 END * CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END) AS points
  FROM sided GROUP BY name)""",
        select=f"""SELECT instrument,
  CASE WHEN points > 20 THEN CASE WHEN buys = 3 THEN 'STRONG BUY' ELSE 'BUY' END
    WHEN points < -20 THEN CASE WHEN sells = 3 THEN 'STRONG SELL' ELSE 'SELL' END ELSE 'HOLD' END AS combined_signal,
  {r("CAST(greatest(buys, sells) AS DOUBLE) / 3 * 100", 1)} AS combined_confidence,
  buys || 'B/' || sells || 'S/' || (3 - buys - sells) || 'N' AS agreement FROM counted""",
    ),
)

register(
    "bars_in_period",
    lambda spark, folder: in_period(bindings.bars(spark, folder, "day"), "6mo").selectExpr("instrument", DAY, "close", "volume"),
    with_(
        PLACES, TICKS, bars("day"),
        select=f"SELECT instrument, {day()} AS day, close, volume FROM (SELECT *, max(ts) OVER (PARTITION BY instrument) AS last_ts FROM bars) WHERE ts >= last_ts - INTERVAL 6 MONTH",
    ),
)


def _widening(spark: SparkSession, folder: str) -> DataFrame:
    """As of the newest bar of all, 25 days on: instruments differ in the period that holds a bar."""
    daily = bindings.bars(spark, folder, "day")
    as_of = daily.agg(F.max("ts") + F.expr("INTERVAL 25 DAYS")).first()[0]
    return first_period_with_bars(daily, F.lit(as_of)).selectExpr("instrument", DAY, "close", "period")


register(
    "widening_period",
    _widening,
    with_(
        PLACES, TICKS, bars("day"),
        "newest AS (SELECT instrument, max(ts) AS m, (SELECT max(ts) FROM bars) + INTERVAL 25 DAY AS today FROM bars GROUP BY instrument)",
        """chosen AS (SELECT instrument, CASE WHEN m >= today - INTERVAL 1 MONTH THEN '1mo' WHEN m >= today - INTERVAL 3 MONTH THEN '3mo'
  WHEN m >= today - INTERVAL 6 MONTH THEN '6mo' WHEN m >= today - INTERVAL 12 MONTH THEN '1y' END AS period, today FROM newest)""",
        select=f"""SELECT instrument, {day()} AS day, close, period FROM bars JOIN chosen USING (instrument)
  WHERE ts >= today - CASE period WHEN '1mo' THEN INTERVAL 1 MONTH WHEN '3mo' THEN INTERVAL 3 MONTH WHEN '6mo' THEN INTERVAL 6 MONTH ELSE INTERVAL 12 MONTH END""",
    ),
)


def _starts() -> str:
    cells = []
    for name, days in RETURN_DAYS.items():
        start = "date_trunc('year', last_ts)" if days is None else f"last_ts - INTERVAL {days} DAY"
        cells.append(f"arg_min(close, ts) FILTER (ts >= {start}) AS \"_{name}\"")
    return ", ".join(cells)


register(
    "period_returns",
    lambda spark, folder: period_returns(bindings.bars(spark, folder, "day")),
    with_(
        PLACES, TICKS, bars("day"),
        f"""base AS (SELECT instrument, arg_max(close, ts) AS current_price, {_starts()}
  FROM (SELECT *, max(ts) OVER (PARTITION BY instrument) AS last_ts FROM bars) GROUP BY instrument)""",
        select="SELECT instrument, current_price, "
        + ", ".join(r(f'(current_price - "_{n}") / "_{n}" * 100', 2) + f' AS "{n}"' for n in RETURN_DAYS)
        + " FROM base",
    ),
)

QUOTES_SQL = """quotes AS (SELECT instrument, arg_max(close, ts) AS current_price, coalesce(arg_max(prev, ts), 0) AS previous_close
  FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY ts) AS prev FROM bars) GROUP BY instrument)"""
CHANGE = "CASE WHEN previous_close > 0 THEN current_price - previous_close ELSE 0 END"
CHANGE_PERCENT = "CASE WHEN previous_close > 0 THEN (current_price - previous_close) / previous_close * 100 ELSE 0 END"
register(
    "latest_quotes",
    lambda spark, folder: quotes(bindings.bars(spark, folder, "day")).selectExpr(
        "instrument", "current_price", "previous_close", f"{fixed_text('change')} AS change", f"{fixed_text('change_percent')} AS change_percent", "currency"
    ),
    with_(
        PLACES, TICKS, bars("day"), QUOTES_SQL,
        select=f"SELECT instrument, current_price, previous_close, {r(CHANGE)} AS change, {r(CHANGE_PERCENT)} AS change_percent, 'USD' AS currency FROM quotes",
    ),
)
register(
    "chart_extents",
    lambda spark, folder: chart_extents(bindings.bars(spark, folder, "day")).selectExpr(
        "instrument", f"{fixed_text('y_min')} AS y_min", f"{fixed_text('y_max')} AS y_max", "volume_max"
    ),
    with_(
        PLACES, TICKS, bars("day"),
        select=f"SELECT instrument, {r('min(low) * CAST(0.99 AS DOUBLE)')} AS y_min, {r('max(high) * CAST(1.01 AS DOUBLE)')} AS y_max, max(volume) AS volume_max FROM bars GROUP BY instrument",
    ),
)

register(
    "model_votes_of_discounts",
    lambda spark, folder: bindings.table(spark, folder, "lineitem")
    .groupBy((F.col("l_discount") * 10).alias("score"))
    .agg(F.count("*").alias("rows"))
    .select(fixed("score", 4).alias("score"), "rows", model_vote(F.col("score")).alias("vote")),
    f"""SELECT {r('score', 4)} AS score, rows, CASE WHEN score > CAST(0.55 AS DOUBLE) THEN 'UP' WHEN score < CAST(0.45 AS DOUBLE) THEN 'DOWN' ELSE 'NEUTRAL' END AS vote
FROM (SELECT l_discount * 10 AS score, count(*) AS rows FROM lineitem GROUP BY 1)""",
)
register(
    "legacy_signal_direction",
    lambda spark, folder: bindings.table(spark, folder, "orders").select(
        "o_orderkey",
        legacy_direction(F.concat(F.when(F.col("o_orderstatus") == "F", "strong buy ").when(F.col("o_orderstatus") == "O", "sell ").otherwise("hold "), "o_orderpriority")).alias("direction"),
    ),
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'UP' WHEN 'O' THEN 'DOWN' ELSE 'UNCERTAIN' END AS direction FROM orders""",
)
