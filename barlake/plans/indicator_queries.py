"""Bars and indicators over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.functions.numeric import fixed_text
from barlake.operators.indicators import ALL_INDICATORS, indicators
from barlake.operators.resample import coarser_bars, stack_grains
from barlake.plans.registry import register
from barlake.plans.sqltext import PLACES, TICKS, bars, day, filled, indicator_chain, r, with_
from barlake.sources import bindings

DAY = "date_format(ts, 'yyyy-MM-dd') AS day"
FLAGS = ("higher_high", "lower_low", "higher_low", "lower_high")
OHLCV = ("open", "high", "low", "close", "volume")


def shown(columns) -> list:
    return [f"bigint({c}) AS {c}" if c in FLAGS else f"{fixed_text(c)} AS {c}" for c in columns]


def shown_sql(columns) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in FLAGS else f"{r(c)} AS {c}" for c in columns)


def indicator_query(name: str, columns: tuple[str, ...], grain: str = "week", fill: bool = False) -> None:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        frame = indicators(bindings.series(spark, folder, grain), columns, fill=fill)
        return frame.selectExpr("instrument", DAY, *shown(columns))

    chain = [PLACES, TICKS, bars(grain), *indicator_chain()]
    source = "ind"
    if fill:
        chain.append(filled(columns))
        source = "filled"
    register(name, build, with_(*chain, select=f"SELECT instrument, {day()} AS day, {shown_sql(columns)} FROM {source}"))


def bar_query(name: str, grain: str) -> None:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return bindings.bars(spark, folder, grain).selectExpr("instrument", "sector", DAY, *OHLCV)

    register(name, build, with_(PLACES, TICKS, bars(grain), select=f"SELECT instrument, sector, {day()} AS day, open, high, low, close, volume FROM bars"))


for grain in ("day", "week", "month"):
    bar_query(f"bars_{grain}", grain)


def _coarser(spark: SparkSession, folder: str) -> DataFrame:
    return coarser_bars(bindings.bars(spark, folder, "day"), "month").selectExpr("instrument", DAY, *OHLCV)


register("bars_day_to_month", _coarser, with_(PLACES, TICKS, bars("month"), select=f"SELECT instrument, {day()} AS day, open, high, low, close, volume FROM bars"))


def _stacked(spark: SparkSession, folder: str) -> DataFrame:
    return stack_grains(bindings.grains(spark, folder)).selectExpr("grain", "instrument", DAY, "close", "volume")


register(
    "stacked_timeframes",
    _stacked,
    with_(
        PLACES,
        TICKS,
        *[bars(g, f"bars_{g}") for g in ("day", "week", "month")],
        select=" UNION ALL ".join(
            f"SELECT '{g}' AS grain, instrument, {day()} AS day, close, volume FROM bars_{g}" for g in ("day", "week", "month")
        ),
    ),
)

indicator_query("sma", ("sma_20", "sma_50"))
indicator_query("ema", ("ema_12", "ema_26"))
indicator_query("rsi", ("rsi",))
indicator_query("macd", ("macd", "macd_signal", "macd_histogram"))
indicator_query("bollinger_bands", ("bb_middle", "bb_upper", "bb_lower"))
indicator_query("volume_and_price_change", ("volume_change", "price_change"))
indicator_query("bar_ranges", ("hl_range", "oc_range"))
indicator_query("average_true_range", ("atr",))
indicator_query("stochastic_oscillator", ("stoch_k", "stoch_d"))
indicator_query("williams_r", ("williams_r",))
indicator_query("on_balance_volume", ("obv",))
indicator_query("vwap", ("vwap",))
indicator_query("money_flow_index", ("mfi",))
indicator_query("commodity_channel_index", ("cci",))
indicator_query("average_directional_index", ("adx",))
indicator_query("price_pattern_flags", FLAGS)
indicator_query("volatility_ratios", ("volatility_ratio", "bb_width"))
indicator_query("rsi_divergence", ("rsi_divergence",))
indicator_query("rate_of_change", ("roc_5", "roc_10", "roc_20"))
indicator_query("ewma_volatility", ("ewma_volatility",))
indicator_query("filled_indicators", ALL_INDICATORS, fill=True)
indicator_query("adaptive_monthly_indicators", ALL_INDICATORS, "month", fill=True)
