"""SQL building blocks for the checking queries: the bindings and indicators of the library as common table expressions."""

from __future__ import annotations

# Stated here once more, so that the checks do not rest on the library: upper bound, lower bound, divisor of the length.
SIZES = {
    "sma_20": (20, 5, 3),
    "sma_50": (50, 10, 2),
    "ema_12": (12, 3, 4),
    "ema_26": (26, 5, 2),
    "rsi": (14, 3, 4),
    "macd_signal": (9, 2, 5),
    "bollinger": (20, 5, 3),
    "atr": (14, 3, 4),
    "stochastic": (14, 3, 4),
    "stochastic_d": (3, 1, 8),
    "mfi": (14, 5, 3),
    "cci": (20, 5, 3),
    "adx": (14, 3, 4),
    "roc_5": (5, 2, 5),
    "roc_10": (10, 3, 3),
    "roc_20": (20, 5, 2),
    "ewma": (20, 5, 3),
}


def r(x: str, dp: int = 6) -> str:
    """Same double operations as `barlake.functions.numeric.fixed`."""
    scale = f"CAST(1e{dp} AS DOUBLE)"
    return f"(floor(({x}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def day(ts: str = "ts") -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


PLACES = """places AS (
  SELECT n_nationkey AS place, n_name AS instrument, r_name AS sector
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

PRICE = """CAST(CAST(round(p_retailprice * 10) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * 10 AS DOUBLE)
    / CAST(10000 AS DOUBLE)"""

TICKS = f"""ticks AS (
  SELECT instrument, sector, CAST(l_shipdate AS TIMESTAMP) AS ts, {PRICE} AS price, l_quantity AS volume,
    l_orderkey, l_linenumber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = place
  JOIN part ON l_partkey = p_partkey)"""


def bars(grain: str = "week", name: str = "bars") -> str:
    key = "ts, l_orderkey, l_linenumber, price"
    return f"""{name} AS (
  SELECT instrument, sector, CAST(date_trunc('{grain}', ts) AS TIMESTAMP) AS ts, first(price ORDER BY {key}) AS open,
    max(price) AS high, min(price) AS low, last(price ORDER BY {key}) AS close, CAST(sum(volume) AS DOUBLE) AS volume
  FROM ticks GROUP BY instrument, sector, date_trunc('{grain}', ts))"""


def weekly() -> list[str]:
    return [PLACES, TICKS, bars("week")]


def indexed(source: str = "bars", name: str = "ix") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS pos, count(*) OVER (PARTITION BY instrument) AS n
  FROM {source})"""


def size(name: str) -> str:
    upper, lower, divisor = SIZES[name]
    return f"least({upper}, greatest({lower}, n // {divisor}))"


def roll(aggregate: str, x: str, width: str) -> str:
    frame = f"(PARTITION BY instrument ORDER BY pos ROWS BETWEEN {width} - 1 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {width} THEN {aggregate}({x}) OVER {frame} END"


def lag(x: str, k: str = "1") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY instrument ORDER BY pos)"


def indicator_chain(source: str = "bars") -> list[str]:
    """ix -> i1 .. i5, then `ind` with every indicator, unfilled."""
    decay = lambda span: f"(CAST(1 AS DOUBLE) - CAST(2 AS DOUBLE) / ({size(span)} + 1))"
    return [
        indexed(source),
        f"""i1 AS (SELECT *, {lag('close')} AS prev_close, {lag('high')} AS prev_high, {lag('low')} AS prev_low,
  {lag('volume')} AS prev_volume, {lag('close', '5')} AS close_5,
  {lag('close', size('roc_5'))} AS close_roc_5, {lag('close', size('roc_10'))} AS close_roc_10,
  {lag('close', size('roc_20'))} AS close_roc_20,
  {roll('avg', 'close', size('sma_20'))} AS sma_20, {roll('avg', 'close', size('sma_50'))} AS sma_50,
  {roll('avg', 'close', size('bollinger'))} AS bb_middle, {roll('stddev_samp', 'close', size('bollinger'))} AS bb_std,
  {roll('min', 'low', size('stochastic'))} AS low_14, {roll('max', 'high', size('stochastic'))} AS high_14 FROM ix)""",
        f"""i2 AS (SELECT *,
  CASE WHEN close > prev_close THEN close - prev_close ELSE 0 END AS gain,
  CASE WHEN close < prev_close THEN prev_close - close ELSE 0 END AS loss,
  greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS true_range,
  CASE WHEN high - prev_high > prev_low - low AND high > prev_high THEN high - prev_high ELSE 0 END AS plus_dm,
  (high + low + close) / CAST(3 AS DOUBLE) AS typical,
  (prev_high + prev_low + prev_close) / CAST(3 AS DOUBLE) AS prev_typical,
  ({div('close', 'prev_close')} - 1) * 100 AS price_change, ({div('volume', 'prev_volume')} - 1) * 100 AS volume_change
  FROM i1)""",
        """i3 AS (SELECT *,
  CASE WHEN prev_low - low > plus_dm AND prev_low > low THEN prev_low - low ELSE 0 END AS minus_dm,
  CASE WHEN typical > prev_typical THEN typical * volume ELSE 0 END AS flow_in,
  CASE WHEN typical < prev_typical THEN typical * volume ELSE 0 END AS flow_out,
  sum(coalesce(sign(close - prev_close) * volume, 0)) OVER (PARTITION BY instrument ORDER BY pos) AS obv,
  sum(volume * (high + low + close) / CAST(3 AS DOUBLE)) OVER (PARTITION BY instrument ORDER BY pos)
    / nullif(sum(volume) OVER (PARTITION BY instrument ORDER BY pos), 0) AS vwap
  FROM i2)""",
        f"""rec AS (
  SELECT instrument, pos, close AS ema_12, close AS ema_26, CAST(0 AS DOUBLE) AS macd_signal,
    CAST(0 AS DOUBLE) AS s0, CAST(0 AS DOUBLE) AS s1, CAST(0 AS DOUBLE) AS s2, CAST(0 AS DOUBLE) AS q, 0 AS seen
  FROM i3 WHERE pos = 1
  UNION ALL
  SELECT x.instrument, x.pos,
    {decay('ema_12')} * p.ema_12 + (1 - {decay('ema_12')}) * x.close,
    {decay('ema_26')} * p.ema_26 + (1 - {decay('ema_26')}) * x.close,
    {decay('macd_signal')} * p.macd_signal + (1 - {decay('macd_signal')}) * (
      ({decay('ema_12')} * p.ema_12 + (1 - {decay('ema_12')}) * x.close)
      - ({decay('ema_26')} * p.ema_26 + (1 - {decay('ema_26')}) * x.close)),
    {decay('ewma')} * p.s0 + CASE WHEN x.price_change IS NULL THEN 0 ELSE 1 END,
    {decay('ewma')} * p.s1 + coalesce(x.price_change, 0),
    {decay('ewma')} * p.s2 + coalesce(x.price_change * x.price_change, 0),
    {decay('ewma')} * {decay('ewma')} * p.q + CASE WHEN x.price_change IS NULL THEN 0 ELSE 1 END,
    p.seen + CASE WHEN x.price_change IS NULL THEN 0 ELSE 1 END
  FROM rec p JOIN i3 x ON x.instrument = p.instrument AND x.pos = p.pos + 1)""",
        f"""i4 AS (SELECT i3.*, rec.ema_12, rec.ema_26, rec.macd_signal, rec.ema_12 - rec.ema_26 AS macd,
  CASE WHEN seen >= 2 THEN sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * (s0 * s0 / (s0 * s0 - q)), 0)) * sqrt(CAST(252 AS DOUBLE)) END
    AS ewma_volatility,
  {roll('avg', 'gain', size('rsi'))} AS avg_gain, {roll('avg', 'loss', size('rsi'))} AS avg_loss,
  {roll('avg', 'true_range', size('atr'))} AS atr, {roll('avg', 'true_range', size('adx'))} AS adx_range,
  {roll('avg', 'plus_dm', size('adx'))} AS avg_plus_dm, {roll('avg', 'minus_dm', size('adx'))} AS avg_minus_dm,
  {roll('sum', 'flow_in', size('mfi'))} AS flow_in_sum, {roll('sum', 'flow_out', size('mfi'))} AS flow_out_sum,
  {roll('avg', 'typical', size('cci'))} AS typical_mean, {roll('list', 'typical', size('cci'))} AS typical_list
  FROM i3 JOIN rec USING (instrument, pos))""",
        f"""i5 AS (SELECT *,
  CASE WHEN avg_loss = 0 AND avg_gain > 0 THEN 100 ELSE 100 - 100 / (1 + {div('avg_gain', 'avg_loss')}) END AS rsi,
  CASE WHEN flow_out_sum = 0 AND flow_in_sum > 0 THEN 100 ELSE 100 - 100 / (1 + {div('flow_in_sum', 'flow_out_sum')}) END AS mfi,
  {div('close - low_14', 'high_14 - low_14')} * 100 AS stoch_k, {div('high_14 - close', 'high_14 - low_14')} * -100 AS williams_r,
  {div('typical - typical_mean', "list_avg(list_transform(typical_list, lambda v: abs(v - typical_mean))) * CAST(0.015 AS DOUBLE)")} AS cci,
  {div(f"abs({div('avg_plus_dm', 'adx_range')} * 100 - {div('avg_minus_dm', 'adx_range')} * 100)",
       f"{div('avg_plus_dm', 'adx_range')} * 100 + {div('avg_minus_dm', 'adx_range')} * 100")} * 100 AS dx
  FROM i4)""",
        f"""ind AS (SELECT *, {roll('avg', 'stoch_k', size('stochastic_d'))} AS stoch_d, {roll('avg', 'dx', size('adx'))} AS adx,
  macd - macd_signal AS macd_histogram, bb_middle + bb_std * 2 AS bb_upper, bb_middle - bb_std * 2 AS bb_lower,
  high - low AS hl_range, close - open AS oc_range,
  coalesce(CAST(high > prev_high AS INT), 0) AS higher_high, coalesce(CAST(low < prev_low AS INT), 0) AS lower_low,
  coalesce(CAST(low > prev_low AS INT), 0) AS higher_low, coalesce(CAST(high < prev_high AS INT), 0) AS lower_high,
  {div('atr', 'close')} * 100 AS volatility_ratio,
  {div('(bb_middle + bb_std * 2) - (bb_middle - bb_std * 2)', 'bb_middle')} AS bb_width,
  ({div('close', 'close_5')} - 1) - ({div('rsi', lag('rsi', '5'))} - 1) AS rsi_divergence,
  ({div('close', 'close_roc_5')} - 1) * 100 AS roc_5, ({div('close', 'close_roc_10')} - 1) * 100 AS roc_10,
  ({div('close', 'close_roc_20')} - 1) * 100 AS roc_20 FROM i5)""",
    ]


def filled(columns: list[str] | tuple[str, ...], source: str = "ind", name: str = "filled") -> str:
    forward = "(PARTITION BY instrument ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    back = "(PARTITION BY instrument ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    cells = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER {forward}, first_value({c} IGNORE NULLS) OVER {back}) AS {c}" for c in columns
    )
    return f"{name} AS (SELECT instrument, sector, ts, pos, n, open, high, low, close, volume, {cells} FROM {source})"
