"""Technical indicators of all instruments at once.

The indicators are a list of steps, each one a set of SQL expressions over the columns before it; only the steps that
the wanted columns need enter the plan. Every rolling value is null until its window holds enough values. Window sizes
are constants for series of 100 bars and more; shorter series use sizes that shrink with their length, on arrays of at
most 50 rows. One shuffle on (instrument, block) and one sort serve all windows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.series import BLOCK_ROWS, block_carries, fading_memory, fill_gaps, index_rows, last_rows, with_blocks
from barlake.session import materialise

KEYS = ("instrument",)
SHORT_SERIES = 100
LONGEST_WINDOW = 50
HALO = fading_memory(26)
#: Rows from the end in which a last known value is first looked for, and how much longer each further stretch is.
STRETCH, LONGER = 256, 16
STRIDE = 2048

# Window sizes as (upper bound, lower bound, divisor of the series length).
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

# (kind of step, {column: definition}). "rolling": (aggregate, input, size name or constant); "fading": (span name,
# input expression, power of the decay); "each": an expression of the same row.
STEPS: list[tuple[str, dict]] = [
    (
        "rolling",
        {
            "prev_close": ("lag", "close", 1),
            "prev_high": ("lag", "high", 1),
            "prev_low": ("lag", "low", 1),
            "prev_volume": ("lag", "volume", 1),
            "close_5": ("lag", "close", 5),
            "close_roc_5": ("lag", "close", "roc_5"),
            "close_roc_10": ("lag", "close", "roc_10"),
            "close_roc_20": ("lag", "close", "roc_20"),
            "sma_20": ("mean", "close", "sma_20"),
            "sma_50": ("mean", "close", "sma_50"),
            "bb_middle": ("mean", "close", "bollinger"),
            "bb_std": ("std", "close", "bollinger"),
            "low_14": ("min", "low", "stochastic"),
            "high_14": ("max", "high", "stochastic"),
        },
    ),
    (
        "each",
        {
            "gain": "if(close > prev_close, close - prev_close, 0D)",
            "loss": "if(close < prev_close, prev_close - close, 0D)",
            "true_range": "greatest(high - low, abs(high - prev_close), abs(low - prev_close))",
            "plus_dm": "if(high - prev_high > prev_low - low and high > prev_high, high - prev_high, 0D)",
            "typical": "(high + low + close) / 3D",
            "prev_typical": "(prev_high + prev_low + prev_close) / 3D",
            "price_change": "(try_divide(close, prev_close) - 1D) * 100D",
            "volume_change": "(try_divide(volume, prev_volume) - 1D) * 100D",
        },
    ),
    (
        "each",
        {
            "minus_dm": "if(prev_low - low > plus_dm and prev_low > low, prev_low - low, 0D)",
            "flow_in": "if(typical > prev_typical, typical * volume, 0D)",
            "flow_out": "if(typical < prev_typical, typical * volume, 0D)",
        },
    ),
    (
        "fading",
        {
            "ema_12": ("ema_12", "if(is_first, close, (1D - {r}) * close)", 1),
            "ema_26": ("ema_26", "if(is_first, close, (1D - {r}) * close)", 1),
            "ewm_w": ("ewma", "if(price_change is null, null, 1D)", 1),
            "ewm_x": ("ewma", "price_change", 1),
            "ewm_xx": ("ewma", "price_change * price_change", 1),
            "ewm_ww": ("ewma", "if(price_change is null, null, 1D)", 2),
        },
    ),
    ("each", {"macd": "ema_12 - ema_26"}),
    ("fading", {"macd_signal": ("macd_signal", "if(is_first, macd, (1D - {r}) * macd)", 1)}),
    (
        "rolling",
        {
            "avg_gain": ("mean", "gain", "rsi"),
            "avg_loss": ("mean", "loss", "rsi"),
            "atr": ("mean", "true_range", "atr"),
            "adx_range": ("mean", "true_range", "adx"),
            "avg_plus_dm": ("mean", "plus_dm", "adx"),
            "avg_minus_dm": ("mean", "minus_dm", "adx"),
            "flow_in_sum": ("sum", "flow_in", "mfi"),
            "flow_out_sum": ("sum", "flow_out", "mfi"),
            "typical_mean": ("mean", "typical", "cci"),
            "typical_list": ("list", "typical", "cci"),
            "changes_seen": ("seen", "price_change", 0),
        },
    ),
    (
        "each",
        {
            "typical_mad": (
                "aggregate(transform(typical_list, v -> abs(v - typical_mean)), 0D, (t, v) -> t + v) / size(typical_list)"
            ),
            "plus_di": "try_divide(avg_plus_dm, adx_range) * 100D",
            "minus_di": "try_divide(avg_minus_dm, adx_range) * 100D",
            "ewm_mean": "try_divide(ewm_x, ewm_w)",
        },
    ),
    (
        "each",
        {
            # 100 where nothing went down, null where nothing moved
            "rsi": "if(avg_loss = 0D and avg_gain > 0D, 100D, 100D - 100D / (1D + try_divide(avg_gain, avg_loss)))",
            "mfi": "if(flow_out_sum = 0D and flow_in_sum > 0D, 100D, 100D - 100D / (1D + try_divide(flow_in_sum, flow_out_sum)))",
            "stoch_k": "try_divide(close - low_14, high_14 - low_14) * 100D",
            "williams_r": "try_divide(high_14 - close, high_14 - low_14) * -100D",
            "cci": "try_divide(typical - typical_mean, typical_mad * 0.015D)",
            "dx": "try_divide(abs(plus_di - minus_di), plus_di + minus_di) * 100D",
            "ewma_volatility": (
                "if(changes_seen >= 2, sqrt(greatest((try_divide(ewm_xx, ewm_w) - ewm_mean * ewm_mean)"
                " * try_divide(ewm_w * ewm_w, ewm_w * ewm_w - ewm_ww), 0D)) * sqrt(252D), null)"
            ),
        },
    ),
    (
        "rolling",
        {
            "stoch_d": ("mean", "stoch_k", "stochastic_d"),
            "adx": ("mean", "dx", "adx"),
            "rsi_5": ("lag", "rsi", 5),
        },
    ),
    (
        "each",
        {
            "macd_histogram": "macd - macd_signal",
            "bb_upper": "bb_middle + bb_std * 2D",
            "bb_lower": "bb_middle - bb_std * 2D",
            "hl_range": "high - low",
            "oc_range": "close - open",
            "higher_high": "coalesce(int(high > prev_high), 0)",
            "lower_low": "coalesce(int(low < prev_low), 0)",
            "higher_low": "coalesce(int(low > prev_low), 0)",
            "lower_high": "coalesce(int(high < prev_high), 0)",
            "volatility_ratio": "try_divide(atr, close) * 100D",
            "rsi_divergence": "(try_divide(close, close_5) - 1D) - (try_divide(rsi, rsi_5) - 1D)",
            "roc_5": "(try_divide(close, close_roc_5) - 1D) * 100D",
            "roc_10": "(try_divide(close, close_roc_10) - 1D) * 100D",
            "roc_20": "(try_divide(close, close_roc_20) - 1D) * 100D",
        },
    ),
    ("each", {"bb_width": "try_divide(bb_upper - bb_lower, bb_middle)"}),
    # running sums from the start of the series: the part inside the block plus the carry of the blocks before it
    (
        "total",
        {
            "obv": "coalesce(signum(close - prev_close) * volume, 0D)",
            "turnover": "volume * (high + low + close) / 3D",
            "traded": "volume",
        },
    ),
    ("each", {"vwap": "try_divide(turnover, traded)"}),
]

ROLLING = (
    "sma_20", "sma_50", "ema_12", "ema_26", "rsi", "macd", "macd_signal", "macd_histogram", "bb_middle", "bb_upper",
    "bb_lower", "volume_change", "price_change", "hl_range", "oc_range", "atr", "stoch_k", "stoch_d", "williams_r",
    "mfi", "cci", "adx", "higher_high", "lower_low", "higher_low", "lower_high", "volatility_ratio", "bb_width",
    "rsi_divergence", "roc_5", "roc_10", "roc_20", "ewma_volatility",
)
CUMULATIVE = ("obv", "vwap")
ALL_INDICATORS = (*ROLLING, *CUMULATIVE)


def _needed(columns: Sequence[str]) -> list[tuple[str, dict]]:
    """The steps with only those definitions that the wanted columns rest on."""
    wanted = set(columns)
    kept = []
    for kind, definitions in reversed(STEPS):
        used = {name: d for name, d in definitions.items() if name in wanted}
        for d in used.values():
            text = d if isinstance(d, str) else d[1]
            wanted.update(re.findall(r"[a-z_][a-z_0-9]*", text))
        if used:
            kept.append((kind, used))
    return kept[::-1]


def _order(by: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(by)}, block ORDER BY sub, pos"


def _fixed(step: dict, by: Sequence[str]) -> list[str]:
    """Rolling values with literal frames inside a block."""
    out = []
    for name, (kind, x, size) in step.items():
        size = SIZES[size][0] if isinstance(size, str) else size
        frame = f"({_order(by)} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
        value = {
            "lag": f"lag({x}, {size}) OVER ({_order(by)})",
            "seen": f"count({x}) OVER ({_order(by)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            "mean": f"avg({x}) OVER {frame}",
            "std": f"stddev_samp({x}) OVER {frame}",
            "sum": f"sum({x}) OVER {frame}",
            "min": f"min({x}) OVER {frame}",
            "max": f"max({x}) OVER {frame}",
            "list": f"collect_list({x}) OVER {frame}",
        }[kind]
        out.append(f"{value} AS {name}" if kind in ("lag", "seen") else f"CASE WHEN count({x}) OVER {frame} = {size} THEN {value} END AS {name}")
    return out


def _size(name: str) -> str:
    upper, lower, divisor = SIZES[name]
    return f"int(least({upper}, greatest({lower}, n div {divisor})))"


def _adaptive(step: dict, by: Sequence[str]) -> tuple[str, list[str]]:
    """Rolling values whose size depends on the series: slices of an array of the last 50 rows."""
    inputs = sorted({x for kind, x, _ in step.values() if kind != "seen"})
    past = (
        f"collect_list(struct({', '.join(inputs)})) OVER ({_order(by)} ROWS BETWEEN {LONGEST_WINDOW - 1} PRECEDING"
        " AND CURRENT ROW) AS _past"
    )
    out = []
    for name, (kind, x, size) in step.items():
        if kind == "seen":
            out += _fixed({name: (kind, x, size)}, by)
            continue
        width = _size(size) if isinstance(size, str) else str(size)
        if kind == "lag":
            out.append(f"get(_past.{x}, size(_past) - 1 - {width}) AS {name}")
            continue
        values = f"filter(slice(_past.{x}, greatest(size(_past) - {width} + 1, 1), {width}), v -> v is not null)"
        mean = f"(aggregate({values}, 0D, (t, v) -> t + v) / {width})"
        value = {
            "mean": mean,
            "sum": f"aggregate({values}, 0D, (t, v) -> t + v)",
            "min": f"array_min({values})",
            "max": f"array_max({values})",
            "list": values,
            "std": f"sqrt(aggregate({values}, 0D, (t, v) -> t + (v - {mean}) * (v - {mean})) / ({width} - 1))",
        }[kind]
        out.append(f"CASE WHEN size({values}) = {width} THEN {value} END AS {name}")
    return past, out


def _fading(df: DataFrame, step: dict, by: Sequence[str], short: bool, stride: int) -> DataFrame:
    """For each column the sum over all rows so far of r^age * input.

    Written as r^k * sum(input * r^-k) with k counted inside a stride, so that the powers stay finite; the sum at the
    end of the previous stride is added with its weight. Older strides have no weight left in a double.
    """
    k = f"((pos - 1) % {stride})"
    inside = f"(PARTITION BY {', '.join(by)}, block, sub ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"({_order(by)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    local, whole = [], []
    for name, (span, x, power) in step.items():
        if isinstance(span, str):
            length = f"double({_size(span)})" if short else f"{SIZES[span][0]}D"
        else:
            length = f"{span}D"
        r = f"(1D - 2D / ({length} + 1D))"
        r = f"({r} * {r})" if power == 2 else r
        local.append(f"power({r}, {k}) * sum({x.format(r=r)} * power({r}, -{k})) OVER {inside} AS _{name}")
        whole.append(
            f"_{name} + coalesce(power({r}, {k} + 1) * last(if({k} = {stride - 1}, _{name}, null), true) OVER {before}, 0D) AS {name}"
        )
    df = df.selectExpr("*", *local)
    if short:
        return df.withColumnsRenamed({f"_{name}": name for name in step})
    return df.selectExpr("*", *whole).drop(*[f"_{name}" for name in step])


def _apply(df: DataFrame, steps: list[tuple[str, dict]], by: Sequence[str], short: bool) -> DataFrame:
    for kind, step in steps:
        if kind == "each":
            df = df.selectExpr("*", *[f"{x} AS {name}" for name, x in step.items()])
        elif kind == "fading":
            df = _fading(df, step, by, short, STRIDE)
        elif kind == "total":
            rows = df.filter("not is_halo")
            if not short:
                carries = block_carries(rows, by, {name: ("sum", F.expr(x)) for name, x in step.items()})
                df = df.join(carries, [*by, "block"], "left")
            inside = f"({_order(by)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            here = {name: f"sum(if(is_halo, 0D, {x})) OVER {inside}" for name, x in step.items()}
            carry = {name: "" if short else f" + coalesce(_carry_{name}, 0D)" for name in step}
            df = df.selectExpr("*", *[f"{here[name]}{carry[name]} AS {name}" for name in step])
        elif short:
            past, columns = _adaptive(step, by)
            df = df.selectExpr("*", past).selectExpr("*", *columns).drop("_past")
        else:
            df = df.selectExpr("*", *_fixed(step, by))
    return df


def indicators(
    bars: DataFrame,
    columns: Sequence[str] = ALL_INDICATORS,
    by: Sequence[str] = KEYS,
    block_rows: int = BLOCK_ROWS,
    adaptive: bool = True,
    fill: bool = False,
) -> DataFrame:
    """Bars plus the wanted indicator columns (and `pos`, `n`).

    `fill` fills the gaps of each column forward and its warm-up rows backward. `adaptive=False` leaves series of less
    than 100 bars on the full window sizes.
    """
    by = tuple(by)
    indexed = bars if {"pos", "n"} <= set(bars.columns) else index_rows(bars, by)
    keep = [*indexed.columns, *columns]
    block_rows, halo = max(block_rows, HALO), HALO  # a block is as long as its memory of the one before, at least
    start = f"if(block = 0, 1, block * {block_rows} + 1 - {halo})"
    placed = with_blocks(indexed, block_rows, halo).selectExpr("*", f"floor((pos - 1) / {STRIDE}) AS sub", f"pos = {start} AS is_first")
    steps = _needed(columns)
    whole = placed.filter(F.col("n") >= SHORT_SERIES) if adaptive else placed
    out = _apply(whole, steps, by, short=False).filter("not is_halo").select(*keep, "block")
    if adaptive:
        short = _apply(placed.filter(F.col("n") < SHORT_SERIES), steps, by, short=True)
        out = out.unionByName(short.select(*keep, "block"))
    if fill:  # the gaps are looked at twice, by block and by row: the windows behind them run once
        out = fill_gaps(materialise(out), by, list(columns))
    return out.drop("block")


def exponential_average(
    df: DataFrame, column: str, span: int, name: str, by: Sequence[str] = KEYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Recursive exponential average of one column for any span > 1, on rows with `pos` and `n`."""
    r = 1.0 - 2.0 / (span + 1.0)
    stride = max(1, min(1 << 20, int(600.0 / -math.log(r))))
    halo = fading_memory(span)
    rows = max(block_rows, 4 * halo)
    start = f"if(block = 0, 1, block * {rows} + 1 - {halo})"
    placed = with_blocks(df, rows, halo).selectExpr("*", f"floor((pos - 1) / {stride}) AS sub", f"pos = {start} AS is_first")
    placed = placed.selectExpr("*", f"count({column}) OVER ({_order(by)}) AS _seen")
    step = {name: (span, f"if(is_first, {column}, (1D - {{r}}) * {column})", 1)}
    return _fading(placed, step, by, False, stride).filter("not is_halo").drop("block", "is_halo", "sub", "is_first", "_seen")


def latest(frame: DataFrame) -> DataFrame:
    """Last row of each series, on a frame with `pos` and `n`."""
    return frame.filter(F.col("pos") == F.col("n"))


def _between(bars: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], adaptive: bool, after: int, rows: int) -> DataFrame:
    """Indicators of the rows that have at least `after` and under `rows` rows behind them, from these rows and the memory before them."""
    tail = last_rows(bars, by, rows + HALO, order).filter(F.col("pos") <= F.col("n") - F.lit(after))
    first = F.greatest(F.col("n") - F.lit(rows + HALO), F.lit(0))
    own = tail.select("*", F.col("pos").alias("_pos"), F.col("n").alias("_n"), first.alias("_first"))
    own = own.withColumns({"pos": F.col("_pos") - F.col("_first"), "n": F.col("_n") - F.lit(after) - F.col("_first")})
    # a series that reaches into a later stretch is a long one, however little of it is left there
    frame = indicators(own.drop("_first"), columns, by, adaptive=adaptive and not after)
    return frame.filter(F.col("_pos") > F.col("_n") - F.lit(rows)).drop("pos", "n").withColumnsRenamed({"_pos": "pos", "_n": "n"})


def latest_indicators(
    bars: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = KEYS,
    adaptive: bool = True,
    fill: bool = False,
    order: Sequence[str] = ("ts",),
    stretch: int = STRETCH,
) -> DataFrame:
    """`latest(indicators(...))` from the last rows of each series: the memory of the windows, and no more.

    With `fill`, a value that the last row lacks is looked for in the last `stretch` rows, then, for the series that still lack
    one, in a stretch 16 times as long before them, and so on to their first row; a value that no row has stays null. Running
    totals (`CUMULATIVE`) rest on all rows and are taken from there. A series without rows gives none.
    """
    by = tuple(by)
    if set(columns) & set(CUMULATIVE):
        return latest(indicators(bars if {"pos", "n"} <= set(bars.columns) else index_rows(bars, by, order), columns, by, adaptive=adaptive, fill=fill))
    if not fill:
        return latest(_between(bars, columns, by, order, adaptive, 0, 1))

    def known(frame: DataFrame, others: Sequence[str]) -> DataFrame:
        present = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in columns]
        return frame.groupBy(*by).agg(*[F.max_by(c, "pos").alias(c) for c in others], *present)

    others = [c for c in dict.fromkeys([*bars.columns, "pos", "n"]) if c not in by]
    out = materialise(known(_between(bars, columns, by, order, adaptive, 0, stretch), others))
    after, rows = stretch, stretch * LONGER
    gap = " OR ".join(f"{c} IS NULL" for c in columns)
    while not (lacking := out.filter(f"n > {after} AND ({gap})").select(*by)).isEmpty():
        before = known(_between(bars.join(lacking, list(by), "left_semi"), columns, by, order, adaptive, after, rows), ())
        before = before.withColumnsRenamed({c: f"_before_{c}" for c in columns})
        found = {c: F.coalesce(F.col(c), F.col(f"_before_{c}")) for c in columns}
        out = materialise(out.join(before, list(by), "left").withColumns(found).drop(*before.columns[len(by):]))
        after, rows = rows, rows * LONGER
    return out
