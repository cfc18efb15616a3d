"""Trading ledger of signals in window form, and its risk figures.

Rules: a BUY when flat puts all capital C into C / price shares and pays the fee on top, so cash becomes -cost * C; the
next SELL returns shares * price * (1 - cost). One round trip multiplies capital by

    f = sell / buy * (1 - cost) - cost

The open position at the end is sold at the last price; that sale is in the totals but not in the equity curve.

A series may be long, so it is worked in blocks. A block is first summed up as if it started with capital 1, apart from
a position it inherits; a table with one row per block then gives the capital, entry price, last equity and peak with
which each block really starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.series import BLOCK_ROWS, FIRST, own_block, running

TRADING_DAYS = 252


def ledger(signals: DataFrame, by: Sequence[str], initial: float = 10000.0, cost: float = 0.001, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (by, pos, n, price, signal in 1/-1/0) -> the same rows with position, trade number, capital and equity."""
    by = list(by)
    keys = ", ".join(by)
    order = f"PARTITION BY {keys}, block ORDER BY pos"
    so_far = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    blocked = signals.withColumn("block", own_block(block_rows))
    wish = F.expr("if(signal <> 0, signal, null)")
    rows = running(blocked, by, {"_wish": ("last", wish)}, before={"_wish_before": "_wish"}).selectExpr(
        *signals.columns,
        "block",
        "coalesce(_wish = 1, false) AS holding",
        "signal = 1 AND coalesce(_wish_before, 0) <> 1 AS buy",
        "signal = -1 AND coalesce(_wish_before, 0) = 1 AS sell",
    )
    rows = rows.selectExpr("*", f"last(if(buy, price, null), true) OVER {so_far} AS _entry")
    rows = rows.selectExpr(
        "*",
        "_entry IS NULL AND holding AS _inherited",
        f"if(sell AND _entry IS NOT NULL, price / _entry * {1 - cost}D - {cost}D, 1D) AS _factor",
    )
    inside = Window.partitionBy(*by, "block").orderBy("pos")
    rows = rows.withColumns(
        {
            "_gain": F.product("_factor").over(inside.rowsBetween(FIRST, 0)),
            "_gain_before": F.coalesce(F.product("_factor").over(inside.rowsBetween(FIRST, -1)), F.lit(1.0)),
            "_buys": F.count_if("buy").over(inside.rowsBetween(FIRST, 0)),
        }
    ).selectExpr("*", f"CASE WHEN _entry IS NULL THEN 1D WHEN holding THEN _gain * (price / _entry - {cost}D) ELSE _gain END AS _relative")
    blocks = rows.groupBy(*by, "block").agg(
        F.expr("max(if(sell AND _entry IS NULL, price, null)) AS inherited_exit"),
        F.expr("max(if(_inherited, price, null)) AS inherited_high"),
        F.expr("min(if(_inherited, price, null)) AS inherited_low"),
        F.expr("max_by(price, if(_inherited, pos, null)) AS inherited_last"),
        F.expr("max(if(_inherited, null, _relative)) AS relative_high"),
        F.expr("min(if(_inherited, null, _relative)) AS relative_low"),
        F.expr("max_by(_relative, if(_inherited, null, pos)) AS relative_last"),
        F.expr("max_by(price, if(buy, pos, null)) AS last_entry"),
        F.product("_factor").alias("gain"),
        F.expr("count_if(buy) AS buys"),
    )
    earlier = f"(PARTITION BY {keys} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = blocks.selectExpr(
        "*",
        f"last(last_entry, true) OVER {earlier} AS entry_in",
        f"coalesce(sum(buys) OVER {earlier}, 0) AS buys_in",
    ).selectExpr("*", f"coalesce(inherited_exit / entry_in * {1 - cost}D - {cost}D, 1D) AS inherited_factor")
    past = Window.partitionBy(*by).orderBy("block").rowsBetween(FIRST, -1)
    grown = F.coalesce(F.product(F.col("inherited_factor") * F.col("gain")).over(past), F.lit(1.0))
    blocks = blocks.withColumn("capital_in", F.lit(initial) * grown)
    blocks = blocks.selectExpr(
        *by, "block", "entry_in", "buys_in", "inherited_factor", "capital_in",
        # both extremes, because a capital below zero turns them around
        f"""greatest(capital_in * (inherited_high / entry_in - {cost}D), capital_in * (inherited_low / entry_in - {cost}D),
            capital_in * inherited_factor * relative_high, capital_in * inherited_factor * relative_low) AS high""",
        f"coalesce(capital_in * inherited_factor * relative_last, capital_in * (inherited_last / entry_in - {cost}D)) AS last",
    ).selectExpr(
        *by, "block", "entry_in", "buys_in", "inherited_factor", "capital_in", f"max(high) OVER {earlier} AS peak_in", f"last(last) OVER {earlier} AS equity_in"
    )
    joined = rows.join(blocks, [*by, "block"]).selectExpr(
        *signals.columns, "block", "holding", "buy", "sell", "peak_in", "equity_in",
        "buys_in + _buys AS trade_no",
        "coalesce(_entry, if(holding OR sell, entry_in, null)) AS entry_price",
        "if(_inherited, capital_in, capital_in * inherited_factor * _gain) AS capital",
        "if(_entry IS NULL, capital_in, capital_in * inherited_factor * _gain_before) AS capital_before",
        f"if(_inherited, capital_in * (price / entry_in - {cost}D), capital_in * inherited_factor * _relative) AS equity",
    )
    return joined.selectExpr(
        *signals.columns, "holding", "buy", "sell", "trade_no", "entry_price", "capital", "capital_before", "equity",
        f"coalesce(lag(equity) OVER ({order}), equity_in, {initial}D) AS equity_before",
        f"greatest({initial}D, peak_in, max(equity) OVER {so_far}) AS peak",
    ).withColumns({"initial": F.lit(initial), "cost": F.lit(cost)})



def trades(book: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per BUY, SELL and final SELL, with shares, amount (cost or revenue) and, for sales, profit."""
    shares = "capital_before / entry_price"
    sale = f"price * {shares} * (1D - cost)"
    spent = f"entry_price * {shares} * (1D + cost)"
    side = lambda kind, when, amount, profit: (
        f"if({when}, named_struct('type', '{kind}', 'amount', {amount}, 'profit', {profit}), null)"
    )
    events = ", ".join(
        [
            side("BUY", "buy", spent, "double(null)"),
            side("SELL", "sell", sale, f"{sale} - {spent}"),
            side("SELL (final)", "holding AND pos = n", sale, f"{sale} - {spent}"),
        ]
    )
    rows = book.filter("buy OR sell OR (holding AND pos = n)").selectExpr("*", f"explode(filter(array({events}), e -> e is not null)) AS _event")
    return rows.selectExpr(*by, "trade_no", "_event.type AS type", "pos - 1 AS index", "price", f"{shares} AS shares", "_event.amount AS amount", "_event.profit AS profit")


def round_trips(book: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entry and exit of each trade with its profit; an open trade ends at the last price."""
    return trades(book, by).groupBy(*by, "trade_no").agg(
        F.expr("max(if(type = 'BUY', index, null)) AS entry_index"),
        F.expr("max(if(type = 'BUY', price, null)) AS entry_price"),
        F.expr("max(if(type <> 'BUY', index, null)) AS exit_index"),
        F.expr("max(if(type <> 'BUY', price, null)) AS exit_price"),
        F.max("profit").alias("profit"),
        F.expr("bool_or(type = 'SELL (final)') AS closed_at_end"),
    )


def equity_curve(book: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equity after each row, and the initial capital as point 0: n + 1 points per series."""
    seed = book.filter("pos = 1").selectExpr(*by, "bigint(0) AS point", "initial AS equity")
    return book.selectExpr(*by, "bigint(pos) AS point", "equity").unionByName(seed)


def results(book: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals and risk figures per series. Ratios are 0 where they are undefined."""
    final = "if(holding, capital * (price / entry_price * (1D - cost) - cost), capital)"
    sale_profit = "capital_before * (price / entry_price * (1D - cost) - cost - 1D)"
    ends = "(sell OR (holding AND pos = n))"
    grouped = book.groupBy(*by).agg(
        *[
            F.expr(x)
            for x in (
                "max(initial) AS initial_capital",
                f"sum(if(pos = n, {final}, null)) AS final_capital",
                f"count_if({ends} AND {sale_profit} > 0) AS profitable_trades",
                f"count_if({ends} AND {sale_profit} <= 0) AS losing_trades",
                "sum(if(pos = 1, price, null)) AS _first",
                "sum(if(pos = n, price, null)) AS _last",
                "avg(equity / equity_before - 1D) AS _mean",
                "stddev_pop(equity / equity_before - 1D) AS _std",
                "stddev_pop(if(equity / equity_before - 1D < -1e-12D, equity / equity_before - 1D, null)) AS _down",
                "least(min((equity - peak) / peak), 0D) * 100D AS max_drawdown",
            )
        ]
    )
    excess = f"(_mean - 0.02D / {TRADING_DAYS}D)"
    root = f"sqrt({TRADING_DAYS}D)"
    return grouped.selectExpr(
        "*",
        "(final_capital - initial_capital) / initial_capital * 100D AS total_return",
        "profitable_trades + losing_trades AS total_trades",
        "coalesce(try_divide(double(profitable_trades), double(profitable_trades + losing_trades)) * 100D, 0D) AS win_rate",
        "(_last - _first) / _first * 100D AS buy_and_hold_return",
        f"if(_std > 0D, {excess} / nullif(_std, 0D) * {root}, 0D) AS sharpe_ratio",
        f"if(_down > 0D, {excess} / nullif(_down, 0D) * {root}, 0D) AS sortino_ratio",
        f"_std * {root} * 100D AS volatility",
    ).selectExpr(
        "*",
        "total_return - buy_and_hold_return AS outperformance",
        "if(max_drawdown <> 0D, total_return / abs(nullif(max_drawdown, 0D)), 0D) AS calmar_ratio",
    ).drop("_first", "_last", "_mean", "_std", "_down")
