"""Positions, cash and profit from a table of transactions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INITIAL_CASH = 100000.0
FOLD_COLUMNS = "accepted boolean, shares_after double, avg_price_after double, profit double, cash_after double"


def _apply_in_order(keys: Sequence[str], check_cash: bool, initial: float):
    """Reads transactions that arrive ordered by key and sequence, and advances all keys of a batch together: the first
    transactions of all keys in one step, then the second ones, and so on. Only the state of the key that a batch ends in
    is carried on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_cash, last_held = None, initial, {}
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            names = list(zip(*(batch[k] for k in keys), strict=True))
            fresh = np.r_[True, [a != b for a, b in zip(names, names[1:])]]
            group = np.cumsum(fresh) - 1
            kinds, who = np.unique(batch["instrument"].astype(str).to_numpy(), return_inverse=True)
            slots, slot = np.unique(group * len(kinds) + who, return_inverse=True)
            cash, have, average = np.full(group[-1] + 1, initial), np.zeros(len(slots)), np.zeros(len(slots))
            if names[0] == last:
                cash[0] = last_cash
                for i, s in enumerate(slots[slots < len(kinds)]):
                    have[i], average[i] = last_held.get(kinds[s], (0.0, 0.0))
            wanted, price = batch["shares"].to_numpy(float), batch["price"].to_numpy(float)
            buys = (batch["action"] == "BUY").to_numpy()
            accepted, profit = np.zeros(n, bool), np.full(n, np.nan)
            after = np.zeros((3, n))
            turn = np.arange(n) - np.flatnonzero(fresh)[group]
            order = np.argsort(turn, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
                g, s, p, buy = group[rows], slot[rows], price[rows], buys[rows]
                held, mean = have[s], average[s]
                shares = np.where(np.isnan(wanted[rows]) & ~buy, held, wanted[rows])  # a sale without a number sells all
                amount = shares * p
                bought = buy & ((amount <= cash[g]) if check_cash else ~np.isnan(amount))
                sold = ~buy & (held > 0) & (shares <= held)
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(bought, (held * mean + amount) / (held + shares), mean)
                left = np.where(bought, held + shares, np.where(sold, held - shares, held))
                profit[rows] = np.where(sold, (p - average[s]) * shares, np.nan)
                accepted[rows] = bought | sold
                cash[g] += np.where(bought, -amount, np.where(sold, amount, 0.0))
                have[s], average[s] = np.where(left > 0, left, 0.0), np.where(left > 0, mean, 0.0)
                after[:, rows] = have[s], average[s], cash[g]
            start = group[-1] * len(kinds)
            kept = {} if names[0] != names[-1] or names[0] != last else last_held
            last, last_cash = names[-1], float(cash[-1])
            last_held = kept | {kinds[x - start]: (have[i], average[i]) for i, x in enumerate(slots) if x >= start}
            result = {"accepted": accepted, "shares_after": after[0], "avg_price_after": after[1], "profit": profit, "cash_after": after[2]}
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(result)], axis=1)

    return run


def _fold(transactions: DataFrame, keys: Sequence[str], order: Sequence[str], check_cash: bool, initial: float) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in transactions.schema.fields)
    ordered = transactions.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(_apply_in_order(keys, check_cash, initial), f"{schema}, {FOLD_COLUMNS}")


def position_book(transactions: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each transaction with the position of its (portfolio, instrument) after it: shares and average cost. A SELL of
    more than is held is rejected, one without shares sells all; a SELL keeps the average cost and has a profit. No limit
    on cash: for portfolios with an account use `cash_account`."""
    return _fold(transactions, ("portfolio", "instrument"), order, False, 0.0).drop("cash_after")


def cash_account(transactions: DataFrame, order: Sequence[str], initial: float = INITIAL_CASH) -> DataFrame:
    """As `position_book`, and a BUY that costs more than the portfolio's cash is rejected.

    What is accepted depends on everything before it in the portfolio, so one portfolio is one ordered pass. It is
    streamed: a task holds one batch and the open positions of one portfolio. Work spreads over portfolios.
    """
    return _fold(transactions, ("portfolio",), order, True, initial)


def open_positions(book: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last state of each (portfolio, instrument) with shares left."""
    newest = Window.partitionBy("portfolio", "instrument").orderBy(*[F.desc(c) for c in order])
    last = book.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
    return last.filter(F.col("shares_after") > 0).select("portfolio", "instrument", F.col("shares_after").alias("shares"), F.col("avg_price_after").alias("avg_price"))


def valued_positions(positions: DataFrame, prices: DataFrame, missing: str = "average") -> DataFrame:
    """Positions at current prices (instrument, current_price). Without a price a position counts at its average cost,
    or at 0 with `missing='zero'`."""
    fallback = F.col("avg_price") if missing == "average" else F.lit(0.0)
    priced = positions.join(prices.select("instrument", "current_price"), "instrument", "left").withColumn("current_price", F.coalesce("current_price", fallback))
    valued = priced.withColumns({"invested": F.col("shares") * F.col("avg_price"), "current_value": F.col("shares") * F.col("current_price")})
    gain = F.col("current_value") - F.col("invested")
    return valued.withColumns(
        {"profit_loss": gain, "profit_pct": F.when(F.col("invested") > 0, F.try_divide(gain, F.col("invested")) * 100).otherwise(0.0)}
    )


def cash_left(account: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cash of each portfolio after its last transaction."""
    return account.groupBy("portfolio").agg(F.max_by("cash_after", F.struct(*order)).alias("current_cash"))


def summary(valued: DataFrame, cash: DataFrame, initial: float = INITIAL_CASH) -> DataFrame:
    """Cash, invested amount, value and total return per portfolio."""
    totals = valued.groupBy("portfolio").agg(
        F.sum("invested").alias("total_invested"), F.sum("current_value").alias("total_positions_value"), F.count(F.lit(1)).alias("num_positions")
    )
    return cash.join(totals, "portfolio", "left").selectExpr(
        "portfolio", f"{initial}D AS initial_capital", "current_cash", "coalesce(total_invested, 0D) AS total_invested",
        "coalesce(total_positions_value, 0D) AS total_positions_value", "coalesce(num_positions, 0L) AS num_positions",
    ).selectExpr(
        "*", "current_cash + total_positions_value AS total_portfolio_value", "(current_cash + total_positions_value - initial_capital) / initial_capital * 100D AS total_return"
    )


def last_transactions(transactions: DataFrame, order: Sequence[str], limit: int = 50) -> DataFrame:
    """The last `limit` transactions of each portfolio."""
    newest = Window.partitionBy("portfolio").orderBy(*[F.desc(c) for c in order])
    return transactions.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= limit).drop("_rank")
