"""Portfolio weights by search over a grid, for many portfolios at once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed
from barlake.operators.crosssection import TRADING_DAYS

MOST_ASSETS = 12


def candidate_weights(moments: DataFrame, group: str, assets: int | None = None, step_percent: int = 5) -> DataFrame:
    """Every long-only weight vector on the grid (multiples of `step_percent`, sum 1) for each group: columns w1..wk, in
    order of the instrument name, with return, volatility and Sharpe ratio. Smaller groups have null in the columns beyond
    their size.

    Groups of all sizes come out; one over MOST_ASSETS raises, for its grid cannot be walked. `assets` picks the groups of that size
    alone, as a selection. The number of sizes is small, so each has a plan of its own; a group's means and covariances sit in one row
    (k is checked), so scoring a candidate is arithmetic on one row; the grid is spread over the cluster after its first weight.
    """
    if assets is not None:
        if not 1 <= assets <= MOST_ASSETS:
            raise ValueError(f"1 to {MOST_ASSETS} assets")
        return _grid(moments, group, assets, step_percent)
    sizes = sorted(r[0] for r in moments.filter("a = b").groupBy(group).count().select("count").distinct().limit(MOST_ASSETS + 1).collect())
    if sizes and sizes[-1] > MOST_ASSETS or len(sizes) > MOST_ASSETS:
        raise ValueError(f"a group has {sizes[-1]} assets; the grid takes {MOST_ASSETS}")
    grids = [_grid(moments, group, k, step_percent) for k in reversed(sizes)] or [_grid(moments, group, 1, step_percent)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), grids)


def _weights(candidates: DataFrame, assets: int | None) -> list[str]:
    return [f"w{i}" for i in range(1, assets + 1)] if assets else sorted((c for c in candidates.columns if re.fullmatch("w[0-9]+", c)), key=lambda c: int(c[1:]))


def _grid(moments: DataFrame, group: str, assets: int, step_percent: int) -> DataFrame:
    """The grid of the groups with exactly so many instruments."""
    k, steps = assets, 100 // step_percent
    own = moments.filter("a = b").select(group, F.col("a").alias("instrument"))
    order = Window.partitionBy(group).orderBy("instrument")
    slots = own.withColumns({"slot": F.row_number().over(order), "_size": F.count(F.lit(1)).over(Window.partitionBy(group))}).filter(F.col("_size") == k)
    slot = lambda x: slots.select(group, F.col("instrument").alias(x), F.col("slot").alias(f"slot_{x}"))
    placed = moments.join(slot("a"), [group, "a"]).join(slot("b"), [group, "b"])
    cell = lambda i, j, x: F.max(F.when((F.col("slot_a") == i) & (F.col("slot_b") == j), F.col(x)))
    one_row = placed.groupBy(group).agg(
        *[cell(i, i, "mean_a").alias(f"m{i}") for i in range(1, k + 1)],
        *[cell(i, i, "a").alias(f"name{i}") for i in range(1, k + 1)],
        *[cell(i, j, "cov").alias(f"c{i}_{j}") for i in range(1, k + 1) for j in range(i, k + 1)],
    )
    grid = one_row.withColumn("_left", F.lit(steps))
    for i in range(1, k):
        grid = grid.withColumn(f"u{i}", F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn("_left", F.col("_left") - F.col(f"u{i}"))
        if i == 1:
            grid = grid.repartition(F.col(group), F.col("u1"))
    grid = grid.withColumnRenamed("_left", f"u{k}")
    w = {i: f"(u{i} / {float(steps)}D)" for i in range(1, k + 1)}
    mean = " + ".join(f"{w[i]} * m{i}" for i in w)
    variance = " + ".join(f"{'' if i == j else '2D * '}{w[i]} * {w[j]} * c{i}_{j}" for i in w for j in w if i <= j)
    return grid.selectExpr(
        group,
        *[f"name{i}" for i in w],
        *[f"{w[i]} AS w{i}" for i in w],
        f"({mean}) * {TRADING_DAYS}D AS annual_return",
        f"sqrt(({variance}) * {TRADING_DAYS}D) AS volatility",
        *[f"m{i}" for i in w],
    )


def with_sharpe(candidates: DataFrame, risk_free: float = 0.02) -> DataFrame:
    return candidates.withColumn(
        "sharpe", F.when(F.col("volatility") > 0, F.try_divide(F.col("annual_return") - risk_free, F.col("volatility"))).otherwise(0.0)
    )


def best(candidates: DataFrame, group: str, assets: int | None = None, by: str = "sharpe", target_return: float | None = None) -> DataFrame:
    """The candidate with the highest `sharpe` or the lowest `volatility` of each group; ties by weights. With
    `target_return` (a year's) only those candidates count whose return is nearest to it."""
    score = fixed(by, 9)
    first = F.desc("_score") if by == "sharpe" else F.asc("_score")
    off = [fixed(F.abs(F.col("annual_return") - target_return), 9)] if target_return is not None else []
    order = Window.partitionBy(group).orderBy(*off, first, *_weights(candidates, assets))
    return candidates.withColumn("_score", score).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "_score")


def allocation(chosen: DataFrame, group: str, assets: int | None = None) -> DataFrame:
    """Weights above 1% as rows, largest first within the group."""
    names = _weights(chosen, assets)
    pairs = ", ".join(f"name{w[1:]}, {w}" for w in names)
    long = chosen.selectExpr(group, f"stack({len(names)}, {pairs}) AS (instrument, weight)").filter(F.col("weight") > 0.01)
    ranked = Window.partitionBy(group).orderBy(F.desc("weight"), "instrument")
    return long.select(
        group, "instrument", fixed("weight", 4).alias("weight"), fixed(F.col("weight") * 100, 0).cast("long").alias("percent"), F.row_number().over(ranked).cast("long").alias("place")
    )


def efficient_frontier(candidates: DataFrame, group: str, assets: int | None = None, points: int = 20) -> DataFrame:
    """For evenly spaced target returns, the least volatile candidate whose return is nearest to the target; targets
    with no candidate near them are left out."""
    names = _weights(candidates, assets)
    means = [F.col(f"m{w[1:]}") for w in names]
    low = (F.least(*means) if len(means) > 1 else means[0]) * TRADING_DAYS * 0.5
    high = (F.greatest(*means) if len(means) > 1 else means[0]) * TRADING_DAYS * 1.2
    width = (high - low) / (points - 1)
    nearest: Column = F.floor((F.col("annual_return") - low) / F.nullif(width, F.lit(0.0)) + 0.5)
    placed = candidates.withColumns({"target": nearest.cast("long"), "_vol": fixed("volatility", 9)}).filter(F.col("target").between(0, points - 1))
    order = Window.partitionBy(group, "target").orderBy("_vol", *names)
    return placed.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "_vol")
