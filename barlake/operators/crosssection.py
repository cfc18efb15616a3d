"""Returns of many instruments side by side: alignment, correlation, covariance, diversification.

Returns stay long (group, ts, instrument, ret). Pair sums are made by tiles: instruments of a group are cut into tiles
of bounded size, time into chunks, and each (tile, tile, chunk) is one small matrix product in one task. Rows per task
are bounded by tile x chunk whatever the size of the group, and a pair leaves a task once per chunk, not once per date.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numeric import change, fixed
from barlake.operators.series import BLOCK_ROWS, BUCKET_SECONDS, index_rows, with_blocks

TRADING_DAYS = 252
TILE = 256


def simple_returns(bars: DataFrame, by: Sequence[str] = ("instrument",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """close / close of the bar before - 1; the first bar of a series has none and is dropped."""
    indexed = bars if {"pos", "n"} <= set(bars.columns) else index_rows(bars, by)
    order = Window.partitionBy(*by, "block").orderBy("pos")
    moved = with_blocks(indexed, block_rows, 1).withColumn("ret", change(F.col("close"), F.lag("close").over(order)))
    return moved.filter(~F.col("is_halo") & F.col("ret").isNotNull()).drop("block", "is_halo")


def _dates_of_all(rows: DataFrame, group: str) -> DataFrame:
    """(group, ts) where every instrument of the group has a row."""
    per_date = rows.groupBy(group, "ts").agg(F.count(F.lit(1)).alias("_present"))
    universe = rows.select(group, "instrument").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_universe"))
    return per_date.join(universe, group).filter(F.col("_present") == F.col("_universe")).select(group, "ts")


def aligned_returns(bars: DataFrame, group: str = "sector", align: str = "all_present", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Returns (group, ts, instrument, ret) on common dates.

    `all_present` drops dates on which an instrument of the group has no bar, then takes returns. `pad` carries the
    last price over gaps, so that the return in a gap is 0, and drops only the dates before every instrument has one.
    """
    bars = bars.select(group, "instrument", "ts", "close")
    if align == "all_present":
        common = bars.join(_dates_of_all(bars, group), [group, "ts"], "left_semi")
        return simple_returns(common, (group, "instrument"), block_rows).select(group, "ts", "instrument", "ret")
    if align != "pad":
        raise ValueError("align is 'all_present' or 'pad'")
    dates = index_rows(bars.select(group, "ts").distinct(), (group,)).select(group, "ts", F.col("pos").alias("_at"), F.col("n").alias("_dates"))
    first = bars.groupBy(group, "instrument").agg(F.min("ts").alias("_first")).groupBy(group).agg(F.max("_first").alias("_start"))
    placed = index_rows(bars, (group, "instrument")).join(dates, [group, "ts"])
    order = Window.partitionBy(group, "instrument", "block").orderBy("pos")
    # A bar covers its own date and the dates up to the next bar. With two halo rows exactly one copy of each bar sees
    # both neighbours: the own one, or for the last row of a block the copy in the next block.
    copies = with_blocks(placed, block_rows, 2).withColumns({"_next": F.lead("_at").over(order), "_before": F.lag("close").over(order)})
    last, opening = F.col("pos") == F.col("n"), F.col("pos") == 1
    whole = copies.filter((F.col("_next").isNotNull() | last) & (F.col("_before").isNotNull() | opening))
    until = F.when(last, F.col("_dates")).otherwise(F.col("_next") - 1)
    covered = whole.select(
        group, "instrument", F.col("_at").alias("_own"), change(F.col("close"), F.col("_before")).alias("_ret"), F.explode(F.sequence(F.col("_at"), until)).alias("_at")
    )
    padded = covered.join(dates, [group, "_at"]).join(first, group).filter(F.col("ts") > F.col("_start"))
    return padded.select(group, "ts", "instrument", F.when(F.col("_at") == F.col("_own"), F.col("_ret")).otherwise(0.0).alias("ret"))


_SUMS = ("n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")


def _tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pair sums of one (tile, tile, chunk) by matrix products over a dates x instruments matrix."""
    group, tile_a, tile_b, _ = key
    dates, at = np.unique(rows["ts"].to_numpy(), return_inverse=True)
    names, who = np.unique(rows["instrument"].to_numpy(dtype=str), return_inverse=True)
    tile = np.zeros(len(names), dtype=np.int64)
    tile[who] = rows["tile"].to_numpy()
    values = np.zeros((len(dates), len(names)))
    seen = np.zeros_like(values)
    values[at, who] = rows["ret"].to_numpy()
    seen[at, who] = 1.0
    left, right = np.flatnonzero(tile == tile_a), np.flatnonzero(tile == tile_b)
    x, y, sx, sy = values[:, left], values[:, right], seen[:, left], seen[:, right]
    sums = (sx.T @ sy, x.T @ sy, sx.T @ y, (x * x).T @ sy, sx.T @ (y * y), x.T @ y)
    a, b = np.meshgrid(names[left], names[right], indexing="ij")
    keep = (a <= b) & (sums[0] > 0)
    out = pd.DataFrame({"a": a[keep], "b": b[keep]})
    for name, matrix in zip(_SUMS, sums, strict=True):
        out[name] = matrix[keep]
    out.insert(0, "grp", group)
    return out


def pair_moments(
    returns: DataFrame, group: str = "sector", instruments: DataFrame | None = None, tile: int = TILE, chunk_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """For every pair a <= b of a group (a = b included): n, means, sample variances, covariance and correlation.

    Tiles follow the order of the instrument names, so a pair across tiles always has its smaller name in the first
    one. `instruments` (group, instrument), where known, saves a pass over the returns to list them.
    """
    names = returns.select(group, "instrument").distinct() if instruments is None else instruments.select(group, "instrument")
    ranked = names.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("instrument")) - 1)
    tiles = ranked.select(
        group, "instrument", F.floor(F.col("_rank") / tile).alias("tile"),
        F.floor((F.max("_rank").over(Window.partitionBy(group))) / tile).alias("_last_tile"),
    )
    partners = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last_tile")))
    rows = returns.join(tiles, [group, "instrument"]).withColumn("_partner", partners)
    keyed = rows.select(
        F.col(group).alias("grp"), F.least("tile", "_partner").alias("tile_a"), F.greatest("tile", "_partner").alias("tile_b"),
        F.floor(F.unix_seconds("ts") / chunk_seconds).alias("chunk"), "ts", "instrument", "tile", "ret",
    )
    schema = "grp string, a string, b string, " + ", ".join(f"{s} double" for s in _SUMS)
    total = keyed.groupBy("grp", "tile_a", "tile_b", "chunk").applyInPandas(_tile_sums, schema)
    summed = total.groupBy("grp", "a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])
    c = F.col
    above = c("n") > 1
    spread = lambda sq, x, y: F.when(above, (c(sq) - c(x) * c(y) / c("n")) / F.greatest(c("n") - 1, F.lit(1.0)))
    moments = summed.select(
        c("grp").alias(group), "a", "b", c("n").cast("long").alias("n"), (c("sum_a") / c("n")).alias("mean_a"), (c("sum_b") / c("n")).alias("mean_b"),
        spread("sum_aa", "sum_a", "sum_a").alias("var_a"), spread("sum_bb", "sum_b", "sum_b").alias("var_b"), spread("sum_ab", "sum_a", "sum_b").alias("cov"),
    )
    return moments.withColumn("corr", F.try_divide(c("cov"), F.sqrt(c("var_a") * c("var_b"))))


def correlations(moments: DataFrame) -> DataFrame:
    """Pairs a < b with the correlation to 4 decimals and its rough p value (0 for |r| = 1 or two dates)."""
    r, n = F.col("corr"), F.col("n").cast("double")
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    rough = F.when((n > 2) & (F.abs(r) < 1), (1 - F.abs(t) / F.sqrt(n)) * 2).otherwise(0.0)
    return moments.filter("a < b").withColumns(
        {
            "correlation": fixed(F.coalesce(r, F.lit(0.0)), 4),
            "p_approx": fixed(F.when(r.isNull(), 1.0).otherwise(F.least(F.greatest(rough, F.lit(0.0)), F.lit(1.0))), 4),
        }
    )


def ranked_pairs(pairs: DataFrame, group: str, k: int = 3) -> DataFrame:
    """The k most and the k least correlated pairs of each group."""
    down = Window.partitionBy(group).orderBy(F.desc("correlation"), "a", "b")
    up = Window.partitionBy(group).orderBy("correlation", F.desc("a"), F.desc("b"))
    most = pairs.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= k).withColumn("side", F.lit("most"))
    least = pairs.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= k).withColumn("side", F.lit("least"))
    return most.unionByName(least)


def group_summary(pairs: DataFrame, group: str, dp: int = 4) -> DataFrame:
    """Average of the pair correlations, diversification score and number of common dates per group."""
    average = F.avg("correlation")
    return pairs.groupBy(group).agg(
        fixed(average, dp).alias("average_correlation"),
        fixed((1 - F.abs(average)) * 100, 1).alias("diversification_score"),
        F.max("n").alias("data_points"),
        F.count(F.lit(1)).alias("pairs"),
    )


def first_per_group(instruments: DataFrame, group: str, k: int) -> DataFrame:
    """First k instruments of each group in listing order (here: by name)."""
    listed = Window.partitionBy(group).orderBy("instrument")
    return instruments.withColumn("_rank", F.row_number().over(listed)).filter(F.col("_rank") <= k).drop("_rank")


def low_correlation_pairs(moments: DataFrame, most: float = 0.3, k: int = 10, group: str | None = None) -> DataFrame:
    """The k pairs with the smallest absolute correlation among those within `most`, tested before rounding: of the
    whole table, or with `group` the k of each group with their `place`."""
    size = F.abs("corr")
    found = moments.filter("a < b").filter(size <= most)
    keys = [] if group is None else [group]
    tagged = found.select(
        *keys, "a", "b", fixed("corr", 4).alias("correlation"), F.when(size < 0.1, "excellent").otherwise("good").alias("diversification")
    )
    order = (F.abs("correlation"), "a", "b")
    if group is None:
        return tagged.orderBy(*order).limit(k)
    placed = tagged.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.filter(F.col("place") <= k).select(group, F.col("place").cast("long").alias("place"), "a", "b", "correlation", "diversification").orderBy(group, "place")


def portfolio_statistics(moments: DataFrame, weights: DataFrame, group: str, risk_free: float = 0.02) -> DataFrame:
    """Annual return, volatility, Sharpe ratio and diversification of weights(group, instrument, weight)."""
    wa = weights.select(group, F.col("instrument").alias("a"), F.col("weight").alias("wa"))
    wb = weights.select(group, F.col("instrument").alias("b"), F.col("weight").alias("wb"))
    held = moments.join(wa, [group, "a"]).join(wb, [group, "b"])
    own = F.col("a") == F.col("b")
    share = F.col("wa") * F.col("wb") * F.col("cov") * TRADING_DAYS
    summed = held.groupBy(group).agg(
        F.sum(F.when(own, F.col("wa") * F.col("mean_a")) * TRADING_DAYS).alias("annual_return"),
        F.sum(F.when(own, share).otherwise(share * 2)).alias("variance"),
        F.sum(F.when(own, share)).alias("own_variance"),
        F.avg(F.when(~own, F.col("corr"))).alias("_corr"),
        F.count_if(own).alias("num_assets"),
    )
    average = F.coalesce(F.col("_corr"), F.lit(0.0))
    ratio = F.when(F.col("own_variance") > 0, F.try_divide(F.col("variance"), F.col("own_variance"))).otherwise(1.0)
    volatility = F.sqrt("variance")
    return summed.select(
        group, "num_assets", "annual_return", volatility.alias("volatility"),
        F.when(volatility > 0, F.try_divide(F.col("annual_return") - risk_free, volatility)).otherwise(0.0).alias("sharpe"),
        average.alias("average_correlation"), ratio.alias("diversification_ratio"), ((1 - ratio) * 100).alias("diversification_benefit"),
        F.when(average < 0.3, "Well diversified").when(average < 0.6, "Moderately correlated").otherwise("Highly correlated").alias("assessment"),
    )

