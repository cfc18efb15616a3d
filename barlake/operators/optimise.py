"""Long-only portfolio weights for groups of any size: small exact problems inside, distributed pricing of all other assets outside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed
from barlake.operators.crosssection import TRADING_DAYS
from barlake.session import materialise

#: Assets of a group that a small problem starts with, and that one round adds at most.
ACTIVE = 32
#: An asset outside enters if it would improve the solution by more than this share of the variance.
TOLERANCE = 1e-10
GOALS = ("sharpe", "volatility", "target")


def least_variance(cov: np.ndarray, rows: np.ndarray, wanted: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights w >= 0 with the least w'Cw / 2 under rows @ w = wanted, from a feasible start; and the prices of the rows.

    Active sets: the free weights solve the equations; a weight that would turn negative is fixed at zero, and a
    fixed one whose price is too low is freed, until neither is there.
    """
    n = len(start)
    cov = cov + np.eye(n) * 1e-12 * max(float(np.trace(cov)) / n, 1e-300)
    w, free = start.astype(float).copy(), start > 0
    prices = np.zeros(len(rows))
    for _ in range(50 * n + 100):
        at = np.flatnonzero(free)
        system = np.block([[cov[np.ix_(at, at)], -rows[:, at].T], [rows[:, at], np.zeros((len(rows), len(rows)))]])
        solved = np.linalg.lstsq(system, np.r_[np.zeros(len(at)), wanted], rcond=None)[0]
        goal, prices = solved[: len(at)], solved[len(at) :]
        if (goal >= -1e-14).all():
            w[:] = 0
            w[at] = np.maximum(goal, 0)
            cost = cov @ w - prices @ rows
            cost[free] = 0
            worst = int(np.argmin(cost))
            if cost[worst] >= -TOLERANCE * max(float(w @ cov @ w), 1e-300):
                break
            free[worst] = True
        else:
            falls = goal < -1e-14
            ratio = np.full(len(at), np.inf)
            ratio[falls] = w[at][falls] / (w[at][falls] - goal[falls])
            first = int(np.argmin(ratio))
            w[at] += min(1.0, ratio[first]) * (goal - w[at])
            w[at[first]] = 0
            free[at[first]] = False
    return w, prices


def _solve(goal: str, risk_free: float):
    """One small problem: pairs of its assets in, weights and prices out. A problem without a solution gives no rows."""

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pairs["a"]))
        place = {x: i for i, x in enumerate(names)}
        i, j = pairs["a"].map(place).to_numpy(), pairs["b"].map(place).to_numpy()
        cov, gain = np.zeros((len(names),) * 2), np.zeros(len(names))
        cov[i, j] = cov[j, i] = pairs["cov"]
        gain[i] = pairs["gain"]
        n, target = len(names), float(pairs["target"].iloc[0])
        ones, w, prices = np.ones((1, n)), np.zeros(n), np.zeros(2)
        if goal == "volatility":
            w[int(np.argmin(np.diag(cov)))] = 1
            w, price = least_variance(cov, ones, np.ones(1), w)
            prices[0] = price[0]
        elif goal == "sharpe":
            excess = gain - risk_free
            deviation = np.sqrt(np.maximum(np.diag(cov), 1e-300))
            first = int(np.argmax(excess / deviation))
            w[first] = 1
            if excess[first] > 0:  # least variance for one unit of excess return; else one asset alone is best
                y, price = least_variance(cov, excess[None, :], np.ones(1), w / excess[first])
                w = y / y.sum()
                prices[0] = price[0] / y.sum()
        else:
            low, high = int(np.argmin(gain)), int(np.argmax(gain))
            if not gain[low] <= target <= gain[high]:
                return pd.DataFrame(columns=["grp", "spot", "target", "instrument", "weight", "price_1", "price_2", "annual_return", "volatility"])
            share = (target - gain[low]) / (gain[high] - gain[low]) if gain[high] > gain[low] else 1.0
            w[low] += 1 - share
            w[high] += share
            w, prices = least_variance(cov, np.stack([ones[0], gain]), np.array([1.0, target]), w)
        total = {"annual_return": float(w @ gain), "volatility": float(np.sqrt(max(w @ cov @ w, 0)))}
        key = pairs.iloc[0]
        return pd.DataFrame({"grp": key["grp"], "spot": key["spot"], "target": target, "instrument": names, "weight": w, "price_1": prices[0], "price_2": prices[1], **total})

    return solve


def optimal_weights(
    moments: DataFrame, group: str, goal: str = "sharpe", risk_free: float = 0.02, targets: DataFrame | None = None, active: int = ACTIVE, most_rounds: int = 200
) -> DataFrame:
    """(group, spot, target, instrument, weight, annual_return, volatility, sharpe): long-only weights that sum to 1, one row per held asset.

    `goal`: the highest Sharpe ratio, the lowest `volatility`, or `target`, the lowest volatility at a year's return of
    `targets` (group, spot, target); a target outside the assets' returns has no rows. If no asset earns more than `risk_free`,
    the best Sharpe ratio is that of one asset alone, and that one is taken.

    A group may have any number of assets. Each round solves a small problem over a bounded set of them in one task and then prices
    all others in the cluster: their covariance with the solution, against the prices of its equations. Those that would improve it
    most enter, those with weight zero leave. When none is left the solution is that of the whole group (the conditions of
    a convex problem hold for every asset). Groups no larger than `active` need one round and no pricing.
    """
    if goal not in GOALS or (goal == "target") != (targets is not None):
        raise ValueError(f"goal is one of {GOALS}; targets belong to goal 'target'")
    year = float(TRADING_DAYS)
    pairs = moments.select(F.col(group).alias("grp"), "a", "b", (F.col("cov") * year).alias("cov"))
    both = materialise(pairs.unionByName(pairs.filter("a != b").select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "cov")))
    own = moments.filter("a = b").select(F.col(group).alias("grp"), F.col("a").alias("instrument"), (F.col("mean_a") * year).alias("gain"), (F.col("cov") * year).alias("var"))
    assets = materialise(own.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("grp"))))
    single = assets.select("grp").distinct().select("grp", F.lit(0).alias("spot"), F.lit(0.0).alias("target"))
    problems = single if targets is None else targets.select(F.col(group).alias("grp"), F.col("spot").cast("int").alias("spot"), F.col("target").cast("double").alias("target"))
    score = F.asc("var") if goal != "sharpe" else F.desc(F.try_divide(F.col("gain") - risk_free, F.sqrt("var")))
    place = lambda *o: F.row_number().over(Window.partitionBy("grp").orderBy(*o, "instrument"))
    ranked = assets.withColumns({"_score": place(score), "_low": place("gain"), "_high": place(F.desc("gain"))})
    # the assets with the least and the highest return make every possible target feasible
    chosen = ranked.filter((F.col("_score") <= active) | ((F.col("_low") == 1) | (F.col("_high") == 1) if goal == "target" else F.lit(False)))
    held = problems.join(chosen.select("grp", "instrument"), "grp")
    schema = "grp string, spot int, target double, instrument string, weight double, price_1 double, price_2 double, annual_return double, volatility double"
    done: DataFrame | None = None
    for _ in range(most_rounds):
        some = held.join(both.withColumnRenamed("a", "instrument"), ["grp", "instrument"]).join(held.select("grp", "spot", F.col("instrument").alias("b")), ["grp", "spot", "b"])
        some = some.withColumnRenamed("instrument", "a").join(assets.select("grp", F.col("instrument").alias("a"), "gain"), ["grp", "a"])
        solved = materialise(some.groupBy("grp", "spot").applyInPandas(_solve(goal, risk_free), schema))
        sizes = solved.groupBy("grp", "spot").agg(F.count(F.lit(1)).alias("known"))
        large = sizes.join(assets.select("grp", "many").distinct(), "grp").filter("known < many").select("grp", "spot")
        kept = solved.filter("weight > 0")
        if not large.limit(1).count():
            done = kept if done is None else done.unionByName(kept)
            break
        # the price of every asset: its covariance with the solution, less what the equations pay for it
        open_ = kept.join(large, ["grp", "spot"])
        cost = open_.join(both.withColumnRenamed("b", "instrument"), ["grp", "instrument"]).groupBy("grp", "spot", "a").agg(
            F.sum(F.col("cov") * F.col("weight")).alias("cost"), F.max("price_1").alias("p1"), F.max("price_2").alias("p2"), F.max("volatility").alias("v"), F.max("target").alias("target"), F.max("annual_return").alias("r")
        )
        priced = cost.withColumnRenamed("a", "instrument").join(assets.select("grp", "instrument", "gain", "var"), ["grp", "instrument"])
        pays = {"volatility": F.col("p1"), "sharpe": F.col("p1") * (F.col("gain") - risk_free), "target": F.col("p1") + F.col("p2") * F.col("gain")}[goal]
        # without an asset above the risk-free rate the first one chosen has the best ratio of all
        worth = (F.col("cost") - pays < -10 * TOLERANCE * F.col("v") * F.col("v")) & (F.lit(goal != "sharpe") | (F.col("r") > risk_free))
        near = Window.partitionBy("grp", "spot").orderBy(F.col("cost") - pays, "instrument")
        enter = priced.filter(worth).withColumn("_place", F.row_number().over(near)).filter(F.col("_place") <= active).select("grp", "spot", "target", "instrument")
        enter = materialise(enter.join(solved.select("grp", "spot", "instrument"), ["grp", "spot", "instrument"], "left_anti"))
        going = enter.select("grp", "spot").distinct()
        final = kept.join(going, ["grp", "spot"], "left_anti")
        done = materialise(final if done is None else done.unionByName(final))
        held = kept.join(going, ["grp", "spot"]).select("grp", "spot", "target", "instrument").unionByName(enter.select("grp", "spot", "target", "instrument"))
        if goal == "target":
            ends = chosen.filter("_low = 1 OR _high = 1").select("grp", "instrument")
            held = held.unionByName(problems.join(going, ["grp", "spot"]).join(ends, "grp").select(held.columns)).distinct()
        if not going.limit(1).count():
            break
        held = materialise(held)
    else:
        raise RuntimeError(f"no solution within {most_rounds} rounds")
    sharpe = F.when(F.col("volatility") > 0, F.try_divide(F.col("annual_return") - risk_free, F.col("volatility"))).otherwise(0.0)
    return done.select(F.col("grp").alias(group), "spot", "target", "instrument", "weight", "annual_return", "volatility", sharpe.alias("sharpe"))


def portfolios(weights: DataFrame, group: str) -> DataFrame:
    """One row per problem: return, volatility, Sharpe ratio and the number of assets above 1%."""
    same = lambda c: F.max(c).alias(c)
    return weights.groupBy(group, "spot").agg(same("target"), same("annual_return"), same("volatility"), same("sharpe"), F.count_if(F.col("weight") > 0.01).alias("num_positions"))


def allocations(weights: DataFrame, group: str) -> DataFrame:
    """Weights above 1% as rows, largest first within the group."""
    ranked = Window.partitionBy(group).orderBy(F.desc("_w"), "instrument")
    shown = weights.filter("weight > 0.01").withColumn("_w", fixed("weight", 9))
    return shown.select(group, "instrument", fixed("weight", 4).alias("weight"), fixed(F.col("weight") * 100, 0).cast("long").alias("percent"), F.row_number().over(ranked).cast("long").alias("place"))


def frontier_targets(moments: DataFrame, group: str, points: int = 20) -> DataFrame:
    """(group, spot, target): evenly spaced returns from half the least to 1.2 times the highest of a group's assets."""
    year = F.lit(float(TRADING_DAYS))
    own = moments.filter("a = b").groupBy(group).agg((F.min("mean_a") * year * 0.5).alias("low"), (F.max("mean_a") * year * 1.2).alias("high"))
    return own.select(group, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("spot")).select(
        group, "spot", (F.col("low") + (F.col("high") - F.col("low")) * F.col("spot") / max(points - 1, 1)).alias("target")
    )


def frontier(moments: DataFrame, group: str, points: int = 20, risk_free: float = 0.02) -> DataFrame:
    """The least volatile portfolio at each of `frontier_targets`; targets that no portfolio reaches are left out."""
    return portfolios(optimal_weights(moments, group, "target", risk_free, frontier_targets(moments, group, points)), group)
