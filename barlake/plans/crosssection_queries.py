"""Alignment, correlation, sectors, diversification and weight search over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed_text
from barlake.operators.crosssection import (
    aligned_returns, correlations, first_per_group, group_summary, low_correlation_pairs, pair_moments, portfolio_statistics, ranked_pairs, simple_returns,
)
from barlake.operators.optimise import allocations, frontier, optimal_weights, portfolios
from barlake.operators.periods import MONTHS, in_period
from barlake.operators.weights import allocation, best, candidate_weights, efficient_frontier, with_sharpe
from barlake.plans.indicator_queries import DAY
from barlake.plans.registry import register
from barlake.plans.sqltext import day, r, weekly, with_
from barlake.session import materialise
from barlake.sources import bindings

STEP, POINTS = 10, 20

COMMON = """common AS (SELECT b.* FROM bars b JOIN (
  SELECT sector, ts FROM bars GROUP BY sector, ts
  HAVING count(*) = (SELECT count(DISTINCT instrument) FROM bars u WHERE u.sector = bars.sector)) d
  ON b.sector = d.sector AND b.ts = d.ts)"""
ALIGNED = """aligned AS (SELECT * FROM (SELECT sector, ts, instrument,
  close / lag(close) OVER (PARTITION BY instrument ORDER BY ts) - 1 AS ret FROM common) WHERE ret IS NOT NULL)"""
PADDED = """grid AS (SELECT s.sector, s.instrument, d.ts, b.close, last_value(b.close IGNORE NULLS) OVER
    (PARTITION BY s.instrument ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
  FROM (SELECT DISTINCT sector, instrument FROM bars) s JOIN (SELECT DISTINCT sector, ts FROM bars) d ON s.sector = d.sector
  LEFT JOIN bars b ON b.instrument = s.instrument AND b.ts = d.ts),
changed AS (SELECT * FROM (SELECT sector, ts, instrument, price / lag(price) OVER (PARTITION BY instrument ORDER BY ts) - 1 AS ret FROM grid)
  WHERE ret IS NOT NULL),
aligned AS (SELECT c.* FROM changed c JOIN (SELECT sector, ts FROM changed GROUP BY sector, ts
  HAVING count(*) = (SELECT count(DISTINCT instrument) FROM bars u WHERE u.sector = changed.sector)) k ON c.sector = k.sector AND c.ts = k.ts)"""
MOMENTS = """moments AS (SELECT x.sector, x.instrument AS a, y.instrument AS b, count(*) AS n, avg(x.ret) AS mean_a, avg(y.ret) AS mean_b,
  var_samp(x.ret) AS var_a, var_samp(y.ret) AS var_b, covar_samp(x.ret, y.ret) AS cov, corr(x.ret, y.ret) AS corr
  FROM aligned x JOIN aligned y ON x.sector = y.sector AND x.ts = y.ts AND x.instrument <= y.instrument GROUP BY 1, 2, 3)"""
PAIRS = f"""pairs AS (SELECT *, {r('corr', 4)} AS correlation, {r('''greatest(0, least(1, CASE WHEN n > 2 AND abs(corr) < 1
  THEN (1 - abs(corr * sqrt((n - 2) / (1 - corr * corr))) / sqrt(n)) * 2 ELSE 0 END))''', 4)} AS p_approx FROM moments WHERE a < b)"""
EVERYWHERE = "aligned_all AS (SELECT * REPLACE ('all' AS sector) FROM aligned)"


def _moments(spark: SparkSession, folder: str, align: str = "all_present") -> DataFrame:
    """The pair table; several parts of a query read it, and it is small next to the returns."""
    returns = aligned_returns(bindings.bars(spark, folder), "sector", align)
    return pair_moments(returns, "sector", bindings.places(spark, folder)).persist()


def _base(align: str = "all_present") -> list[str]:
    return [*weekly(), *([COMMON, ALIGNED] if align == "all_present" else [PADDED])]


register(
    "weekly_returns",
    lambda spark, folder: simple_returns(bindings.series(spark, folder)).selectExpr("instrument", DAY, f"{fixed_text('ret', 8)} AS ret"),
    with_(
        *weekly(),
        select=f"SELECT instrument, {day()} AS day, {r('ret', 8)} AS ret FROM (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY ts) - 1 AS ret FROM bars) WHERE ret IS NOT NULL",
    ),
)
for align in ("all_present", "pad"):
    register(
        f"aligned_returns_{align}",
        lambda spark, folder, align=align: aligned_returns(bindings.bars(spark, folder), "sector", align).selectExpr(
            "sector", "instrument", DAY, f"{fixed_text('ret', 8)} AS ret"
        ),
        with_(*_base(align), select=f"SELECT sector, instrument, {day()} AS day, {r('ret', 8)} AS ret FROM aligned"),
    )
    register(
        f"sector_correlations_{align}",
        lambda spark, folder, align=align: correlations(_moments(spark, folder, align)).select("sector", "a", "b", "n", "correlation", "p_approx"),
        with_(*_base(align), MOMENTS, PAIRS, select="SELECT sector, a, b, n, correlation, p_approx FROM pairs"),
    )

register(
    "return_statistics",
    lambda spark, folder: _moments(spark, folder).selectExpr(
        "sector", "a", "b", f"{fixed_text('mean_a * 252D')} AS annual_mean", f"{fixed_text('var_a * 252D')} AS annual_variance", f"{fixed_text('cov * 252D')} AS annual_covariance"
    ),
    with_(
        *_base(), MOMENTS,
        select=f"SELECT sector, a, b, {r('mean_a * 252')} AS annual_mean, {r('var_a * 252')} AS annual_variance, {r('cov * 252')} AS annual_covariance FROM moments",
    ),
)
register(
    "sector_extreme_pairs",
    lambda spark, folder: ranked_pairs(correlations(_moments(spark, folder)), "sector").selectExpr("sector", "side", "bigint(rank) AS rank", "a", "b", "correlation"),
    with_(
        *_base(), MOMENTS, PAIRS,
        select="""SELECT sector, 'most' AS side, rank, a, b, correlation FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY correlation DESC, a, b) AS rank FROM pairs) WHERE rank <= 3
UNION ALL SELECT sector, 'least', rank, a, b, correlation FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY correlation, a DESC, b DESC) AS rank FROM pairs) WHERE rank <= 3""",
    ),
)
register(
    "sector_correlation_summary",
    lambda spark, folder: group_summary(correlations(_moments(spark, folder)), "sector"),
    with_(
        *_base(), MOMENTS, PAIRS,
        select=f"SELECT sector, {r('avg(correlation)', 4)} AS average_correlation, {r('(1 - abs(avg(correlation))) * 100', 1)} AS diversification_score, max(n) AS data_points, count(*) AS pairs FROM pairs GROUP BY sector",
    ),
)


def _overview(spark: SparkSession, folder: str) -> DataFrame:
    bars = bindings.bars(spark, folder)
    listed = bars.select("sector", "instrument").distinct()
    first = bars.join(first_per_group(listed, "sector", 5), ["sector", "instrument"], "left_semi")
    pairs = pair_moments(aligned_returns(first, "sector")).filter("a < b")
    average = pairs.groupBy("sector").agg(F.avg("corr").alias("c"))
    sizes = listed.groupBy("sector").agg(F.count("*").alias("stock_count"))
    return sizes.join(average, "sector", "left").selectExpr(
        "sector", f"{fixed_text('coalesce(c, 0D)', 3)} AS avg_correlation", f"{fixed_text('(1D - abs(coalesce(c, 0D))) * 100D', 1)} AS diversification_score", "stock_count"
    )


FIRST5 = """listed AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY instrument) AS place FROM (SELECT DISTINCT sector, instrument FROM all_bars)),
bars AS (SELECT b.* FROM all_bars b JOIN listed l USING (sector, instrument) WHERE place <= 5)"""
FIRST3 = FIRST5.replace("place <= 5", "place <= 3")
register(
    "sector_overview",
    _overview,
    with_(
        weekly()[0], weekly()[1], weekly()[2].replace("bars AS", "all_bars AS", 1), FIRST5, COMMON, ALIGNED, MOMENTS,
        select=f"""SELECT s.sector, {r('coalesce(c, 0)', 3)} AS avg_correlation, {r('(1 - abs(coalesce(c, 0))) * 100', 1)} AS diversification_score, s.stock_count
  FROM (SELECT sector, count(*) AS stock_count FROM listed GROUP BY sector) s LEFT JOIN (SELECT sector, avg(corr) AS c FROM moments WHERE a < b GROUP BY sector) m USING (sector)""",
    ),
)


def _uncorrelated(spark: SparkSession, folder: str) -> DataFrame:
    bars = bindings.bars(spark, folder)
    chosen = first_per_group(bars.select("sector", "instrument").distinct(), "sector", 3).select("instrument").distinct()
    rows = bars.join(chosen, "instrument", "left_semi").withColumn("universe", F.lit("all"))
    return low_correlation_pairs(pair_moments(aligned_returns(rows, "universe"), "universe"))


register(
    "uncorrelated_pairs",
    _uncorrelated,
    with_(
        weekly()[0], weekly()[1], weekly()[2].replace("bars AS", "all_bars AS", 1),
        FIRST3.replace("bars AS (SELECT b.*", "bars AS (SELECT b.* REPLACE ('all' AS sector)"), COMMON, ALIGNED, MOMENTS,
        select=f"""SELECT a, b, {r('corr', 4)} AS correlation, CASE WHEN abs(corr) < CAST(0.1 AS DOUBLE) THEN 'excellent' ELSE 'good' END AS diversification
  FROM moments WHERE a < b AND abs(corr) <= CAST(0.3 AS DOUBLE) ORDER BY abs({r('corr', 4)}), a, b LIMIT 10""",
    ),
)

register(
    "uncorrelated_pairs_of_sectors",
    lambda spark, folder: low_correlation_pairs(_moments(spark, folder), 0.3, 3, "sector"),
    with_(
        *_base(), MOMENTS,
        select=f"""SELECT sector, place, a, b, correlation, diversification FROM (SELECT sector, a, b, {r('corr', 4)} AS correlation,
    CASE WHEN abs(corr) < CAST(0.1 AS DOUBLE) THEN 'excellent' ELSE 'good' END AS diversification, row_number() OVER (PARTITION BY sector ORDER BY abs({r('corr', 4)}), a, b) AS place
  FROM moments WHERE a < b AND abs(corr) <= CAST(0.3 AS DOUBLE)) WHERE place <= 3""",
    ),
)


def _equal_weights(moments: DataFrame) -> DataFrame:
    own = moments.filter("a = b").select("sector", F.col("a").alias("instrument"))
    sizes = own.groupBy("sector").agg(F.count("*").alias("k"))
    return own.join(sizes, "sector").select("sector", "instrument", (1 / F.col("k")).alias("weight"))


STATS_SQL = """held AS (SELECT m.*, CAST(1 AS DOUBLE) / k AS w FROM moments m JOIN (SELECT sector, count(*) AS k FROM moments WHERE a = b GROUP BY sector) s USING (sector)),
stats AS (SELECT sector, count(*) FILTER (a = b) AS num_assets, sum(w * mean_a * 252) FILTER (a = b) AS annual_return,
  sum(CASE WHEN a = b THEN 1 ELSE 2 END * w * w * cov * 252) AS variance, sum(w * w * cov * 252) FILTER (a = b) AS own_variance,
  coalesce(avg(corr) FILTER (a < b), 0) AS average_correlation FROM held GROUP BY sector)"""


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    moments = _moments(spark, folder)
    out = portfolio_statistics(moments, _equal_weights(moments), "sector")
    return out.selectExpr(
        "sector", "num_assets", f"{fixed_text('annual_return')} AS annual_return", f"{fixed_text('volatility')} AS volatility", f"{fixed_text('sharpe', 5)} AS sharpe",
        f"{fixed_text('average_correlation', 3)} AS average_correlation", f"{fixed_text('diversification_ratio', 3)} AS diversification_ratio",
        f"{fixed_text('diversification_benefit', 1)} AS diversification_benefit", "assessment",
    )


register(
    "portfolio_statistics",
    _statistics,
    with_(
        *_base(), MOMENTS, STATS_SQL,
        select=f"""SELECT sector, num_assets, {r('annual_return')} AS annual_return, {r('sqrt(variance)')} AS volatility,
  {r('(annual_return - CAST(0.02 AS DOUBLE)) / sqrt(variance)', 5)} AS sharpe, {r('average_correlation', 3)} AS average_correlation,
  {r('variance / own_variance', 3)} AS diversification_ratio, {r('(1 - variance / own_variance) * 100', 1)} AS diversification_benefit,
  CASE WHEN average_correlation < 0.3 THEN 'Well diversified' WHEN average_correlation < 0.6 THEN 'Moderately correlated' ELSE 'Highly correlated' END AS assessment FROM stats""",
    ),
)


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The five columns that the sample's largest sectors need, whatever sizes are there."""
    found = with_sharpe(candidate_weights(_moments(spark, folder), "sector", step_percent=STEP))
    for i in range(1, 6):
        for c, kind in (("name", "string"), ("w", "double"), ("m", "double")):
            if f"{c}{i}" not in found.columns:
                found = found.withColumn(f"{c}{i}", F.lit(None).cast(kind))
    return found


S = 100 // STEP
CANDIDATES_SQL = f"""slots AS (SELECT sector, a AS instrument, row_number() OVER (PARTITION BY sector ORDER BY a) AS slot FROM moments WHERE a = b),
one AS (SELECT m.sector, {', '.join(f"max(mean_a) FILTER (x.slot = {i} AND y.slot = {i}) AS m{i}, max(a) FILTER (x.slot = {i} AND y.slot = {i}) AS name{i}" for i in range(1, 6))},
  {', '.join(f"max(cov) FILTER (x.slot = {i} AND y.slot = {j}) AS c{i}_{j}" for i in range(1, 6) for j in range(i, 6))}
  FROM moments m JOIN slots x ON x.sector = m.sector AND x.instrument = m.a JOIN slots y ON y.sector = m.sector AND y.instrument = m.b GROUP BY m.sector),
units AS (SELECT unnest(range(0, {S + 1})) AS u),
combos AS (SELECT a.u AS u1, b.u AS u2, c.u AS u3, d.u AS u4, {S} - a.u - b.u - c.u - d.u AS u5 FROM units a, units b, units c, units d WHERE a.u + b.u + c.u + d.u <= {S}),
weighted AS (SELECT *, {', '.join(f'CASE WHEN name{i} IS NOT NULL THEN u{i} / CAST({S} AS DOUBLE) END AS w{i}' for i in range(1, 6))} FROM one, combos
  WHERE {' AND '.join(f'(name{i} IS NOT NULL OR u{i} = 0)' for i in range(1, 6))}),
cand AS (SELECT *, ({' + '.join(f'coalesce(w{i} * m{i}, 0)' for i in range(1, 6))}) * 252 AS annual_return,
  sqrt(({' + '.join(f"coalesce({'' if i == j else '2 * '}w{i} * w{j} * c{i}_{j}, 0)" for i in range(1, 6) for j in range(i, 6))}) * 252) AS volatility FROM weighted),
scored AS (SELECT *, CASE WHEN volatility > 0 THEN (annual_return - CAST(0.02 AS DOUBLE)) / volatility ELSE 0 END AS sharpe FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY {r('sharpe', 9)} DESC, w1, w2, w3, w4, w5) AS by_sharpe,
  row_number() OVER (PARTITION BY sector ORDER BY {r('volatility', 9)}, w1, w2, w3, w4, w5) AS by_volatility FROM scored)"""
RESULT = [f"{fixed_text('annual_return * 100D', 2)} AS expected_return", f"{fixed_text('volatility * 100D', 2)} AS expected_volatility", f"{fixed_text('sharpe', 3)} AS sharpe_ratio"]
RESULT_SQL = f"{r('annual_return * 100', 2)} AS expected_return, {r('volatility * 100', 2)} AS expected_volatility, {r('sharpe', 3)} AS sharpe_ratio"
WEIGHTS = ", ".join(f"w{i}" for i in range(1, 6))

for score, rank in (("sharpe", "by_sharpe"), ("volatility", "by_volatility")):
    title = "max_sharpe" if score == "sharpe" else "min_volatility"
    register(
        f"{title}_portfolio_on_grid",
        lambda spark, folder, score=score: best(_candidates(spark, folder), "sector", by=score).selectExpr(
            "sector", *WEIGHTS.split(", "), *RESULT, f"bigint({' + '.join(f'int(coalesce(w{i}, 0D) > 0.01D)' for i in range(1, 6))}) AS num_positions"
        ),
        with_(
            *_base(), MOMENTS, CANDIDATES_SQL,
            select=f"SELECT sector, {WEIGHTS}, {RESULT_SQL}, {' + '.join(f'CAST(coalesce(w{i}, 0) > 0.01 AS BIGINT)' for i in range(1, 6))} AS num_positions FROM ranked WHERE {rank} = 1",
        ),
    )
register(
    "max_sharpe_allocation_on_grid",
    lambda spark, folder: allocation(best(_candidates(spark, folder), "sector"), "sector"),
    with_(
        *_base(), MOMENTS, CANDIDATES_SQL,
        "long AS (" + " UNION ALL ".join(f"SELECT sector, name{i} AS instrument, w{i} AS weight FROM ranked WHERE by_sharpe = 1" for i in range(1, 6)) + ")",
        select=f"SELECT sector, instrument, {r('weight', 4)} AS weight, CAST({r('weight * 100', 0)} AS BIGINT) AS percent, row_number() OVER (PARTITION BY sector ORDER BY weight DESC, instrument) AS place FROM long WHERE weight > 0.01",
    ),
)
MEANS = ", ".join(f"m{i}" for i in range(1, 6))
register(
    "efficient_frontier_on_grid",
    lambda spark, folder: efficient_frontier(_candidates(spark, folder), "sector", points=POINTS).selectExpr("sector", "target", *RESULT).orderBy("sector", "expected_volatility"),
    with_(
        *_base(), MOMENTS, CANDIDATES_SQL,
        f"""aimed AS (SELECT *, CAST(floor((annual_return - least({MEANS}) * 252 * CAST(0.5 AS DOUBLE)) /
  ((greatest({MEANS}) * 252 * CAST(1.2 AS DOUBLE) - least({MEANS}) * 252 * CAST(0.5 AS DOUBLE)) / {POINTS - 1}) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS target FROM scored),
picked AS (SELECT *, row_number() OVER (PARTITION BY sector, target ORDER BY {r('volatility', 9)}, {WEIGHTS}) AS rank FROM aimed WHERE target BETWEEN 0 AND {POINTS - 1})""",
        select=f"SELECT sector, target, {RESULT_SQL} FROM picked WHERE rank = 1",
    ),
)


def _descent(goal: str, sweeps: int = 400) -> list[str]:
    """SQL of the same optimum by another way: least y'Cy / 2 - a'y with y >= 0, one coordinate after the other, scaled to sum 1."""
    aim = "CAST(1 AS DOUBLE)" if goal == "volatility" else "x.mean_a * 252 - CAST(0.02 AS DOUBLE)"
    return [
        f"""own AS (SELECT sector, list(a ORDER BY a) AS names, list({aim} ORDER BY a) AS aim, list(x.mean_a * 252 ORDER BY a) AS gain,
  list((x.mean_a * 252 - CAST(0.02 AS DOUBLE)) / sqrt(x.cov * 252) ORDER BY a) AS alone FROM moments x WHERE a = b GROUP BY sector)""",
        """sides AS (SELECT sector, a, b, cov * 252 AS c FROM moments UNION ALL SELECT sector, b, a, cov * 252 FROM moments WHERE a <> b),
matrix AS (SELECT sector, list(line ORDER BY a) AS c FROM (SELECT sector, a, list(c ORDER BY b) AS line FROM sides GROUP BY sector, a) GROUP BY sector)""",
        f"""steps AS (SELECT sector, 0 AS t, list_transform(aim, lambda x: CAST(0 AS DOUBLE)) AS y FROM own
UNION ALL SELECT s.sector, t + 1, list_transform(y, lambda x, j: CASE WHEN j = t % len(y) + 1
  THEN greatest(0, (o.aim[j] - list_inner_product(m.c[j], y) + m.c[j][j] * x) / m.c[j][j]) ELSE x END)
  FROM steps s JOIN own o ON o.sector = s.sector JOIN matrix m ON m.sector = s.sector WHERE t < {sweeps} * len(y))""",
        f"""solved AS (SELECT sector, list_transform(y, lambda x, j: CASE WHEN list_sum(y) > 0 THEN x / list_sum(y) ELSE CAST(alone[j] = list_max(alone) AS DOUBLE) END) AS w
  FROM steps JOIN own USING (sector) WHERE t = {sweeps} * len(y)),
stats AS (SELECT sector, w, names, list_inner_product(w, gain) AS annual_return,
  sqrt(list_inner_product(w, list_transform(c, lambda line: list_inner_product(line, w)))) AS volatility FROM solved JOIN own USING (sector) JOIN matrix USING (sector))""",
    ]


def _optimal(spark: SparkSession, folder: str, goal: str) -> DataFrame:
    return optimal_weights(_moments(spark, folder), "sector", goal)


for goal in ("sharpe", "volatility"):
    register(
        "max_sharpe_portfolio" if goal == "sharpe" else "min_volatility_portfolio",
        lambda spark, folder, goal=goal: portfolios(_optimal(spark, folder, goal), "sector").selectExpr("sector", *RESULT, "num_positions"),
        with_(
            *_base(), MOMENTS, *_descent(goal),
            select=f"""SELECT sector, {r('annual_return * 100', 2)} AS expected_return, {r('volatility * 100', 2)} AS expected_volatility,
  {r('(annual_return - CAST(0.02 AS DOUBLE)) / volatility', 3)} AS sharpe_ratio, CAST(len(list_filter(w, lambda x: x > 0.01)) AS BIGINT) AS num_positions FROM stats""",
        ),
    )
    register(
        "max_sharpe_allocation" if goal == "sharpe" else "min_volatility_allocation",
        lambda spark, folder, goal=goal: allocations(_optimal(spark, folder, goal), "sector"),
        with_(
            *_base(), MOMENTS, *_descent(goal),
            select=f"""SELECT sector, instrument, {r('weight', 4)} AS weight, CAST({r('weight * 100', 0)} AS BIGINT) AS percent,
  row_number() OVER (PARTITION BY sector ORDER BY {r('weight', 9)} DESC, instrument) AS place
  FROM (SELECT sector, unnest(names) AS instrument, unnest(w) AS weight FROM stats) WHERE weight > 0.01""",
        ),
    )
register(
    "efficient_frontier",
    lambda spark, folder: frontier(_moments(spark, folder), "sector", POINTS).selectExpr("sector", "spot", f"{fixed_text('target * 100D', 2)} AS target", *RESULT, "num_positions"),
    None,
)


# ---- the period that an analysis looks at: a year for sectors, two for weights
def _recent(spark: SparkSession, folder: str, period: str) -> DataFrame:
    returns = aligned_returns(in_period(bindings.bars(spark, folder), period), "sector")
    return materialise(pair_moments(returns, "sector", bindings.places(spark, folder)))


def _recent_base(period: str) -> list[str]:
    cropped = f"""bars AS (SELECT b.* FROM all_bars b JOIN (SELECT instrument AS own, max(ts) AS last_ts FROM all_bars GROUP BY instrument) ON own = instrument
  WHERE ts >= last_ts - INTERVAL {MONTHS[period]} MONTH)"""
    first, second, third = weekly()
    return [first, second, third.replace("bars AS", "all_bars AS", 1), cropped, COMMON, ALIGNED, MOMENTS]


register(
    "sector_correlations_of_last_year",
    lambda spark, folder: correlations(_recent(spark, folder, "1y")).select("sector", "a", "b", "n", "correlation", "p_approx"),
    with_(*_recent_base("1y"), PAIRS, select="SELECT sector, a, b, n, correlation, p_approx FROM pairs"),
)
register(
    "max_sharpe_allocation_of_two_years",
    lambda spark, folder: allocations(optimal_weights(_recent(spark, folder, "2y"), "sector"), "sector"),
    with_(
        *_recent_base("2y"), *_descent("sharpe"),
        select=f"""SELECT sector, instrument, {r('weight', 4)} AS weight, CAST({r('weight * 100', 0)} AS BIGINT) AS percent,
  row_number() OVER (PARTITION BY sector ORDER BY {r('weight', 9)} DESC, instrument) AS place
  FROM (SELECT sector, unnest(names) AS instrument, unnest(w) AS weight FROM stats) WHERE weight > 0.01""",
    ),
)
