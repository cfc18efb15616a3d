"""Company information, fundamentals, search, peers, watchlists and display formats over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed, gauge_position, implied_open, magnitude, market_cap_text
from barlake.operators import companies, fundamentals
from barlake.operators.indicators import indicators
from barlake.operators.periods import quotes
from barlake.plans.indicator_queries import DAY
from barlake.plans.model_queries import fx, rx
from barlake.plans.registry import register
from barlake.plans.signal_queries import CHANGE, CHANGE_PERCENT, QUOTES_SQL
from barlake.plans.sqltext import PLACES, TICKS, bars, day, div, indicator_chain, r, weekly, with_
from barlake.sources import bindings
from barlake.sources.dimensions import with_sector

D = "CAST({} AS DOUBLE)"
INFO_SQL = [
    PLACES,
    """wealth AS (SELECT c_nationkey AS place, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS earnings, count(*) AS customers FROM customer GROUP BY 1)""",
    """assets AS (SELECT s_nationkey AS place, sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS assets FROM supplier GROUP BY 1)""",
    """sales AS (SELECT c_nationkey AS place, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS revenue, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (year(o_orderdate) = 1999) AS now,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (year(o_orderdate) = 1998) AS past FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)""",
    f"""info AS (SELECT instrument, 'Company of ' || instrument AS name, sector, CASE WHEN place % 4 <> 0 THEN 'Industry ' || (place % 3) END AS industry,
  CASE WHEN place % 3 <> 0 THEN {div('revenue', D.format('earnings') + ' * 10')} END AS trailing_pe, CASE WHEN place % 5 <> 0 THEN {div('revenue', D.format('earnings') + ' * 12')} END AS forward_pe,
  CASE WHEN place % 7 <> 0 THEN {div('earnings', 'revenue')} * 3 END AS margins, {div(D.format('earnings') + ' - ' + D.format('assets') + ' * 10', D.format('assets') + ' * 10')} AS equity,
  CASE WHEN place % 6 <> 0 THEN {div(D.format('assets') + ' * 1000', 'earnings')} END AS debt_to_equity, {div(D.format('now') + ' - ' + D.format('past'), 'past')} AS growth,
  {D.format('revenue')} AS market_cap, {D.format('customers')} AS employees, CASE WHEN place % 8 <> 0 THEN {D.format('earnings')} / 100 END AS total_cash
  FROM places LEFT JOIN wealth USING (place) LEFT JOIN assets USING (place) LEFT JOIN sales USING (place))""",
    f"""flat AS (SELECT *, coalesce(nullif(trailing_pe, 0), forward_pe) AS pe_ratio, {r('margins * 100', 2)} AS profit_margin, {r('equity * 100', 2)} AS roe, {r('growth * 100', 2)} AS revenue_growth FROM info)""",
    """pointed AS (SELECT *,
  CASE WHEN pe_ratio < 15 THEN 10 WHEN pe_ratio < 25 THEN 5 WHEN pe_ratio > 40 THEN -10 END AS p1,
  CASE WHEN profit_margin > 20 THEN 10 WHEN profit_margin > 10 THEN 5 WHEN profit_margin < 0 THEN -15 END AS p2,
  CASE WHEN roe > 20 THEN 10 WHEN roe > 10 THEN 5 WHEN roe < 0 THEN -10 END AS p3,
  CASE WHEN debt_to_equity < 50 THEN 5 WHEN debt_to_equity > 200 THEN -10 END AS p4,
  CASE WHEN revenue_growth > 15 THEN 10 WHEN revenue_growth > 5 THEN 5 WHEN revenue_growth < -5 THEN -10 END AS p5 FROM flat)""",
    """scored AS (SELECT *, CAST(greatest(0, least(100, 50 + coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) + coalesce(p4, 0) + coalesce(p5, 0))) AS BIGINT) AS score,
  concat_ws(', ', CASE p1 WHEN 10 THEN 'Low PE (+10)' WHEN 5 THEN 'Fair PE (+5)' WHEN -10 THEN 'High PE (-10)' END,
    CASE p2 WHEN 10 THEN 'High margin (+10)' WHEN 5 THEN 'Good margin (+5)' WHEN -15 THEN 'Negative margin (-15)' END,
    CASE p3 WHEN 10 THEN 'High ROE (+10)' WHEN 5 THEN 'Good ROE (+5)' WHEN -10 THEN 'Negative ROE (-10)' END,
    CASE p4 WHEN 5 THEN 'Low debt (+5)' WHEN -10 THEN 'High debt (-10)' END,
    CASE p5 WHEN 10 THEN 'High growth (+10)' WHEN 5 THEN 'Moderate growth (+5)' WHEN -10 THEN 'Declining revenue (-10)' END) AS factors FROM pointed)""",
    """rated AS (SELECT *, CASE WHEN score >= 75 THEN 'Strong Buy' WHEN score >= 60 THEN 'Buy' WHEN score >= 40 THEN 'Hold' WHEN score >= 25 THEN 'Sell' ELSE 'Strong Sell' END AS rating FROM scored)""",
]


def text1(x: str) -> str:
    return f"printf('%.1f', {r(x, 1)})"


SUMMARY = f"""concat_ws(' | ', 'Overall rating: ' || rating || ' (score: ' || score || '/100)', CASE WHEN pe_ratio <> 0 THEN 'P/E ' || {text1('pe_ratio')} END,
  CASE WHEN profit_margin <> 0 THEN 'Margin ' || {text1('profit_margin')} || '%' END, CASE WHEN roe <> 0 THEN 'ROE ' || {text1('roe')} || '%' END)"""


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return fundamentals.fundamentals(bindings.company_information(spark, folder))


register(
    "fundamental_scores",
    lambda spark, folder: _flat(spark, folder).selectExpr("instrument", "score", "rating", "concat_ws(', ', factors) AS factors", "summary"),
    with_(*INFO_SQL, select=f"SELECT instrument, score, rating, factors, {SUMMARY} AS summary FROM rated"),
)
register(
    "fundamental_percentages",
    lambda spark, folder: _flat(spark, folder).select("instrument", fixed("pe_ratio", 5).alias("pe_ratio"), "profit_margin", "roe", "revenue_growth", fixed("debt_to_equity", 5).alias("debt_to_equity")),
    with_(*INFO_SQL, select=f"SELECT instrument, {rx('pe_ratio', 5)}, profit_margin, roe, revenue_growth, {rx('debt_to_equity', 5)} FROM rated"),
)


def _record(spark: SparkSession, folder: str) -> DataFrame:
    record = fundamentals.grouped_record(_flat(spark, folder))
    show = lambda group: F.array_join(F.array_sort(F.transform(F.map_entries(group), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias(group)
    return record.select("instrument", "name", "sector", "industry", show("valuation"), show("profitability"), show("financial_health"), show("per_share"), F.col("size").getItem("market_cap").cast("double").alias("market_cap"), F.size("size").alias("sizes"), show("dividends"), show("analysts"), "rating")


def entry(key: str, x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN '{key}=' || CAST({x} AS VARCHAR) END"


register(
    "fundamental_records",
    _record,
    with_(
        *INFO_SQL,
        select=f"""SELECT instrument, name, sector, coalesce(industry, 'N/A') AS industry, coalesce({entry('pe_ratio', r('pe_ratio', 2))}, '') AS valuation,
  concat_ws(';', {entry('profit_margin', 'profit_margin')}, {entry('revenue_growth', 'revenue_growth')}, {entry('roe', 'roe')}) AS profitability,
  concat_ws(';', {entry('debt_to_equity', r('debt_to_equity', 2))}, {entry('total_cash', r('total_cash', 2))}) AS financial_health, '' AS per_share,
  {r('market_cap', 2)} AS market_cap, CAST(market_cap IS NOT NULL AS INTEGER) AS sizes, 'ex_dividend_date=' AS dividends, 'recommendation=buy' AS analysts, rating FROM rated""",
    ),
)
register(
    "valuation_comparison",
    lambda spark, folder: fundamentals.valuation_comparison(_flat(spark, folder)).withColumn("pe_ratio", fixed("pe_ratio", 5)),
    with_(
        *INFO_SQL,
        select=f"""SELECT instrument, {r('trailing_pe', 5)} AS pe_ratio, CAST(NULL AS DOUBLE) AS peg_ratio, CAST(NULL AS DOUBLE) AS price_to_book, CAST(NULL AS DOUBLE) AS ev_to_ebitda,
  profit_margin, roe, revenue_growth FROM rated""",
    ),
)


# ---- directory
def _directory(spark: SparkSession, folder: str) -> DataFrame:
    return bindings.company_information(spark, folder).select("instrument", F.col("longName").alias("name"), "sector", "industry", F.col("marketCap").alias("market_cap"), "employees")


register(
    "company_information",
    lambda spark, folder: companies.company_info(_directory(spark, folder)),
    with_(*INFO_SQL, select="SELECT instrument, name, sector, coalesce(industry, 'N/A') AS industry, market_cap, employees FROM info"),
)
for name, query in (("company_search", "merica"), ("company_search_offer", "zzzq")):
    register(
        name,
        lambda spark, folder, query=query: companies.search(_directory(spark, folder), query),
        with_(
            *INFO_SQL[:5], f"found AS (SELECT instrument, name, sector FROM info WHERE contains(lower(instrument), '{query}') OR contains(lower(name), '{query}') OR contains(lower(sector), '{query}'))",
            select=f"SELECT * FROM found UNION ALL SELECT '{query.upper()}', 'Not in the directory', 'Custom' WHERE NOT EXISTS (SELECT 1 FROM found)",
        ),
    )
register(
    "sector_facet",
    lambda spark, folder: companies.in_sector(_directory(spark, folder), "ASIA").select("instrument", "name"),
    with_(*INFO_SQL[:5], select="SELECT instrument, name FROM info WHERE sector = 'ASIA'"),
)
register(
    "sector_of_bars",
    lambda spark, folder: with_sector(bindings.bars(spark, folder, "month").drop("sector"), bindings.places(spark, folder)).groupBy("sector").agg(
        F.count("*").alias("bars"), F.countDistinct("instrument").alias("instruments")
    ),
    with_(PLACES, TICKS, bars("month"), select="SELECT sector, count(*) AS bars, count(DISTINCT instrument) AS instruments FROM bars GROUP BY sector"),
)
register(
    "symbol_lists",
    lambda spark, folder: bindings.table(spark, folder, "part").select(
        "p_partkey", F.explode(companies.symbols(F.concat(F.col("p_name"), F.lit(" ,, "), F.col("p_type"), F.lit(" , "), F.lower("p_brand")))).alias("symbol")
    ),
    "SELECT p_partkey, unnest([upper(p_name), upper(p_type), upper(p_brand)]) AS symbol FROM part",
)


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes(bindings.bars(spark, folder, "day"))


QUOTED = [PLACES, TICKS, bars("day"), QUOTES_SQL]
register(
    "peer_quotes",
    lambda spark, folder: companies.peer_quotes(
        bindings.places(spark, folder).select("instrument"), bindings.peers(spark, folder), _quotes(spark, folder), _directory(spark, folder), "NATION_0"
    ).selectExpr("instrument", "peer", "name", "current_price", *fx("change_percent")),
    with_(
        *QUOTED,
        "peers AS (SELECT a.instrument, b.instrument AS peer FROM places a JOIN places b ON a.sector = b.sector AND a.instrument <> b.instrument)",
        "lists AS (SELECT * FROM peers UNION ALL SELECT p.instrument, d.peer FROM places p, peers d WHERE d.instrument = 'NATION_0' AND p.instrument NOT IN (SELECT instrument FROM peers))",
        select=f"SELECT l.instrument, peer, 'Company of ' || peer AS name, current_price, {r(CHANGE_PERCENT)} AS change_percent FROM lists l JOIN quotes q ON q.instrument = peer",
    ),
)


def _watchlist(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' places and a name without bars, as a watched list."""
    watched = bindings.table(spark, folder, "customer").select(F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("instrument")).distinct()
    return companies.watchlist_quotes(watched, _quotes(spark, folder)).selectExpr("instrument", "current_price", *fx("change change_percent"))


register(
    "watchlist_quotes",
    _watchlist,
    with_(*QUOTED, select=f"SELECT w.instrument, current_price, {r(CHANGE)} AS change, {r(CHANGE_PERCENT)} AS change_percent FROM (SELECT DISTINCT 'NATION_' || (c_custkey % 30) AS instrument FROM customer) w LEFT JOIN quotes q USING (instrument)").replace(
        f"{r(CHANGE)} AS change, {r(CHANGE_PERCENT)}", f"CASE WHEN current_price IS NOT NULL THEN {r(CHANGE)} END AS change, CASE WHEN current_price IS NOT NULL THEN {r(CHANGE_PERCENT)} END"
    ),
)
register(
    "key_statistics",
    lambda spark, folder: _quotes(spark, folder).withColumn("implied_open", implied_open(F.col("current_price"), F.col("change"))).selectExpr("instrument", *fx("implied_open")),
    with_(*QUOTED, select=f"SELECT instrument, {r(f'current_price - {CHANGE}')} AS implied_open FROM quotes"),
)
register(
    "signal_gauges",
    lambda spark, folder: indicators(bindings.series(spark, folder), ["rsi", "williams_r"]).select(
        "instrument", F.expr(DAY), fixed(gauge_position(F.col("rsi"), F.lit(30.0), F.lit(70.0)), 5).alias("rsi_gauge"), fixed(gauge_position(F.col("williams_r"), F.lit(-100.0), F.lit(0.0)), 5).alias("williams_gauge")
    ),
    with_(
        *weekly(), *indicator_chain(),
        select=f"SELECT instrument, {day()} AS day, {r('CASE WHEN rsi IS NOT NULL THEN least(greatest((rsi - 30) / 40 * 100, 0), 100) END', 5)} AS rsi_gauge, {r('CASE WHEN williams_r IS NOT NULL THEN least(greatest((williams_r + 100) / 100 * 100, 0), 100) END', 5)} AS williams_gauge FROM ind",
    ),
)


def fixed_sql(x: str, dp: int) -> str:
    return f"printf('%.{dp}f', {r(x, dp)})"


AMOUNTS = "CASE o_orderkey % 5 WHEN 0 THEN o_totalprice * 100000000 WHEN 1 THEN o_totalprice * 100000 WHEN 2 THEN o_totalprice * 100 WHEN 3 THEN o_totalprice / 7 END"
register(
    "magnitude_texts",
    lambda spark, folder: bindings.table(spark, folder, "orders").withColumn("amount", F.expr(AMOUNTS)).select("o_orderkey", magnitude(F.col("amount")).alias("text"), market_cap_text(F.coalesce("amount", F.lit(0.0))).alias("cap_text")),
    f"""SELECT o_orderkey, CASE WHEN amount IS NULL THEN '--' WHEN abs(amount) >= 1e12 THEN '$' || {fixed_sql('amount / 1e12', 2)} || 'T' WHEN abs(amount) >= 1e9 THEN '$' || {fixed_sql('amount / 1e9', 2)} || 'B'
  WHEN abs(amount) >= 1e6 THEN {fixed_sql('amount / 1e6', 1)} || 'M' ELSE {fixed_sql('amount', 2)} END AS text,
  CASE WHEN coalesce(amount, 0) >= 1e12 THEN '$' || {fixed_sql('amount / 1e12', 2)} || 'T' WHEN coalesce(amount, 0) >= 1e9 THEN '$' || {fixed_sql('amount / 1e9', 2)} || 'B' ELSE '$' || {fixed_sql('coalesce(amount, 0) / 1e6', 0)} || 'M' END AS cap_text
FROM (SELECT o_orderkey, {AMOUNTS} AS amount FROM orders)""",
)
