"""Alerts, prediction scorekeeping, portfolios and news over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed_text
from barlake.functions.text import BEARISH, BULLISH, Lexicon
from barlake.functions.votes import alert_condition, combined_votes, direction_correct, majority, record_id
from barlake.operators import monitor, news, portfolio
from barlake.operators.features import min_max_scaled
from barlake.operators.indicators import indicators, latest_indicators
from barlake.operators.periods import quotes
from barlake.plans.indicator_queries import DAY
from barlake.plans.model_queries import fx, rx
from barlake.plans.registry import register
from barlake.plans.signal_queries import QUOTES_SQL, RSI_VOTE, TREND_VOTE
from barlake.plans.sqltext import PLACES, PRICE, TICKS, bars, day, div, filled, indicator_chain, r, weekly, with_
from barlake.session import materialise
from barlake.sources import bindings

# ---- alerts
ORDERS_SQL = """orders_by_place AS (SELECT o_orderkey AS id, instrument, CAST(o_orderdate AS TIMESTAMP) AS ordered, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = place)"""
ALERTS_SQL = """alerts AS (SELECT id, instrument, CASE id % 4 WHEN 0 THEN 'price_above' WHEN 1 THEN 'price_below' WHEN 2 THEN 'rsi_above' ELSE 'rsi_below' END AS alert_type,
  CAST(CASE WHEN id % 4 < 2 THEN 820 + (id * 7) % 170 ELSE 35 + (id * 3) % 30 END AS DOUBLE) AS value, ordered AS created_at FROM orders_by_place WHERE status <> 'P')"""
FIRES = """coalesce(CASE alert_type WHEN 'price_above' THEN close > value WHEN 'price_below' THEN close < value WHEN 'rsi_above' THEN rsi > value WHEN 'rsi_below' THEN rsi < value END, false)"""
OBSERVED = "CASE WHEN alert_type LIKE 'rsi%' THEN rsi ELSE close END"
ALERTS = [*weekly(), ORDERS_SQL, ALERTS_SQL]


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.current_alerts(bindings.alert_events(spark, folder))


def _rsi(spark: SparkSession, folder: str) -> DataFrame:
    return indicators(bindings.series(spark, folder), ["rsi"])


register(
    "current_alerts",
    lambda spark, folder: _alerts(spark, folder).select(
        "id", "instrument", "alert_type", "value", F.date_format("created_at", "yyyy-MM-dd").alias("day"), alert_condition(F.col("alert_type"), F.col("value")).alias("condition")
    ),
    with_(
        *ALERTS,
        select=f"""SELECT id, instrument, alert_type, value, {day('created_at')} AS day, CASE alert_type WHEN 'price_above' THEN 'Price > $' WHEN 'price_below' THEN 'Price < $'
  WHEN 'rsi_above' THEN 'RSI > ' ELSE 'RSI < ' END || CAST(value AS VARCHAR) AS condition FROM alerts""",
    ),
)


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.check_alerts(_alerts(spark, folder), latest_indicators(bindings.bars(spark, folder), ["rsi"]))


LATEST_RSI = "latest AS (SELECT instrument, close, rsi FROM ind WHERE pos = n)"
register(
    "alerts_on_latest_quotes",
    lambda spark, folder: _checked(spark, folder).selectExpr("id", "instrument", "alert_type", "value", *fx("triggered_value")),
    with_(*ALERTS, *indicator_chain(), LATEST_RSI, select=f"SELECT id, instrument, alert_type, value, {r(OBSERVED)} AS triggered_value FROM alerts JOIN latest USING (instrument) WHERE {FIRES}"),
)


def _triggered(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.first_triggers(_alerts(spark, folder), _rsi(spark, folder))


FIRST_SQL = f"""fired AS (SELECT id, min(ts) AS triggered_at, arg_min({OBSERVED}, ts) AS triggered_value FROM alerts JOIN ind USING (instrument)
  WHERE ts >= created_at AND {FIRES} GROUP BY id),
state AS (SELECT a.*, triggered_at, triggered_value, triggered_at IS NOT NULL AS triggered FROM alerts a LEFT JOIN fired USING (id))"""
register(
    "alert_first_triggers",
    lambda spark, folder: _triggered(spark, folder).selectExpr(
        "id", "instrument", "alert_type", "bigint(triggered) AS triggered", "coalesce(date_format(triggered_at, 'yyyy-MM-dd'), '') AS day", *fx("triggered_value")
    ),
    with_(
        *ALERTS, *indicator_chain(), FIRST_SQL,
        select=f"SELECT id, instrument, alert_type, CAST(triggered AS BIGINT) AS triggered, coalesce({day('triggered_at')}, '') AS day, {r('triggered_value')} AS triggered_value FROM state",
    ),
)
register(
    "alert_statistics",
    lambda spark, folder: monitor.alert_statistics(_triggered(spark, folder), ["instrument"]),
    with_(
        *ALERTS, *indicator_chain(), FIRST_SQL,
        select="SELECT instrument, count(*) AS total, count(*) FILTER (NOT triggered) AS active, count(*) FILTER (triggered) AS triggered FROM state GROUP BY instrument",
    ),
)
register(
    "open_alerts_of_instrument",
    lambda spark, folder: monitor.select_alerts(_triggered(spark, folder), "nation_3").select("id", "instrument", "alert_type", "value"),
    with_(*ALERTS, *indicator_chain(), FIRST_SQL, select="SELECT id, instrument, alert_type, value FROM state WHERE instrument = 'NATION_3' AND NOT triggered"),
)
register(
    "instruments_with_open_alerts",
    lambda spark, folder: monitor.select_alerts(_triggered(spark, folder)).select("instrument").distinct(),
    with_(*ALERTS, *indicator_chain(), FIRST_SQL, select="SELECT DISTINCT instrument FROM state WHERE NOT triggered"),
)

# ---- predictions
PREDICTIONS_SQL = """predictions AS (SELECT p.id, p.instrument, p.ordered AS recorded_at, CASE status WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'SELL' ELSE 'HOLD' END AS signal, b.close AS price
  FROM orders_by_place p ASOF JOIN bars b ON p.instrument = b.instrument AND p.ordered >= b.ts),
due AS (SELECT *, recorded_at + INTERVAL 5 DAY AS due_at FROM predictions),
after AS (SELECT d.*, b.close AS price_after FROM due d ASOF LEFT JOIN bars b ON d.instrument = b.instrument AND d.due_at <= b.ts),
checked AS (SELECT *, price_after IS NOT NULL AS verified, floor((price_after - price) / price * 100 * 100 + 0.5) / 100 AS return_pct,
  CASE signal WHEN 'BUY' THEN price_after > price WHEN 'SELL' THEN price_after < price ELSE true END AS correct FROM after)""".replace(
    "floor((price_after - price) / price * 100 * 100 + 0.5) / 100", r("(price_after - price) / price * 100", 2)
)
PREDICTED = [*weekly(), ORDERS_SQL, PREDICTIONS_SQL]


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.verify_predictions(bindings.predictions(spark, folder), bindings.bars(spark, folder))


register(
    "recorded_predictions",
    lambda spark, folder: bindings.predictions(spark, folder).select(
        "id", "instrument", "signal", "price", record_id(F.col("instrument"), F.col("recorded_at")).alias("record_id"), F.date_format("recorded_at", "yyyy-MM-dd").alias("day")
    ),
    with_(*PREDICTED, select=f"SELECT id, instrument, signal, price, instrument || '_' || strftime(recorded_at, '%Y%m%d_%H%M%S') AS record_id, {day('recorded_at')} AS day FROM predictions"),
)
register(
    "verified_predictions",
    lambda spark, folder: _verified(spark, folder).filter("verified").selectExpr("id", "instrument", "signal", "price", "price_after", "return_pct", "bigint(correct) AS correct"),
    with_(*PREDICTED, select="SELECT id, instrument, signal, price, price_after, return_pct, CAST(correct AS BIGINT) AS correct FROM checked WHERE verified"),
)
register(
    "pending_predictions",
    lambda spark, folder: _verified(spark, folder).groupBy("instrument").agg(F.count_if(~F.col("verified")).alias("pending"), F.count_if("verified").alias("verified")),
    with_(*PREDICTED, select="SELECT instrument, count(*) FILTER (NOT verified) AS pending, count(*) FILTER (verified) AS verified FROM checked GROUP BY instrument"),
)
SCORE_SQL = f"""count(*) AS total_predictions, {r('count(*) FILTER (correct) / CAST(count(*) AS DOUBLE) * 100', 1)} AS accuracy, {r('avg(return_pct)', 2)} AS avg_return,
  {r('count(*) FILTER (return_pct > 0) / CAST(count(*) AS DOUBLE) * 100', 1)} AS win_rate, count(*) FILTER (return_pct > 0) AS profitable_trades, count(*) - count(*) FILTER (return_pct > 0) AS losing_trades"""
for name, keys in (("prediction_scorecard", ["instrument"]), ("prediction_scorecard_by_signal", ["instrument", "signal"])):
    register(
        name,
        lambda spark, folder, keys=keys: monitor.scorecard(_verified(spark, folder), keys),
        with_(*PREDICTED, select=f"SELECT {', '.join(keys)}, {SCORE_SQL} FROM checked WHERE verified GROUP BY {', '.join(keys)}"),
    )
register(
    "prediction_scorecard_30_days",
    lambda spark, folder: monitor.scorecard(_verified(spark, folder), ["signal"], days=30),
    with_(*PREDICTED, select=f"SELECT signal, {SCORE_SQL} FROM checked WHERE verified AND recorded_at >= (SELECT max(recorded_at) FROM checked WHERE verified) - INTERVAL 30 DAY GROUP BY signal"),
)
register(
    "accuracy_trend",
    lambda spark, folder: monitor.accuracy_trend(_verified(spark, folder)),
    with_(
        *PREDICTED,
        f"""o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY recorded_at, id) AS period,
  avg(CAST(correct AS DOUBLE)) OVER (PARTITION BY instrument ORDER BY recorded_at, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS share FROM checked WHERE verified)""",
        select=f"SELECT instrument, period, {r('share * 100', 1)} AS accuracy, CAST(10 AS BIGINT) AS predictions, {day('recorded_at')} AS day FROM o WHERE period >= 10",
    ),
)
register(
    "direction_rule",
    lambda spark, folder: bindings.bars(spark, folder, "day").select(
        "instrument", F.expr(DAY), direction_correct(F.when(F.dayofmonth("ts") % 3 == 0, "BUY").when(F.dayofmonth("ts") % 3 == 1, "SELL").otherwise("HOLD"), F.col("open"), F.col("close")).cast("long").alias("correct")
    ),
    with_(PLACES, TICKS, bars("day"), select=f"SELECT instrument, {day()} AS day, CAST(CASE dayofmonth(ts) % 3 WHEN 0 THEN close > open WHEN 1 THEN close < open ELSE true END AS BIGINT) AS correct FROM bars"),
)

# ---- portfolios
TRADES_SQL = f"""trades AS (SELECT o_custkey AS portfolio, CAST(o_orderdate AS TIMESTAMP) AS traded_at, o_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate,
  instrument, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS action, l_quantity AS shares, {PRICE} AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = place JOIN part ON l_partkey = p_partkey)"""
SEQ = "traded_at, o_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate"
BOOK_SQL = f"""seqd AS (SELECT *, row_number() OVER (PARTITION BY portfolio, instrument ORDER BY {SEQ}) AS rn FROM trades),
steps AS (SELECT portfolio, instrument, rn, action = 'BUY' AS accepted, CASE WHEN action = 'BUY' THEN shares ELSE 0 END AS held, CASE WHEN action = 'BUY' THEN price ELSE 0 END AS average, CAST(NULL AS DOUBLE) AS profit
    FROM seqd WHERE rn = 1
  UNION ALL SELECT s.portfolio, s.instrument, s.rn, s.action = 'BUY' OR (p.held > 0 AND s.shares <= p.held),
    CASE WHEN s.action = 'BUY' THEN p.held + s.shares WHEN p.held > 0 AND s.shares <= p.held THEN p.held - s.shares ELSE p.held END,
    CASE WHEN s.action = 'BUY' THEN (p.held * p.average + s.shares * s.price) / (p.held + s.shares) WHEN p.held > 0 AND s.shares = p.held THEN 0 ELSE p.average END,
    CASE WHEN s.action = 'SELL' AND p.held > 0 AND s.shares <= p.held THEN (s.price - p.average) * s.shares END
  FROM steps p JOIN seqd s ON s.portfolio = p.portfolio AND s.instrument = p.instrument AND s.rn = p.rn + 1),
book AS (SELECT s.*, accepted, held, average, profit FROM seqd s JOIN steps USING (portfolio, instrument, rn))"""
BOOK = [PLACES, TRADES_SQL, BOOK_SQL]
#: The account of a portfolio, one transaction a step: cash, and shares and average cost by instrument.
ACCOUNT_SQL = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY {SEQ}) AS rn FROM trades),
account AS (SELECT portfolio, CAST(0 AS BIGINT) AS rn, CAST(100000 AS DOUBLE) AS cash, MAP {{'': {{'held': CAST(0 AS DOUBLE), 'average': CAST(0 AS DOUBLE)}}}} AS open, CAST(NULL AS BOOLEAN) AS accepted,
    CAST(NULL AS DOUBLE) AS held, CAST(NULL AS DOUBLE) AS average, CAST(NULL AS DOUBLE) AS profit FROM (SELECT DISTINCT portfolio FROM numbered)
  UNION ALL SELECT portfolio, rn, CASE WHEN NOT ok THEN cash WHEN buy THEN cash - amount ELSE cash + amount END,
    map_concat(open, MAP {{instrument: {{'held': now_held, 'average': now_average}}}}), ok, now_held, now_average, CASE WHEN ok AND NOT buy THEN (price - average) * shares END
  FROM (SELECT *, CASE WHEN ok AND buy THEN held + shares WHEN ok THEN held - shares ELSE held END AS now_held,
      CASE WHEN ok AND buy THEN (held * average + amount) / (held + shares) WHEN ok AND held = shares THEN 0 ELSE average END AS now_average
    FROM (SELECT *, CASE WHEN buy THEN amount <= cash ELSE held > 0 AND shares <= held END AS ok
      FROM (SELECT s.portfolio, s.rn, s.instrument, s.price, s.shares, s.shares * s.price AS amount, s.action = 'BUY' AS buy, a.cash, a.open,
          coalesce(list_extract(map_extract(a.open, s.instrument), 1).held, 0) AS held, coalesce(list_extract(map_extract(a.open, s.instrument), 1).average, 0) AS average
        FROM account a JOIN numbered s ON s.portfolio = a.portfolio AND s.rn = a.rn + 1)))),
book AS (SELECT s.*, cash, accepted, held, average, profit FROM numbered s JOIN account USING (portfolio, rn))"""
ACCOUNT = [PLACES, TRADES_SQL, ACCOUNT_SQL]


def _transactions(spark: SparkSession, folder: str) -> DataFrame:
    return bindings.transactions(spark, folder)


def _book(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.position_book(_transactions(spark, folder), bindings.TRANSACTION_ORDER)


def _account(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.cash_account(_transactions(spark, folder), bindings.TRANSACTION_ORDER)


register(
    "position_book",
    lambda spark, folder: _book(spark, folder).selectExpr(
        "portfolio", "o_orderkey", "bigint(l_linenumber) AS l_linenumber", "l_suppkey", "l_partkey", "instrument", "action", "bigint(accepted) AS accepted",
        "shares_after AS held", f"{fixed_text('avg_price_after')} AS average", *fx("profit", 4),
    ),
    with_(*BOOK, select=f"SELECT portfolio, o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey, instrument, action, CAST(accepted AS BIGINT) AS accepted, held, {r('average')} AS average, {r('profit', 4)} AS profit FROM book"),
)
register(
    "realised_profit",
    lambda spark, folder: _account(spark, folder).filter("profit is not null").groupBy("portfolio").agg(F.count("*").alias("sales"), F.sum("profit").alias("profit")).selectExpr("portfolio", "sales", *fx("profit", 3)),
    with_(*ACCOUNT, select=f"SELECT portfolio, count(*) AS sales, {r('sum(profit)', 3)} AS profit FROM book WHERE profit IS NOT NULL GROUP BY portfolio"),
)


def _valued(spark: SparkSession, folder: str, account: DataFrame | None = None) -> DataFrame:
    account = _account(spark, folder) if account is None else account
    return portfolio.valued_positions(portfolio.open_positions(account, bindings.TRANSACTION_ORDER), quotes(bindings.bars(spark, folder, "day")))


VALUED_SQL = [
    *ACCOUNT, TICKS, bars("day"), QUOTES_SQL,
    """open_positions AS (SELECT portfolio, instrument, held AS shares, average AS avg_price FROM book QUALIFY row_number() OVER (PARTITION BY portfolio, instrument ORDER BY rn DESC) = 1),
valued AS (SELECT p.*, coalesce(current_price, avg_price) AS price_now, shares * avg_price AS invested FROM open_positions p LEFT JOIN quotes USING (instrument) WHERE shares > 0),
gained AS (SELECT *, shares * price_now AS current_value, shares * price_now - invested AS profit_loss FROM valued)""",
]
register(
    "valued_positions",
    lambda spark, folder: _valued(spark, folder).selectExpr("portfolio", "instrument", "shares", *fx("avg_price"), f"{fixed_text('current_price')} AS price_now", *fx("invested current_value profit_loss profit_pct", 5)),
    with_(*VALUED_SQL, select=f"SELECT portfolio, instrument, shares, {rx('avg_price price_now')}, {rx("invested current_value profit_loss", 5)}, {r("profit_loss / invested * 100", 5)} AS profit_pct FROM gained"),
)


# Sums of exact prices often end in a 5 at the digit that is rounded; a small shift keeps both engines on one side of it.
OFF_TIES = "0.0000002D"
SUMMARY_COLUMNS = ("current_cash", "total_invested", "total_positions_value", "total_portfolio_value", "total_return")


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("portfolio", "instrument", *bindings.TRANSACTION_ORDER, "shares_after", "avg_price_after", "cash_after")
    account = materialise(_account(spark, folder).select(*columns))  # read for the positions and for the cash
    out = portfolio.summary(_valued(spark, folder, account), portfolio.cash_left(account, bindings.TRANSACTION_ORDER))
    return out.selectExpr("portfolio", "num_positions", *[f"{fixed_text(f'{c} + {OFF_TIES}', 3)} AS {c}" for c in SUMMARY_COLUMNS])


register(
    "portfolio_summary",
    _summary,
    with_(
        *VALUED_SQL,
        "flows AS (SELECT portfolio, arg_max(cash, rn) AS cash FROM book GROUP BY portfolio)",
        "t AS (SELECT portfolio, sum(invested) AS invested, sum(current_value) AS v, count(*) AS k FROM gained GROUP BY portfolio)",
        "s AS (SELECT portfolio, coalesce(k, 0) AS num_positions, cash AS current_cash, coalesce(invested, 0) AS total_invested, coalesce(v, 0) AS total_positions_value FROM flows LEFT JOIN t USING (portfolio))",
        "u AS (SELECT *, current_cash + total_positions_value AS total_portfolio_value, (current_cash + total_positions_value - 100000) / 100000 * 100 AS total_return FROM s)",
        select="SELECT portfolio, num_positions, " + ", ".join(r(f"{c} + CAST(0.0000002 AS DOUBLE)", 3) + f" AS {c}" for c in SUMMARY_COLUMNS) + " FROM u",
    ),
)
register(
    "last_transactions",
    lambda spark, folder: portfolio.last_transactions(_transactions(spark, folder), bindings.TRANSACTION_ORDER, 5).selectExpr("portfolio", "date_format(traded_at, 'yyyy-MM-dd') AS day", "instrument", "action", "shares", *fx("price", 4)),
    with_(PLACES, TRADES_SQL, select=f"SELECT portfolio, {day('traded_at')} AS day, instrument, action, shares, {rx('price', 4)} FROM trades QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY {', '.join(c + ' DESC' for c in SEQ.split(', '))}) <= 5"),
)
register(
    "cash_account",
    lambda spark, folder: _account(spark, folder).selectExpr(
        "portfolio", "o_orderkey", "bigint(l_linenumber) AS l_linenumber", "l_suppkey", "l_partkey", "instrument", "action", "bigint(accepted) AS accepted",
        "shares_after AS held", f"{fixed_text('avg_price_after')} AS average", *fx("profit", 4), f"{fixed_text('cash_after', 4)} AS cash",
    ),
    with_(
        *ACCOUNT,
        select=f"SELECT portfolio, o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey, instrument, action, CAST(accepted AS BIGINT) AS accepted, held, {r('average')} AS average, {r('profit', 4)} AS profit, {r('cash', 4)} AS cash FROM book",
    ),
)

# ---- news: the sample texts hardly hold words of the default lexicon, so common words are added for the check
SAMPLE = Lexicon((*BULLISH, "the", "with", "for", "from", "re", "of the", "la"), (*BEARISH, "that", "this", "by", "an", "er", "on the", "de"))


def words_sql(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms if " " not in t) + "]"


def points_sql(terms) -> str:
    phrases = "".join(f" + CASE WHEN contains(lower(title), '{t}') THEN 2 ELSE 0 END" for t in terms if " " in t)
    return f"len(list_intersect(w, {words_sql(terms)})){phrases}"


NEWS_SQL = [
    PLACES,
    r"""news AS (SELECT instrument, CAST(DATE '2024-01-01' + CAST((doc_id * 37) % 365 AS INTEGER) AS TIMESTAMP) AS published, doc_id AS doc, text AS title, source,
  list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents JOIN places ON doc_id % 25 = place)""",
    f"pts AS (SELECT *, CAST({points_sql(SAMPLE.bullish)} AS BIGINT) AS bullish, CAST({points_sql(SAMPLE.bearish)} AS BIGINT) AS bearish FROM news)",
    f"""scored AS (SELECT *, {r(f"coalesce({div('bullish - bearish', 'bullish + bearish')}, 0)", 3)} AS score, coalesce({div('bullish - bearish', 'bullish + bearish')}, 0) AS exact,
  {r("least((bullish + bearish) / CAST(5 AS DOUBLE), 1) * 100", 1)} AS confidence FROM pts)""",
    """labelled AS (SELECT *, CASE WHEN exact > CAST(0.15 AS DOUBLE) THEN 'bullish' WHEN exact < CAST(-0.15 AS DOUBLE) THEN 'bearish' ELSE 'neutral' END AS label FROM scored)""",
]


def rolled_sql(where: str = "true") -> str:
    return f"""rolled AS (SELECT instrument, count(*) AS article_count, count(*) FILTER (label = 'bullish') AS bullish_count, count(*) FILTER (label = 'bearish') AS bearish_count,
  count(*) FILTER (label = 'neutral') AS neutral_count, CAST(sum(CAST(round(score * 1000) AS BIGINT)) AS DOUBLE) / CAST(1000 AS DOUBLE) / count(*) AS mean FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY published DESC, doc) AS place FROM labelled) WHERE {where} GROUP BY instrument)"""


OVERALL = "CASE WHEN mean > CAST(0.1 AS DOUBLE) THEN 'bullish' WHEN mean < CAST(-0.1 AS DOUBLE) THEN 'bearish' ELSE 'neutral' END"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return news.scored_articles(news.clean_news(bindings.news(spark, folder)), SAMPLE)


register(
    "article_sentiment",
    lambda spark, folder: _scored(spark, folder).select("doc", "instrument", "bullish", "bearish", "score", "label", "confidence"),
    with_(*NEWS_SQL, select="SELECT doc, instrument, bullish, bearish, score, label, confidence FROM labelled"),
)
register(
    "article_sentiment_default_lexicon",
    lambda spark, folder: news.scored_articles(bindings.news(spark, folder)).select("doc", "bullish", "bearish", "label"),
    with_(
        *NEWS_SQL[:2],
        f"pts AS (SELECT *, CAST({points_sql(BULLISH)} AS BIGINT) AS bullish, CAST({points_sql(BEARISH)} AS BIGINT) AS bearish FROM news)",
        select=f"SELECT doc, bullish, bearish, CASE WHEN {div('bullish - bearish', 'bullish + bearish')} > CAST(0.15 AS DOUBLE) THEN 'bullish' WHEN {div('bullish - bearish', 'bullish + bearish')} < CAST(-0.15 AS DOUBLE) THEN 'bearish' ELSE 'neutral' END AS label FROM pts",
    ),
)
for name, limit in (("news_sentiment", 15), ("news_sentiment_all_articles", None)):
    register(
        name,
        lambda spark, folder, limit=limit: news.news_sentiment(
            _scored(spark, folder) if limit is None else news.scored_articles(news.first_articles(bindings.news(spark, folder), limit), SAMPLE)
        ).select("instrument", "article_count", "bullish_count", "bearish_count", "neutral_count", "overall", "score", "confidence"),
        with_(
            *NEWS_SQL, rolled_sql("true" if limit is None else f"place <= {limit}"),
            select=f"SELECT instrument, article_count, bullish_count, bearish_count, neutral_count, {OVERALL} AS overall, {r('mean', 3)} AS score, {r('greatest(bullish_count, bearish_count, neutral_count) / CAST(article_count AS DOUBLE) * 100', 1)} AS confidence FROM rolled",
        ),
    )
register(
    "first_articles",
    lambda spark, folder: news.first_articles(bindings.news(spark, folder), 10).selectExpr("instrument", "bigint(place) AS place", "doc", "source", "date_format(published, 'yyyy-MM-dd') AS day"),
    with_(*NEWS_SQL[:2], select=f"SELECT instrument, place, doc, source, {day('published')} AS day FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY published DESC, doc) AS place FROM news) WHERE place <= 10"),
)

# ---- the five voters together: scaled close as model output, news score as sentiment
VOTERS = ("rsi", "macd", "macd_signal", "sma_20")


def _combined(spark: SparkSession, folder: str, lagged: bool = False) -> DataFrame:
    frame = indicators(bindings.series(spark, folder), VOTERS, fill=True)
    frame = min_max_scaled(frame, ["close"])
    if lagged:
        frame = frame.filter("pos = n - 1")
    scores = news.news_sentiment(_scored(spark, folder)).select("instrument", "score")
    joined = frame.join(scores, "instrument", "left")
    voted = joined.withColumns(combined_votes("close_scaled", "close", "rsi", "macd", "macd_signal", "sma_20", "score"))
    votes = {v: F.col(f"{v}_vote") for v in ("ml", "rsi", "macd", "trend", "sentiment")}
    return voted.withColumns(majority(votes)).select(
        "instrument", F.expr(DAY), "ml_vote", "rsi_vote", "macd_vote", "trend_vote", "sentiment_vote", "up_votes", "down_votes", "neutral_votes", "direction", "confidence", "strength"
    )


COMBINED_SQL = [
    *weekly(), *indicator_chain(), filled(VOTERS), *NEWS_SQL[1:], rolled_sql(),
    f"""v AS (SELECT f.instrument, ts, pos, n, CASE WHEN p > CAST(0.55 AS DOUBLE) THEN 'UP' WHEN p < CAST(0.45 AS DOUBLE) THEN 'DOWN' ELSE 'NEUTRAL' END AS ml_vote, {RSI_VOTE} AS rsi_vote,
  CASE WHEN macd > macd_signal THEN 'UP' WHEN macd < macd_signal THEN 'DOWN' ELSE 'NEUTRAL' END AS macd_vote, {TREND_VOTE} AS trend_vote,
  CASE WHEN {r('coalesce(mean, 0)', 3)} > CAST(0.15 AS DOUBLE) THEN 'UP' WHEN {r('coalesce(mean, 0)', 3)} < CAST(-0.15 AS DOUBLE) THEN 'DOWN' ELSE 'NEUTRAL' END AS sentiment_vote
  FROM (SELECT *, (close - min(close) OVER (PARTITION BY instrument)) / (max(close) OVER (PARTITION BY instrument) - min(close) OVER (PARTITION BY instrument)) AS p FROM filled) f
  LEFT JOIN rolled USING (instrument))""",
    "c AS (SELECT *, "
    + ", ".join(
        " + ".join(f"CAST({v}_vote = '{side}' AS BIGINT)" for v in ("ml", "rsi", "macd", "trend", "sentiment")) + f" AS {name}"
        for side, name in (("UP", "up_votes"), ("DOWN", "down_votes"), ("NEUTRAL", "neutral_votes"))
    )
    + " FROM v)",
    "d AS (SELECT *, CASE WHEN up_votes > down_votes THEN 'UP' WHEN down_votes > up_votes THEN 'DOWN' ELSE 'UNCERTAIN' END AS direction, greatest(up_votes, down_votes) AS winner FROM c)",
]
COMBINED_OUT = f"""SELECT instrument, {day()} AS day, ml_vote, rsi_vote, macd_vote, trend_vote, sentiment_vote, up_votes, down_votes, neutral_votes, direction,
  CASE WHEN direction = 'UNCERTAIN' THEN 0 ELSE CAST(round(winner / CAST(up_votes + down_votes AS DOUBLE) * 100) AS BIGINT) END AS confidence,
  CASE WHEN direction = 'UNCERTAIN' THEN 'NO_CLEAR_SIGNAL' ELSE CASE WHEN winner >= 4 THEN 'STRONG_' WHEN winner >= 3 THEN 'LIKELY_' ELSE 'WEAK_' END || direction END AS strength FROM d"""
register("combined_votes", _combined, with_(*COMBINED_SQL, select=COMBINED_OUT))
register("combined_votes_lagged", lambda spark, folder: _combined(spark, folder, True), with_(*COMBINED_SQL, select=COMBINED_OUT + " WHERE pos = n - 1"))
