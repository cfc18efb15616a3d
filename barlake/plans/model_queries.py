"""Targets, sequences, models, walk-forward folds, ledgers and risk over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed_text
from barlake.functions.votes import simple_signal, trading_signal
from barlake.operators import features, ledger, models
from barlake.operators.indicators import indicators
from barlake.plans.indicator_queries import DAY
from barlake.plans.registry import register
from barlake.plans.sqltext import PLACES, TICKS, bars, day, indexed, indicator_chain, r, weekly, with_
from barlake.sources import bindings

BY = ["instrument"]


def fx(columns: str, dp: int = 6) -> list[str]:
    return [f"{fixed_text(c, dp)} AS {c}" for c in columns.split()]


def rx(columns: str, dp: int = 6) -> str:
    return ", ".join(f"{r(c, dp)} AS {c}" for c in columns.split())


# ---- targets, scaling, sequences
TARGET = """target AS (SELECT *, n - 1 AS m FROM (SELECT *, lead(close) OVER (PARTITION BY instrument ORDER BY pos) AS future_price FROM ix)
  WHERE future_price IS NOT NULL)"""
SCALED = """scaled AS (SELECT *, coalesce((close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0), 0) AS close_scaled,
  coalesce((volume - min(volume) OVER w) / nullif(max(volume) OVER w - min(volume) OVER w, 0), 0) AS volume_scaled,
  coalesce((future_price - min(future_price) OVER w) / nullif(max(future_price) OVER w - min(future_price) OVER w, 0), 0) AS future_scaled
  FROM target WINDOW w AS (PARTITION BY instrument))"""
BASE = [*weekly(), indexed(), TARGET, SCALED]


def _target(spark: SparkSession, folder: str) -> DataFrame:
    return features.with_target(bindings.series(spark, folder))


register(
    "future_price_target",
    lambda spark, folder: _target(spark, folder).selectExpr("instrument", DAY, "close", "future_price", "bigint(price_direction) AS price_direction"),
    with_(*BASE, select=f"SELECT instrument, {day()} AS day, close, future_price, CAST(future_price > close AS BIGINT) AS price_direction FROM target"),
)
register(
    "min_max_scaled",
    lambda spark, folder: features.min_max_scaled(_target(spark, folder), ["close", "volume", "future_price"]).selectExpr(
        "instrument", DAY, *fx("close_scaled volume_scaled"), f"{fixed_text('future_price_scaled')} AS future_scaled"
    ),
    with_(*BASE, select=f"SELECT instrument, {day()} AS day, {rx('close_scaled volume_scaled future_scaled')} FROM scaled"),
)


def _numeric(spark: SparkSession, folder: str) -> DataFrame:
    frame = _target(spark, folder)
    kept = features.numeric_columns(frame)
    return frame.selectExpr("instrument", DAY, *sorted(kept))


register(
    "numeric_feature_columns",
    _numeric,
    with_(*BASE, select=f"SELECT instrument, {day()} AS day, open, high, low, close, volume, future_price FROM target"),
)


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    scaled = features.min_max_scaled(_target(spark, folder), ["close", "volume", "future_price"])
    return features.sequences(scaled, ["close_scaled", "volume_scaled"], "future_price_scaled")


SAMPLES = """samples AS (SELECT instrument, ts, close, pos - 60 AS sample, m - 60 AS samples, m AS prepared,
  lag(close_scaled) OVER (PARTITION BY instrument ORDER BY pos) AS x, future_scaled AS y, pos FROM scaled QUALIFY pos > 60)"""
register(
    "sliding_sequences",
    lambda spark, folder: features.chronological_split(_sequences(spark, folder)).selectExpr(
        "instrument", DAY, "bigint(sample) AS sample", "bigint(size(sequence)) AS steps", "part",
        f"{fixed_text('sequence[0][0]')} AS first_close", f"{fixed_text('sequence[59][1]')} AS last_volume", f"{fixed_text('label')} AS label",
        f"{fixed_text('aggregate(flatten(sequence), 0D, (t, v) -> t + v)', 4)} AS total",
    ),
    with_(
        *BASE,
        select=f"""SELECT instrument, {day()} AS day, pos - 60 AS sample, CAST(60 AS BIGINT) AS steps, CASE WHEN pos - 60 <= floor((m - 60) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part,
  {r('lag(close_scaled, 60) OVER o')} AS first_close, {r('lag(volume_scaled) OVER o')} AS last_volume, {r('future_scaled')} AS label,
  {r('sum(close_scaled + volume_scaled) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)', 4)} AS total
  FROM scaled WINDOW o AS (PARTITION BY instrument ORDER BY pos) QUALIFY pos > 60""",
    ),
)

# ---- closed-form models
FIT = """fit AS (SELECT instrument, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM samples WHERE sample <= floor(samples * CAST(0.9 AS DOUBLE)) GROUP BY instrument),
scored AS (SELECT s.*, slope, intercept, slope * x + intercept AS prediction, sample <= floor(samples * CAST(0.9 AS DOUBLE)) AS is_train FROM samples s JOIN fit USING (instrument))"""
TRAINED = """points AS (SELECT instrument, count(*) AS data_points FROM bars GROUP BY instrument),
trained AS (SELECT p.instrument, data_points, slope, intercept, train_samples, val_samples, train_loss, val_loss, val_accuracy,
  CASE WHEN data_points < 100 THEN 'Insufficient data' WHEN data_points - 1 < 80 THEN 'Not enough data after preprocessing'
    WHEN coalesce(k, 0) < 20 THEN 'Not enough sequences' END AS message
  FROM points p LEFT JOIN (SELECT instrument, max(slope) AS slope, max(intercept) AS intercept, max(samples) AS k, count(*) FILTER (is_train) AS train_samples,
    count(*) FILTER (NOT is_train) AS val_samples, avg((y - prediction) * (y - prediction)) FILTER (is_train) AS train_loss,
    avg((y - prediction) * (y - prediction)) FILTER (NOT is_train) AS val_loss,
    avg(CAST((y > 0.5) = (prediction > 0.5) AS DOUBLE)) FILTER (NOT is_train) * 100 AS val_accuracy FROM scored GROUP BY instrument) s USING (instrument))"""
MODEL = [*BASE, SAMPLES, FIT, TRAINED]


def _trained(spark: SparkSession, folder: str, grain: str = "week") -> DataFrame:
    return models.train(bindings.series(spark, folder, grain))


def _validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = models.samples(bindings.series(spark, folder))
    fitted = models.LeastSquares().fit(rows.filter(models.is_train(0.9)), BY)
    return models.LeastSquares().score(rows, fitted, BY).filter(~models.is_train(0.9))


register(
    "trained_models",
    lambda spark, folder: _trained(spark, folder).selectExpr(
        "instrument", "status", "data_points", "train_samples", "val_samples", *fx("slope intercept train_loss val_loss", 5), *fx("val_accuracy", 2)
    ),
    with_(
        *MODEL,
        select=f"SELECT instrument, CASE WHEN message IS NULL THEN 'success' ELSE 'error' END AS status, data_points, train_samples, val_samples, {rx('slope intercept train_loss val_loss', 5)}, {rx('val_accuracy', 2)} FROM trained",
    ),
)
register(
    "training_gates",
    lambda spark, folder: _trained(spark, folder, "month").selectExpr("instrument", "status", "coalesce(message, '') AS message", "data_points"),
    with_(
        PLACES, TICKS, bars("month"), *MODEL[3:],
        select="SELECT instrument, CASE WHEN message IS NULL THEN 'success' ELSE 'error' END AS status, coalesce(message, '') AS message, data_points FROM trained",
    ),
)
register(
    "batch_training_status",
    lambda spark, folder: models.batch_status(_trained(spark, folder)),
    with_(*MODEL, select="SELECT count(*) AS total, count(*) FILTER (message IS NULL) AS successful, count(*) FILTER (message IS NOT NULL) AS failed FROM trained"),
)


def _next_value(spark: SparkSession, folder: str) -> DataFrame:
    series = bindings.series(spark, folder)
    out = models.next_value(series, models.train(series))
    return out.withColumns(simple_signal(F.col("prediction"))).selectExpr("instrument", "current_price", *fx("prediction", 5), "signal", *fx("confidence", 3))


register(
    "next_value_prediction",
    _next_value,
    with_(
        *MODEL,
        "latest AS (SELECT instrument, close_scaled AS x FROM scaled WHERE pos = m)",
        "price AS (SELECT instrument, arg_max(close, ts) AS current_price FROM bars GROUP BY instrument)",
        "p AS (SELECT instrument, current_price, slope * x + intercept AS prediction FROM latest JOIN trained USING (instrument) JOIN price USING (instrument) WHERE message IS NULL)",
        select=f"SELECT instrument, current_price, {rx('prediction', 5)}, CASE WHEN prediction > 0.5 THEN 'BUY' ELSE 'SELL' END AS signal, {r('abs(prediction - 0.5) * 200', 3)} AS confidence FROM p",
    ),
)
register(
    "regression_metrics",
    lambda spark, folder: _validation(spark, folder).groupBy("instrument").agg(*models.regression_metrics(F.col("y"), F.col("prediction"))).selectExpr(
        "instrument", *fx("mse mae rmse", 5), *fx("mape direction_accuracy", 2)
    ),
    with_(
        *MODEL,
        "m AS (SELECT instrument, avg((y - prediction) * (y - prediction)) AS mse, avg(abs(y - prediction)) AS mae, sqrt(avg((y - prediction) * (y - prediction))) AS rmse, avg(abs((y - prediction) / nullif(y, 0))) * 100 AS mape, avg(CAST((y > 0.5) = (prediction > 0.5) AS DOUBLE)) * 100 AS direction_accuracy FROM scored WHERE NOT is_train GROUP BY instrument)",
        select=f"SELECT instrument, {rx('mse mae rmse', 5)}, {rx('mape direction_accuracy', 2)} FROM m",
    ),
)
CLASSES = "avg_all AS (SELECT {key}, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM cut GROUP BY {key})"
CLASS_OUT = ", ".join(
    f"{r(f'coalesce(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0), 0) * 100', 4)} AS {name}"
    for name, top, bottom in (("accuracy", "tp + tn", "tp + fp + fn + tn"), ("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("f1_score", "2 * tp", "2 * tp + fp + fn"))
)
register(
    "classification_metrics",
    lambda spark, folder: models.classification_metrics(_validation(spark, folder), BY, F.col("y"), F.col("prediction")).selectExpr(
        "instrument", "tp", "fp", "fn", "tn", *fx("accuracy precision recall f1_score", 4)
    ),
    with_(*MODEL, "cut AS (SELECT instrument, y > 0.5 AS a, prediction > 0.5 AS p FROM scored WHERE NOT is_train)", CLASSES.format(key="instrument"), select=f"SELECT instrument, tp, fp, fn, tn, {CLASS_OUT} FROM avg_all"),
)


def _label_metrics(spark: SparkSession, folder: str) -> DataFrame:
    joined = bindings.table(spark, folder, "labels").join(bindings.table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = models.classification_metrics(joined, ["lang"], F.col("quality"), (F.col("n_chars") > 2000).cast("int"))
    return out.selectExpr("lang", "tp", "fp", "fn", "tn", *fx("accuracy precision recall f1_score", 4))


register(
    "label_classification_metrics",
    _label_metrics,
    with_(
        "cut AS (SELECT lang, quality > 0.5 AS a, n_chars > 2000 AS p FROM labels JOIN documents USING (doc_id))", CLASSES.format(key="lang"),
        select=f"SELECT lang, tp, fp, fn, tn, {CLASS_OUT} FROM avg_all",
    ),
)
MEMBERS = ["blend", "line", "last_value"]


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """A sample ensemble of two simple members, the fitted line and the last value, under two of the weights; the other members are absent."""
    absent = F.lit(None).cast("double")
    parts = {"lstm": absent, "rf": F.col("prediction"), "gb": F.col("x"), "lgbm": absent, "catboost": absent}
    return _validation(spark, folder).withColumns({"blend": models.blend(parts), "blend_full": models.blend(parts, renormalise=True), "line": F.col("prediction"), "last_value": F.col("x")})


ENSEMBLE_SQL = """members AS (SELECT *, CAST(0.15 AS DOUBLE) * prediction + CAST(0.15 AS DOUBLE) * x AS blend FROM scored WHERE NOT is_train)"""
register(
    "ensemble_blend",
    lambda spark, folder: _members(spark, folder).selectExpr("instrument", DAY, *fx("blend blend_full", 5)),
    with_(*MODEL, ENSEMBLE_SQL, select=f"SELECT instrument, {day()} AS day, {rx('blend', 5)}, {r('blend / CAST(0.3 AS DOUBLE)', 5)} AS blend_full FROM members"),
)
register(
    "ensemble_member_metrics",
    lambda spark, folder: models.member_metrics(_members(spark, folder), MEMBERS, "y").selectExpr("member", *fx("mse mae rmse", 5), *fx("direction_accuracy", 2)),
    with_(
        *MODEL, ENSEMBLE_SQL,
        "long AS (SELECT 'blend' AS member, y, blend AS q FROM members UNION ALL SELECT 'line', y, prediction FROM members UNION ALL SELECT 'last_value', y, x FROM members)",
        "m AS (SELECT member, avg((y - q) * (y - q)) AS mse, avg(abs(y - q)) AS mae, sqrt(avg((y - q) * (y - q))) AS rmse, avg(CAST((y > 0.5) = (q > 0.5) AS DOUBLE)) * 100 AS direction_accuracy FROM long GROUP BY member)",
        select=f"SELECT member, {rx('mse mae rmse', 5)}, {rx('direction_accuracy', 2)} FROM m",
    ),
)

# ---- ledger and risk: the prediction is RSI / 100
PREDICTION = "coalesce(rsi / CAST(100 AS DOUBLE), CAST(0.5 AS DOUBLE))"


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    frame = indicators(bindings.series(spark, folder), ["rsi"])
    scored = frame.withColumn("prediction", F.expr("coalesce(rsi / 100D, 0.5D)"))
    return scored.select("instrument", "ts", "pos", "n", F.col("close").alias("price"), "prediction", trading_signal(F.col("prediction")).alias("signal"))


def _book(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.ledger(_signals(spark, folder), BY)


def book_sql(key: str, initial: float = 10000, cost: float = 0.001) -> str:
    """CTEs from `sig` (key, pos, n, price, signal) to `book`, by plain windows over whole series."""
    w = f"(PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    b = f"(PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    c, keep = f"CAST({cost} AS DOUBLE)", f"CAST({1 - cost} AS DOUBLE)"
    return f"""k1 AS (SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER {w}, 0) = 1 AS holding,
  coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER {b}, 0) AS was FROM sig),
k2 AS (SELECT *, signal = 1 AND was <> 1 AS buy, signal = -1 AND was = 1 AS sell FROM k1),
k3 AS (SELECT *, last_value(CASE WHEN buy THEN price END IGNORE NULLS) OVER {w} AS entry, count(*) FILTER (buy) OVER {w} AS trade_no FROM k2),
k4 AS (SELECT *, CASE WHEN sell THEN price / entry * {keep} - {c} ELSE CAST(1 AS DOUBLE) END AS f FROM k3),
k5 AS (SELECT *, {initial} * product(f) OVER {w} AS capital, {initial} * coalesce(product(f) OVER {b}, 1) AS capital_before FROM k4),
k6 AS (SELECT *, CASE WHEN holding THEN capital * (price / entry - {c}) ELSE capital END AS equity FROM k5),
k7 AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY {key} ORDER BY pos), {initial}) AS equity_before, greatest({initial}, max(equity) OVER {w}) AS peak FROM k6),
book AS (SELECT *, equity / equity_before - 1 AS ret, (equity - peak) / peak AS drawdown,
  CASE WHEN sell OR (holding AND pos = n) THEN capital_before * (price / entry * {keep} - {c} - 1) END AS profit,
  CASE WHEN holding THEN capital * (price / entry * {keep} - {c}) ELSE capital END AS closed FROM k7)"""


SIG = f"""sig AS (SELECT instrument, ts, pos, n, close AS price, {PREDICTION} AS prediction,
  CASE WHEN {PREDICTION} > CAST(0.52 AS DOUBLE) THEN 1 WHEN {PREDICTION} < CAST(1 - 0.52 AS DOUBLE) THEN -1 ELSE 0 END AS signal FROM ind)"""
BOOK = [*weekly(), *indicator_chain(), SIG, book_sql("instrument")]

register(
    "trading_signals",
    lambda spark, folder: _signals(spark, folder).selectExpr("instrument", DAY, *fx("prediction"), "bigint(signal) AS signal"),
    with_(*BOOK, select=f"SELECT instrument, {day()} AS day, {rx('prediction')}, CAST(signal AS BIGINT) AS signal FROM sig"),
)
register(
    "signal_shares",
    lambda spark, folder: models.signal_shares(_signals(spark, folder), BY).selectExpr("instrument", "buys", "sells", "holds", *fx("buy_share sell_share hold_share", 4)),
    with_(
        *BOOK,
        "c AS (SELECT instrument, count(*) FILTER (signal = 1) AS buys, count(*) FILTER (signal = -1) AS sells, count(*) FILTER (signal = 0) AS holds, CAST(count(*) AS DOUBLE) AS total FROM sig GROUP BY instrument)",
        select=f"SELECT instrument, buys, sells, holds, {r('buys / total * 100', 4)} AS buy_share, {r('sells / total * 100', 4)} AS sell_share, {r('holds / total * 100', 4)} AS hold_share FROM c",
    ),
)
register(
    "trade_list",
    lambda spark, folder: ledger.trades(_book(spark, folder), BY).selectExpr("instrument", "bigint(trade_no) AS trade_no", "type", "bigint(index) AS index", "price", *fx("shares amount", 4), f"{fixed_text('profit', 4)} AS profit"),
    with_(
        *BOOK,
        f"""t AS (SELECT *, 'BUY' AS type, capital_before * CAST(1.001 AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS gain FROM book WHERE buy
  UNION ALL SELECT *, 'SELL', price * capital_before / entry * CAST(0.999 AS DOUBLE), profit FROM book WHERE sell
  UNION ALL SELECT *, 'SELL (final)', price * capital_before / entry * CAST(0.999 AS DOUBLE), profit FROM book WHERE holding AND pos = n)""",
        select=f"SELECT instrument, trade_no, type, pos - 1 AS index, price, {r('capital_before / entry', 4)} AS shares, {r('amount', 4)} AS amount, {r('gain', 4)} AS profit FROM t",
    ),
)
register(
    "round_trips",
    lambda spark, folder: ledger.round_trips(_book(spark, folder), BY).selectExpr(
        "instrument", "bigint(trade_no) AS trade_no", "bigint(entry_index) AS entry_index", "entry_price", "bigint(exit_index) AS exit_index", "exit_price", *fx("profit", 4), "bigint(closed_at_end) AS closed_at_end"
    ),
    with_(
        *BOOK,
        select=f"""SELECT instrument, trade_no, max(CASE WHEN buy THEN pos - 1 END) AS entry_index, max(CASE WHEN buy THEN price END) AS entry_price,
  max(CASE WHEN profit IS NOT NULL THEN pos - 1 END) AS exit_index, max(CASE WHEN profit IS NOT NULL THEN price END) AS exit_price, {r('max(profit)', 4)} AS profit,
  CAST(bool_or(holding AND pos = n) AS BIGINT) AS closed_at_end FROM book WHERE buy OR profit IS NOT NULL GROUP BY instrument, trade_no""",
    ),
)
register(
    "capital_path",
    lambda spark, folder: _book(spark, folder).selectExpr("instrument", DAY, "bigint(holding) AS holding", "bigint(trade_no) AS trade_no", *fx("capital", 4)),
    with_(*BOOK, select=f"SELECT instrument, {day()} AS day, CAST(holding AS BIGINT) AS holding, trade_no, {rx('capital', 4)} FROM book"),
)
register(
    "equity_curve",
    lambda spark, folder: ledger.equity_curve(_book(spark, folder), BY).selectExpr("instrument", "point", *fx("equity", 4)),
    with_(*BOOK, select=f"SELECT instrument, pos AS point, {rx('equity', 4)} FROM book UNION ALL SELECT DISTINCT instrument, 0, CAST(10000 AS DOUBLE) FROM book"),
)
register(
    "drawdowns",
    lambda spark, folder: _book(spark, folder).selectExpr("instrument", DAY, *fx("peak", 4), f"{fixed_text('(equity - peak) / peak')} AS drawdown"),
    with_(*BOOK, select=f"SELECT instrument, {day()} AS day, {rx('peak', 4)}, {rx('drawdown')} FROM book"),
)
TOTALS = """totals AS (SELECT {key}, max(CASE WHEN pos = n THEN closed END) AS final_capital, count(*) FILTER (profit > 0) AS profitable_trades, count(*) FILTER (profit <= 0) AS losing_trades,
  max(CASE WHEN pos = 1 THEN price END) AS p1, max(CASE WHEN pos = n THEN price END) AS pn, avg(ret) AS mean, stddev_pop(ret) AS sd, stddev_pop(ret) FILTER (ret < -1e-12) AS down,
  least(min(drawdown), 0) * 100 AS max_drawdown FROM book GROUP BY {key}),
res AS (SELECT *, (final_capital - 10000) / 10000 * 100 AS total_return, profitable_trades + losing_trades AS total_trades,
  coalesce(CAST(profitable_trades AS DOUBLE) / nullif(CAST(profitable_trades + losing_trades AS DOUBLE), 0) * 100, 0) AS win_rate, (pn - p1) / p1 * 100 AS buy_and_hold_return,
  CASE WHEN sd > 0 THEN (mean - CAST(0.02 AS DOUBLE) / 252) / sd * sqrt(CAST(252 AS DOUBLE)) ELSE 0 END AS sharpe_ratio,
  CASE WHEN down > 0 THEN (mean - CAST(0.02 AS DOUBLE) / 252) / down * sqrt(CAST(252 AS DOUBLE)) ELSE 0 END AS sortino_ratio, sd * sqrt(CAST(252 AS DOUBLE)) * 100 AS volatility FROM totals)"""
register(
    "strategy_totals",
    lambda spark, folder: ledger.results(_book(spark, folder), BY).selectExpr(
        "instrument", "bigint(total_trades) AS total_trades", "bigint(profitable_trades) AS profitable_trades", "bigint(losing_trades) AS losing_trades",
        *fx("final_capital total_return win_rate buy_and_hold_return outperformance", 4),
    ),
    with_(
        *BOOK, TOTALS.format(key="instrument"),
        select=f"SELECT instrument, total_trades, profitable_trades, losing_trades, {rx('final_capital total_return win_rate buy_and_hold_return', 4)}, {r('total_return - buy_and_hold_return', 4)} AS outperformance FROM res",
    ),
)
register(
    "strategy_risk",
    lambda spark, folder: ledger.results(_book(spark, folder), BY).selectExpr("instrument", *fx("sharpe_ratio sortino_ratio volatility max_drawdown calmar_ratio", 4)),
    with_(
        *BOOK, TOTALS.format(key="instrument"),
        select=f"SELECT instrument, {rx('sharpe_ratio sortino_ratio volatility max_drawdown', 4)}, {r('CASE WHEN max_drawdown <> 0 THEN total_return / abs(max_drawdown) ELSE 0 END', 4)} AS calmar_ratio FROM res",
    ),
)

# ---- walk-forward folds on daily bars
FOLD = ["instrument", "fold"]


def _fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows of all folds; the folds' accuracy, their ledgers and the summary all read them."""
    samples = models.samples(bindings.series(spark, folder, "day")).persist()
    return models.walk_forward(samples).persist()


def _fold_results(rows: DataFrame) -> DataFrame:
    wish = trading_signal(F.col("prediction"), 0.55, 0.45)
    signals = rows.select(*FOLD, "pos", "n", F.col("close").alias("price"), wish.alias("signal"))
    money = ledger.results(ledger.ledger(signals, FOLD), FOLD).select(*FOLD, "final_capital", F.col("total_return").alias("return_pct"))
    same = ((F.col("y") > 0.5) == (F.col("prediction") > 0.5)).cast("double")
    accuracy = rows.groupBy(*FOLD).agg(F.max("train_end").alias("train_end"), F.max("test_end").alias("test_end"), (F.avg(same) * 100).alias("accuracy"))
    return accuracy.join(money, FOLD)


FOLDS = [
    PLACES, TICKS, bars("day"), indexed(), TARGET, SCALED, SAMPLES,
    """lines AS (SELECT instrument, sample AS train_end, (sample - 252) // 21 + 1 AS fold, regr_slope(y, x) OVER w AS slope, regr_intercept(y, x) OVER w AS intercept, samples
  FROM samples WINDOW w AS (PARTITION BY instrument ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) QUALIFY sample >= 252 AND (sample - 252) % 21 = 0)""",
    """tests AS (SELECT s.*, fold, train_end, slope * x + intercept AS prediction FROM lines l JOIN samples s ON s.instrument = l.instrument
  AND s.sample > train_end AND s.sample <= train_end + 63 WHERE train_end + 63 <= l.samples)""",
    """sig AS (SELECT instrument || '/' || fold AS series, instrument, fold, train_end, y, prediction, close AS price, sample - train_end AS pos, 63 AS n,
  CASE WHEN prediction > CAST(0.55 AS DOUBLE) THEN 1 WHEN prediction < CAST(0.45 AS DOUBLE) THEN -1 ELSE 0 END AS signal FROM tests)""",
    book_sql("series"),
    """folds AS (SELECT instrument, fold, max(train_end) AS train_end, max(train_end) + 63 AS test_end, avg(CAST((y > 0.5) = (prediction > 0.5) AS DOUBLE)) * 100 AS accuracy,
  max(CASE WHEN pos = n THEN closed END) AS final_capital FROM book GROUP BY instrument, fold)""",
]
register(
    "walk_forward_folds",
    lambda spark, folder: _fold_results(_fold_rows(spark, folder)).selectExpr(
        "instrument", "fold", "bigint(train_end) AS train_end", "bigint(test_end) AS test_end", *fx("accuracy final_capital return_pct", 3)
    ),
    with_(*FOLDS, select=f"SELECT instrument, fold, train_end, test_end, {rx('accuracy final_capital', 3)}, {r('(final_capital - 10000) / 10000 * 100', 3)} AS return_pct FROM folds"),
)


def _fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _fold_rows(spark, folder)
    out = models.walk_forward_summary(_fold_results(rows), rows)
    return out.selectExpr("instrument", "total_folds", *fx("avg_accuracy avg_return total_return buy_and_hold_return outperformance", 3))


register(
    "walk_forward_summary",
    _fold_summary,
    with_(
        *FOLDS,
        """s AS (SELECT f.instrument, total_folds, avg_accuracy, avg_return, total_return, (pn / p1 - 1) * 100 AS buy_and_hold_return FROM
  (SELECT instrument, count(*) AS total_folds, avg(accuracy) AS avg_accuracy, avg((final_capital - 10000) / 10000 * 100) AS avg_return, arg_max((final_capital - 10000) / 10000 * 100, fold) AS total_return FROM folds GROUP BY instrument) f
  JOIN (SELECT instrument, arg_max(close, sample) AS pn, arg_min(close, sample) AS p1 FROM tests GROUP BY instrument) t USING (instrument))""",
        select=f"SELECT instrument, total_folds, {rx('avg_accuracy avg_return total_return buy_and_hold_return', 3)}, {r('total_return - buy_and_hold_return', 3)} AS outperformance FROM s",
    ),
)


def _binned_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = models.walk_forward(models.samples(bindings.series(spark, folder, "day")), model=models.BinnedMeans())
    metrics = models.regression_metrics(F.col("y"), F.col("prediction"))
    return rows.groupBy(*FOLD).agg(F.max("train_end").alias("train_end"), F.count("prediction").alias("tests"), *metrics)


register(
    "walk_forward_of_binned_means",
    lambda spark, folder: _binned_folds(spark, folder).selectExpr("instrument", "fold", "bigint(train_end) AS train_end", "tests", *fx("rmse mae direction_accuracy", 4)),
    with_(
        *FOLDS[:7],
        "binned AS (SELECT *, greatest(least(CAST(floor(x * 10) AS BIGINT), 9), 0) AS bin FROM samples)",
        "ends AS (SELECT instrument, sample AS train_end, (sample - 252) // 21 + 1 AS fold FROM samples WHERE sample >= 252 AND (sample - 252) % 21 = 0 AND sample + 63 <= samples)",
        "learnt AS (SELECT e.instrument, fold, bin, avg(y) AS mean FROM ends e JOIN binned b ON b.instrument = e.instrument AND sample <= train_end WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)",
        "overall AS (SELECT e.instrument, fold, avg(y) AS mean FROM ends e JOIN binned b ON b.instrument = e.instrument AND sample <= train_end WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)",
        """tests AS (SELECT b.instrument, e.fold, train_end, y, CASE WHEN x IS NOT NULL THEN coalesce(l.mean, o.mean) END AS prediction FROM ends e
  JOIN binned b ON b.instrument = e.instrument AND sample > train_end AND sample <= train_end + 63 JOIN overall o ON o.instrument = e.instrument AND o.fold = e.fold
  LEFT JOIN learnt l ON l.instrument = e.instrument AND l.fold = e.fold AND l.bin = b.bin)""",
        """measured AS (SELECT instrument, fold, max(train_end) AS train_end, count(prediction) AS tests, sqrt(avg((y - prediction) * (y - prediction))) AS rmse, avg(abs(y - prediction)) AS mae,
  avg(CAST((y > 0.5) = (prediction > 0.5) AS DOUBLE)) * 100 AS direction_accuracy FROM tests GROUP BY instrument, fold)""",
        select=f"SELECT instrument, fold, train_end, tests, {rx('rmse mae direction_accuracy', 4)} FROM measured",
    ),
)
