"""Streaming queries run to the end of the sample data, reports and MLlib members."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed, fixed_text
from barlake.functions.votes import indicator_signals, recommendation, simple_signal
from barlake.operators import ensemble, features, ledger, models
from barlake.operators.indicators import latest_indicators
from barlake.operators.reports import reports, training_progress
from barlake.plans import model_queries as m
from barlake.plans.indicator_queries import DAY
from barlake.plans.model_queries import fx, rx
from barlake.plans.registry import register
from barlake.plans.signal_queries import RECOMMEND, SIGNAL_SQL, SIX
from barlake.plans.sqltext import day, filled, r, with_
from barlake.session import materialise, work_dir
from barlake.sources import bindings
from barlake.streaming import alerts, live

MINUTE = "date_format(ts, 'yyyy-MM-dd HH:mm') AS minute"


def _places(spark: SparkSession) -> tuple[str, str]:
    base = f"{work_dir(spark)}/live-{uuid.uuid4().hex}"
    return f"{base}/rows", f"{base}/checkpoint"


def _run(spark: SparkSession, stream: DataFrame, keys: list[str], change=None) -> DataFrame:
    path, checkpoint = _places(spark)
    live.to_batches(stream, path, checkpoint, change=change).awaitTermination()
    return live.newest_of(spark, path, keys)


register(
    "live_bars",
    lambda spark, folder: _run(spark, live.live_bars(bindings.event_stream(spark, folder), late=None), ["instrument", "ts"]).selectExpr("instrument", MINUTE, "open", "high", "low", "close", "volume"),
    """SELECT event_type AS instrument, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS minute, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts)""",
)


def _live_quotes(spark: SparkSession, folder: str) -> DataFrame:
    events = bindings.table(spark, folder, "events")
    closes = events.groupBy(F.col("event_type").alias("instrument")).agg(F.min_by("value", "ts").alias("previous_close"))
    quoted = live.with_previous_close(_run(spark, live.live_quotes(bindings.event_stream(spark, folder)), ["instrument"]), closes)
    return quoted.selectExpr("instrument", MINUTE, "current_price", "previous_close", *fx("change change_percent"))


register(
    "live_quotes",
    _live_quotes,
    f"""SELECT instrument, strftime(ts, '%Y-%m-%d %H:%M') AS minute, current_price, previous_close, {r('current_price - previous_close')} AS change, {r('(current_price - previous_close) / previous_close * 100')} AS change_percent
FROM (SELECT event_type AS instrument, max(ts) AS ts, arg_max(value, ts) AS current_price, arg_min(value, ts) AS previous_close FROM events GROUP BY 1)""",
)
register(
    "live_watchlist",
    lambda spark, folder: _run(
        spark, live.live_quotes(bindings.event_stream(spark, folder)), ["instrument"],
        live.watchlist_updates(bindings.table(spark, folder, "events").filter("event_type in ('click', 'view')").select(F.col("event_type").alias("instrument")).distinct()),
    ).selectExpr("instrument", "current_price"),
    "SELECT event_type AS instrument, arg_max(value, ts) AS current_price FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
)


def _event_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Two alerts per user and event type: at twice and at a third of the type's mean value."""
    events = bindings.table(spark, folder, "events")
    means = events.groupBy("event_type").agg(F.avg(F.round(F.col("value") * 100).cast("long")).alias("mean"))
    users = events.select("event_type", "user_id").distinct().join(means, "event_type")
    limit = F.floor(F.col("mean") * F.when(F.col("up") == 1, 2.0).otherwise(0.3)) / 100
    return users.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "user_id", "up", F.col("event_type").alias("instrument"), F.when(F.col("up") == 1, "price_above").otherwise("price_below").alias("alert_type"), limit.alias("value")
    )


def _live_alerts(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = _places(spark)
    alerts = _event_alerts(spark, folder)
    key = ("user_id", "instrument", "up")
    live.price_alerts(bindings.event_stream(spark, folder), alerts.filter("value is not null"), path, checkpoint, key=key).awaitTermination()
    fired = spark.read.parquet(path)
    return fired.selectExpr("user_id", "instrument", "alert_type", "value", "date_format(triggered_at, 'yyyy-MM-dd HH:mm') AS minute", "triggered_value")


register(
    "live_alerts",
    _live_alerts,
    """WITH means AS (SELECT event_type, avg(CAST(round(value * 100) AS BIGINT)) AS mean FROM events GROUP BY 1),
alerts AS (SELECT user_id, event_type, up, floor(mean * CASE WHEN up = 1 THEN CAST(2 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) / 100 AS value
  FROM (SELECT DISTINCT event_type, user_id FROM events) JOIN means USING (event_type), (VALUES (0), (1)) t(up))
SELECT a.user_id, a.event_type AS instrument, CASE WHEN up = 1 THEN 'price_above' ELSE 'price_below' END AS alert_type, a.value, strftime(min(ts), '%Y-%m-%d %H:%M') AS minute, arg_min(e.value, ts) AS triggered_value
FROM alerts a JOIN events e ON e.event_type = a.event_type AND ((up = 1 AND e.value > a.value) OR (up = 0 AND e.value < a.value)) GROUP BY a.user_id, a.event_type, up, a.value""",
)


def _mixed_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """One alert per user and event type: price or RSI, above or below, by the user's number."""
    priced = _event_alerts(spark, folder).filter("up = 1 - user_id % 2")
    rsi = F.expr("user_id % 4 >= 2")
    return priced.select(
        F.concat_ws("/", "user_id", "instrument").alias("id"), "instrument",
        F.when(rsi, F.when(F.col("up") == 1, "rsi_above").otherwise("rsi_below")).otherwise(F.col("alert_type")).alias("alert_type"),
        F.when(rsi, 40 + F.col("user_id") % 21).otherwise(F.col("value")).cast("double").alias("value"),
    )


def _live_mixed(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = _places(spark)
    bars = live.live_bars(bindings.event_stream(spark, folder), "1 hour", "1 hour")
    alerts.alert_run(alerts.fired_alerts(bars, _mixed_alerts(spark, folder)), path, checkpoint).awaitTermination()
    return spark.read.schema(alerts.FIRED).parquet(path).selectExpr("instrument", "id", "alert_type", "value", MINUTE.replace("ts", "triggered_at"), *fx("triggered_value"))


register(
    "live_rsi_alerts",
    _live_mixed,
    f"""WITH means AS (SELECT event_type, avg(CAST(round(value * 100) AS BIGINT)) AS mean FROM events GROUP BY 1),
alerts AS (SELECT user_id || '/' || event_type AS id, event_type AS instrument, (CASE WHEN user_id % 4 >= 2 THEN 'rsi' ELSE 'price' END) || (CASE WHEN user_id % 2 = 0 THEN '_above' ELSE '_below' END) AS alert_type,
  CASE WHEN user_id % 4 >= 2 THEN CAST(40 + user_id % 21 AS DOUBLE) ELSE floor(mean * CASE WHEN user_id % 2 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) / 100 END AS value
  FROM (SELECT DISTINCT event_type, user_id FROM events) JOIN means USING (event_type)),
bars AS (SELECT event_type AS instrument, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_max(value, ts) AS close FROM events GROUP BY 1, 2
  HAVING time_bucket(INTERVAL 1 HOUR, events.ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)),
moves AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY instrument ORDER BY ts), 0) AS move, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS pos FROM bars),
sides AS (SELECT *, avg(greatest(move, 0)) OVER w AS up, avg(greatest(-move, 0)) OVER w AS down FROM moves WINDOW w AS (PARTITION BY instrument ORDER BY ts ROWS 13 PRECEDING)),
scored AS (SELECT instrument, ts, close, CASE WHEN pos < 14 OR (up = 0 AND down = 0) THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM sides),
seen AS (SELECT a.*, ts, CASE WHEN alert_type LIKE 'rsi%' THEN rsi ELSE close END AS x FROM alerts a JOIN scored USING (instrument) WHERE a.value IS NOT NULL)
SELECT instrument, id, alert_type, value, strftime(min(ts), '%Y-%m-%d %H:%M') AS minute, {r('arg_min(x, ts)')} AS triggered_value
FROM seen WHERE (alert_type LIKE '%above' AND x > value) OR (alert_type LIKE '%below' AND x < value) GROUP BY instrument, id, alert_type, value""",
)

# ---- reports
RES = [*m.BOOK, m.TOTALS.format(key="instrument")]


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    series = bindings.series(spark, folder)
    predicted = models.next_value(series, models.train(series)).withColumns(simple_signal(F.col("prediction"))).selectExpr("instrument", *fx("prediction", 5), "signal")
    signals = latest_indicators(series, SIX, fill=True).withColumns(indicator_signals()).withColumns(recommendation())
    results = ledger.results(m._book(spark, folder), m.BY).selectExpr("instrument", "bigint(total_trades) AS total_trades", *fx("total_return win_rate sharpe_ratio max_drawdown", 4))
    out = reports(predicted, signals.select("instrument", "close", "rsi_signal", "recommendation"), results)
    pick = lambda path, kind: f"CAST(get_json_object(report, '$.{path}') AS {kind}) AS {path.split('.')[1]}"
    return out.selectExpr(
        "instrument", pick("prediction.prediction", "double"), pick("prediction.signal", "string"), pick("signals.recommendation", "string"),
        *[pick(f"backtest.{x}", "double") for x in ("total_return", "win_rate", "sharpe_ratio", "max_drawdown")], pick("backtest.total_trades", "bigint"),
    )


register(
    "instrument_reports",
    _reports,
    with_(
        *m.MODEL, *[c for c in RES if c not in m.MODEL and not c.startswith("ix AS")], filled(SIX), SIGNAL_SQL,
        "latest AS (SELECT instrument, close_scaled AS x FROM scaled WHERE pos = m)",
        "p AS (SELECT instrument, slope * x + intercept AS prediction FROM latest JOIN trained USING (instrument) WHERE message IS NULL)",
        f"rec_now AS (SELECT instrument, {RECOMMEND} FROM voted WHERE pos = n)",
        select=f"""SELECT p.instrument, {rx('prediction', 5)}, CASE WHEN prediction > 0.5 THEN 'BUY' ELSE 'SELL' END AS signal, recommendation, {rx('total_return win_rate sharpe_ratio max_drawdown', 4)}, total_trades
  FROM p LEFT JOIN rec_now USING (instrument) LEFT JOIN res USING (instrument)""",
    ),
)
register(
    "training_progress",
    lambda spark, folder: training_progress(m._trained(spark, folder)),
    with_(
        *m.MODEL,
        select=f"SELECT instrument, CASE WHEN message IS NULL THEN 'success' ELSE 'error' END AS status, CASE WHEN message IS NULL THEN 'done (' || printf('%.1f', {r('val_accuracy', 1)}) || '%)' ELSE 'error: ' || message END AS progress FROM trained",
    ),
)


# ---- tree members on flattened sequences, one model over all instruments
def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    samples = features.chronological_split(m._sequences(spark, folder), 0.9)
    return features.flat_vectors(samples).select("instrument", "ts", "part", "features", "label")


def _member(estimator):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        rows = models.gathered(_vectors(spark, folder))
        fitted = estimator().fit(rows.filter("part = 'train'").persist())
        return fitted.transform(rows.filter("part = 'test'")).selectExpr("instrument", DAY, "label", "prediction")

    return build


register("random_forest_member", _member(models.random_forest))
register("gradient_boosting_member", _member(models.gradient_boosting))


def _ensemble(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Small members, fitted on the training samples, saved, loaded again and lined up on the test samples."""
    samples = features.chronological_split(m._sequences(spark, folder), 0.9)
    rows = models.gathered(features.flat_vectors(samples).select("instrument", "ts", "part", "sample", "features", "label").filter("label is not null"))
    members = {"rf": models.random_forest(numTrees=20, maxDepth=6), "gb": ensemble.boosting_with_stop(maxIter=20, maxDepth=3), "linear": ensemble.linear()}
    path = f"{work_dir(spark)}/members-{uuid.uuid4().hex}"
    ensemble.save_members(ensemble.fit_members(rows.filter("part = 'train'"), members), path)
    fitted = ensemble.load_members(spark, list(members), path)
    scored = ensemble.ensemble_predictions(rows, fitted, {"rf": 0.15, "gb": 0.15, "linear": 0.3})
    return scored, fitted


def _ensemble_samples(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL can state about fitted members: samples, labels, a forest that stays within its labels, a blend between its members."""
    scored, _ = _ensemble(spark, folder)
    low, high = scored.filter("part = 'train'").agg(F.min("label"), F.max("label")).first()
    test, tiny = scored.filter("part = 'test'"), 1e-9
    return test.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("samples"), fixed(F.avg("label"), 5).alias("label"), F.min("ts").alias("_first"),
        F.bool_and(F.col("rf").between(low - tiny, high + tiny)).alias("forest_within_labels"),
        F.bool_and((F.col("ensemble") >= F.least("rf", "gb", "linear") - tiny) & (F.col("ensemble") <= F.greatest("rf", "gb", "linear") + tiny)).alias("blend_within_members"),
    ).select("instrument", "samples", "label", F.date_format("_first", "yyyy-MM-dd").alias("first_day"), "forest_within_labels", "blend_within_members")


register(
    "ensemble_of_fitted_members",
    _ensemble_samples,
    with_(
        *m.BASE,
        select=f"""SELECT instrument, count(*) AS samples, {r('avg(future_scaled)', 5)} AS label, strftime(min(ts), '%Y-%m-%d') AS first_day, true AS forest_within_labels, true AS blend_within_members
  FROM (SELECT *, pos - 60 <= floor((m - 60) * CAST(0.9 AS DOUBLE)) AS trains FROM scaled WHERE pos > 60) WHERE NOT trains GROUP BY instrument""",
    ),
)


def _fitted_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scored, fitted = _ensemble(spark, folder)
    return ensemble.evaluate(scored.filter("part = 'test'"), fitted).selectExpr("member", *fx("mse mae rmse", 5), *fx("direction_accuracy", 2))


register("fitted_member_metrics", _fitted_metrics)


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    values = _vectors(spark, folder).withColumn("values", vector_to_array("features"))
    return values.selectExpr("instrument", DAY, "part", "bigint(size(values)) AS width", f"{fixed_text('aggregate(values, 0D, (t, v) -> t + v)', 4)} AS total", *fx("label"))


register(
    "flat_sequence_vectors",
    _flat,
    with_(
        *m.BASE,
        select=f"""SELECT instrument, {day()} AS day, CASE WHEN pos - 60 <= floor((m - 60) * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part, CAST(120 AS BIGINT) AS width,
  {r('sum(close_scaled + volume_scaled) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)', 4)} AS total, {r('future_scaled')} AS label
  FROM scaled QUALIFY pos > 60""",
    ),
)
