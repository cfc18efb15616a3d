"""Round trips through files and stores in the shared work folder, training curves and the verification run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed
from barlake.operators.models import loss_curve
from barlake.operators.news import clean_news, first_articles
from barlake.operators.periods import MONTHS
from barlake.plans import model_queries
from barlake.plans.indicator_queries import DAY
from barlake.plans.registry import register
from barlake.plans.sqltext import PLACES, TICKS, bars, day, r, weekly, with_
from barlake.plans.state_queries import ALERTS_SQL, NEWS_SQL, ORDERS_SQL, PREDICTED
from barlake.session import work_dir
from barlake.sources import bindings, files
from barlake.streaming import live

BAR = ("open", "high", "low", "close", "volume")


def _place(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, folder: str, form: str) -> str:
    path = _place(spark, f"bars-{form}")
    files.write_bars(bindings.bars(spark, folder, "day").drop("sector"), path, form=form)
    return path


for form in ("parquet", "csv"):
    register(
        f"stored_bars_{form}",
        lambda spark, folder, form=form: files.read_bars(spark, _stored(spark, folder, form), "1995-06-15", "1996-02-10", form).selectExpr("instrument", DAY, *BAR),
        with_(PLACES, TICKS, bars("day"), select=f"SELECT instrument, {day()} AS day, {', '.join(BAR)} FROM bars WHERE ts >= TIMESTAMP '1995-06-15' AND ts < TIMESTAMP '1996-02-10'"),
    )


def _exported(spark: SparkSession, folder: str, form: str) -> DataFrame:
    path, schema = _place(spark, f"export-{form}"), "instrument string, day string, bar string"
    rows = bindings.bars(spark, folder).select("instrument", F.expr(DAY), F.struct("close", "volume").alias("bar"))
    if form == "csv":
        files.export_csv(rows, path)
        back = spark.read.schema(schema).option("header", True).option("escape", "\\").csv(path)
    else:
        files.export_json(rows, path)
        back = spark.read.schema(schema).json(path)
    field = lambda x: F.get_json_object("bar", f"$.{x}").cast("double").alias(x)
    return back.select("instrument", "day", field("close"), field("volume"))


for form in ("csv", "json"):
    register(f"exported_{form}", lambda spark, folder, form=form: _exported(spark, folder, form), with_(*weekly(), select=f"SELECT instrument, {day()} AS day, close, volume FROM bars"))


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """Alert events appended in two writes and read as one store."""
    events = bindings.alert_events(spark, folder)
    path, schema = _place(spark, "store"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    for action in ("create", "remove"):
        files.append_records(events.filter(F.col("action") == action), path)
    return files.read_records(spark, path, schema).groupBy("instrument", "action").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


register("record_store", _store, with_(
    PLACES, ORDERS_SQL, ALERTS_SQL.replace(" WHERE status <> 'P'", ""),
    """alert_events AS (SELECT instrument, 'create' AS action, value FROM alerts UNION ALL SELECT a.instrument, 'remove', value FROM alerts a JOIN orders_by_place o ON o.id = a.id AND o.status = 'P')""",
    select="SELECT instrument, action, count(*) AS events, sum(value) AS value FROM alert_events GROUP BY instrument, action",
))

# a curve per event type: the largest value of each day as that epoch's loss
CURVES_SQL = """curves AS (SELECT event_type AS model, day, max(value) AS loss, row_number() OVER (PARTITION BY event_type ORDER BY day) AS epoch
  FROM (SELECT event_type, value, CAST(ts AS DATE) AS day FROM events) GROUP BY event_type, day),
running AS (SELECT *, min(loss) OVER (PARTITION BY model ORDER BY epoch) AS low FROM curves),
since AS (SELECT *, epoch - (SELECT min(c.epoch) FROM curves c WHERE c.model = running.model AND c.loss = running.low) AS waited FROM running)"""


def _curves(spark: SparkSession, folder: str) -> DataFrame:
    daily = bindings.table(spark, folder, "events").groupBy(F.col("event_type").alias("model"), F.to_date("ts").alias("day")).agg(F.max("value").alias("val_loss"))
    return loss_curve(daily.withColumn("epoch", F.unix_date("day")), 5)


register(
    "loss_curves",
    _curves,
    with_(
        CURVES_SQL,
        select="""SELECT model, count(*) AS epochs, min(loss) AS best_loss, arg_min(epoch, (loss, epoch)) AS best_epoch, arg_max(loss, epoch) AS last_loss,
  min(epoch) FILTER (waited >= 5) AS stop_epoch FROM since GROUP BY model""",
    ),
)


def _verification(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "verification")
    bindings.bars(spark, folder).write.parquet(f"{path}/bars")
    stored = spark.read.parquet(f"{path}/bars")
    arriving = spark.readStream.schema(stored.schema).parquet(f"{path}/bars")
    live.verification_run(arriving, bindings.predictions(spark, folder), stored, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("id", "instrument", "signal", fixed("return_pct", 2).alias("return_pct"), F.col("correct").cast("long").alias("correct"))


register("verification_run", _verification, with_(*PREDICTED, select=f"SELECT id, instrument, signal, {r('return_pct', 2)} AS return_pct, CAST(correct AS BIGINT) AS correct FROM checked WHERE verified"))


def _feeds(spark: SparkSession, folder: str) -> DataFrame:
    """News written as feeds and read again: the ten newest items of each source; every fifth has no link."""
    path = _place(spark, "feeds")
    items = bindings.news(spark, folder).select(
        F.concat(F.lit("Article <"), "doc", F.lit("> & more")).alias("title"), F.col("instrument").alias("source"), F.date_format("published", "yyyy-MM-dd").alias("pubDate"),
        F.when(F.col("doc") % 5 != 0, F.concat(F.lit("https://news.example/"), "doc")).alias("link"),
    )
    files.write_news_xml(items, path)
    read = clean_news(files.read_news_xml(spark, path))
    doc = F.regexp_extract("title", "[0-9]+", 0).cast("long")
    rows = read.select(F.col("source").alias("instrument"), F.to_timestamp("date").alias("published"), doc.alias("doc"), "title", "url", "date")
    return first_articles(rows, 10).select("instrument", F.col("place").cast("long").alias("place"), "title", "url", "date")


register(
    "news_from_feeds",
    _feeds,
    with_(
        *NEWS_SQL[:2],
        select="""SELECT instrument, place, 'Article <' || doc || '> & more' AS title, CASE WHEN doc % 5 <> 0 THEN 'https://news.example/' || doc ELSE '' END AS url, strftime(published, '%Y-%m-%d') AS date
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY published DESC, doc) AS place FROM news) WHERE place <= 10""",
    ),
)


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations of all instruments written as files; fields are missing for some, parameters are there for those that trained."""
    path, trained = _place(spark, "configs"), model_queries._trained(spark, folder)
    count = F.col("data_points")
    known = trained.select(
        "instrument", F.when(count % 2 == 0, F.lit(30)).alias("sequence_length"), F.when(count % 3 != 0, F.lit(2)).alias("n_features"), F.when(count % 5 == 0, F.lit("line")).alias("architecture")
    )
    files.write_training_configs(known, path)
    return files.trained_models(spark, path, trained.filter("status = 'success'"))


register(
    "trained_model_listing",
    _listing,
    with_(
        *model_queries.MODEL,
        select="""SELECT instrument, CASE WHEN data_points % 5 = 0 THEN 'line' ELSE 'lstm_attention_v2' END AS architecture, CASE WHEN data_points % 3 <> 0 THEN 2 ELSE 0 END AS n_features,
  CASE WHEN data_points % 2 = 0 THEN 30 ELSE 60 END AS sequence_length, message IS NULL AS has_model FROM trained""",
    ),
)


def _stored_period(spark: SparkSession, folder: str) -> DataFrame:
    path, daily = _place(spark, "bars-period"), bindings.bars(spark, folder, "day").drop("sector")
    files.write_bars(daily, path)
    files.write_extents(daily, path)
    return files.read_period(spark, path, MONTHS["1y"]).selectExpr("instrument", DAY, *BAR)


register(
    "stored_bars_of_last_year",
    _stored_period,
    with_(
        PLACES, TICKS, bars("day"),
        select=f"""SELECT instrument, {day()} AS day, {', '.join(BAR)} FROM bars JOIN (SELECT instrument, max(ts) AS last_ts FROM bars GROUP BY instrument) USING (instrument)
  WHERE ts >= last_ts - INTERVAL 12 MONTH""",
    ),
)
