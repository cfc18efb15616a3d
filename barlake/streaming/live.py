"""Live quotes, bars, alerts and verification as Structured Streaming queries.

A query hands every micro-batch to a writer that puts it in a folder of its own (`batch=<id>`). A batch that is run
again after a failure overwrites its folder, so results are exactly once; readers take the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barlake.operators.monitor import first_triggers, verify_predictions
from barlake.operators.resample import ohlcv
from barlake.operators.series import index_rows
from barlake.session import materialise

TICK = "instrument string, ts timestamp, price double, volume double"
FIRED = "id long, instrument string, alert_type string, value double, triggered_at timestamp, triggered_value double"


def live_bars(ticks: DataFrame, width: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars. Ticks that come more than `late` after newer ones are dropped, and the state of closed bars
    goes then. `late=None` takes ticks in any order, as when stored files are worked off: the state is one row per bar."""
    grouped = (ticks if late is None else ticks.withWatermark("ts", late)).groupBy("instrument", F.window("ts", width).alias("bar"))
    bars = grouped.agg(*ohlcv(F.col("ts"), "price", "price", "price", "price", "volume"))
    return bars.select("instrument", F.col("bar.start").alias("ts"), "open", "high", "low", "close", "volume")


def live_quotes(ticks: DataFrame) -> DataFrame:
    """Latest price per instrument; the state is one row per instrument."""
    return ticks.groupBy("instrument").agg(F.max("ts").alias("ts"), F.max_by("price", "ts").alias("current_price"))


def with_previous_close(quotes: DataFrame, closes: DataFrame) -> DataFrame:
    """Quote with change against a static table (instrument, previous_close)."""
    joined = quotes.join(closes.select("instrument", "previous_close"), "instrument", "left").withColumn("previous_close", F.coalesce("previous_close", F.lit(0.0)))
    moved = F.col("previous_close") > 0
    change = F.col("current_price") - F.col("previous_close")
    return joined.withColumns({"change": F.when(moved, change).otherwise(0.0), "change_percent": F.when(moved, F.try_divide(change, F.col("previous_close")) * 100).otherwise(0.0)})


def to_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update", every: str | None = None, change: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Start a query that writes each micro-batch, changed by `change`, to its own folder. Without `every` it works off
    what is there and stops; with it (such as '10 seconds') it goes on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = change(batch) if change else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Write the state after all batches so far as one snapshot beside them; the last batch in it.

    Readers take the newest whole snapshot and the batches behind it, so they read as much as the state holds, however many batches
    there were. The folders of earlier batches stay; whoever owns them may remove them. A snapshot that was not written to its end
    has no success mark and is not read.
    """
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    _newest(_since(spark, path), keys).write.mode("overwrite").parquet(f"{path}-snapshots/upto={last}")
    return last


def _snapshot(spark: SparkSession, path: str) -> int | None:
    """Number of the newest whole snapshot."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-snapshots")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "upto=*/_SUCCESS")) or []
    return max((int(m.getPath().getParent().getName().split("=")[1]) for m in marks), default=None)


def _since(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot and of the batches behind it."""
    rows, upto = spark.read.parquet(path), _snapshot(spark, path)
    if upto is None:
        return rows
    kept = spark.read.schema(rows.schema).parquet(f"{path}-snapshots/upto={upto}")
    return kept.unionByName(rows.filter(F.col("batch") > upto))


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def newest_of(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """State of an update-mode query: the row of the latest batch for each key, from the newest snapshot on."""
    return _newest(_since(spark, path), keys).drop("batch")


def watchlist_updates(watched: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For `to_batches`: only quotes of the watched instruments."""
    return lambda batch: batch.join(watched.select("instrument"), "instrument", "left_semi")


def price_records(ticks: DataFrame) -> DataFrame:
    """Ticks (instrument, ts, price) that are higher or lower than all before them in their series: the only ones that
    can be the first to cross a level. A first pass by hour leaves few rows for the pass over the whole series."""

    def records(df: DataFrame, *keys) -> DataFrame:
        before = Window.partitionBy("instrument", *keys).orderBy("ts", "price").rowsBetween(Window.unboundedPreceding, -1)
        seen = df.withColumns({"_high": F.max("price").over(before), "_low": F.min("price").over(before)})
        return seen.filter(F.col("_high").isNull() | (F.col("price") > F.col("_high")) | (F.col("price") < F.col("_low"))).drop("_high", "_low")

    rows = ticks.select("instrument", "ts", "price").filter(F.col("price").isNotNull() & F.col("ts").isNotNull())
    return records(records(rows, F.date_trunc("hour", "ts"), F.floor(F.minute("ts") / 5)))


def price_alerts(ticks: DataFrame, alerts: DataFrame, path: str, checkpoint: str, every: str | None = None, key: Sequence[str] = ("id",)) -> StreamingQuery:
    """Fire price alerts (key columns, instrument, alert_type, value) on a stream of ticks, each at most once.

    A batch is reduced to its records, new highs and lows. Alerts that its extremes fire, and that no earlier batch has
    written, look up their first record by levels (`monitor.first_triggers`): no alert meets the ticks. What has fired is
    kept by alert, so a batch reads only the keys of earlier firings.
    """
    spark = ticks.sparkSession
    names = list(dict.fromkeys([*key, "instrument", "alert_type", "value"]))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alerts.select(*names).schema.fields)
    schema = f"{fields}, triggered_at timestamp, triggered_value double"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        steps = materialise(price_records(batch))
        reach = steps.groupBy("instrument").agg(F.max("price").alias("_high"), F.min("price").alias("_low"))
        fires = F.expr("(alert_type = 'price_above' AND _high > value) OR (alert_type = 'price_below' AND _low < value)")
        before = batch.sparkSession.read.schema(schema + ", batch long").parquet(path).filter(F.col("batch") < batch_id).select(*key)
        due = alerts.select(*names).join(reach, "instrument").filter(fires).join(before, list(key), "left_anti")
        asked = due.withColumns({"id": F.struct(*key), "created_at": F.lit("1970-01-01").cast("timestamp")}).select("id", "instrument", "alert_type", "value", "created_at")
        bars = index_rows(steps.select("instrument", "ts", F.col("price").alias("close"), F.lit(None).cast("double").alias("rsi")), ("instrument",), ("ts", "close"))
        fired = first_triggers(asked, bars).filter("triggered")
        rows = fired.select(*[F.col("id").getField(k).alias(k) if k in key else k for k in names], "triggered_at", "triggered_value")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def verification_run(new_bars: DataFrame, predictions: DataFrame, all_bars: DataFrame, path: str, checkpoint: str, days: int = 5) -> StreamingQuery:
    """Scheduled run: when bars have arrived since the last one, write the predictions that can now be verified and
    were not before."""
    spark = new_bars.sparkSession
    columns = verify_predictions(predictions.limit(0), all_bars.limit(0), days).schema
    spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema(columns.add("batch", "long")).parquet(path).filter(F.col("batch") < batch_id).select("id")
        touched = batch.select("instrument").distinct()
        pending = predictions.join(known, "id", "left_anti").join(touched, "instrument", "left_semi")
        verify_predictions(pending, all_bars, days).filter("verified").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return new_bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
