"""Readers and writers. Schemas are stated, never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = "instrument string, ts timestamp, open double, high double, low double, close double, volume double"
MONTH = "bar_month"
NEWS_ITEM = "title string, source string, pubDate string, link string"
CONFIG = "sequence_length int, n_features int, model_name string, architecture string"
HISTORY = "train_loss array<double>, val_loss array<double>"


def _by_month(bars: DataFrame) -> DataFrame:
    """Month folders hold a bounded share of the data each, whatever one instrument's share is; the rows are spread
    over files by month and instrument."""
    return bars.withColumn(MONTH, F.date_format("ts", "yyyy-MM"))


def write_bars(bars: DataFrame, path: str, mode: str = "append", form: str = "parquet") -> None:
    writer = _by_month(bars).write.partitionBy(MONTH).mode(mode)
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def read_bars(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, form: str = "parquet") -> DataFrame:
    """Bars from `since` (inclusive) to `until` (exclusive), as yyyy-MM-dd; only the month folders in between are read."""
    reader = spark.read.schema(f"{BARS}, {MONTH} string")
    bars = reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)
    if since is not None:
        bars = bars.filter((F.col(MONTH) >= since[:7]) & (F.col("ts") >= F.lit(since).cast("timestamp")))
    if until is not None:
        bars = bars.filter((F.col(MONTH) <= until[:7]) & (F.col("ts") < F.lit(until).cast("timestamp")))
    return bars.drop(MONTH)


def write_extents(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Beside a bar store: the first and last time of every instrument in what is written, a few bytes each."""
    bars.groupBy("instrument").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).write.mode(mode).parquet(f"{path}-extents")


def read_extents(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, first_ts, last_ts) over all writes to a store."""
    parts = spark.read.schema("instrument string, first_ts timestamp, last_ts timestamp").parquet(f"{path}-extents")
    return parts.groupBy("instrument").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def read_period(spark: SparkSession, path: str, months: int, form: str = "parquet") -> DataFrame:
    """Bars of the last `months` months of every instrument, counted back from its own latest bar.

    The extents, not the bars, say where a period begins. They name the months of each instrument; folders of months that no
    instrument needs are not read (the driver sees the months, not the instruments).
    """
    begin = F.col("last_ts") - F.make_ym_interval(F.lit(0), F.lit(months))
    wanted = read_extents(spark, path).select("instrument", begin.alias("_begin"), "last_ts").withColumn(
        MONTH, F.explode(F.transform(F.sequence(F.trunc("_begin", "month"), F.trunc("last_ts", "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM")))
    )
    reader = spark.read.schema(f"{BARS}, {MONTH} string")
    bars = reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)
    needed = [r[0] for r in wanted.select(MONTH).distinct().collect()]  # as many as the calendar has
    return bars.filter(F.col(MONTH).isin(needed)).join(wanted.drop("last_ts"), [MONTH, "instrument"]).filter(F.col("ts") >= F.col("_begin")).drop(MONTH, "_begin")


def bars_of(bars: DataFrame, instruments: Sequence[str] | DataFrame) -> DataFrame:
    """Bars of the named instruments: a list becomes a filter that reaches the scan, a frame a semi join."""
    if isinstance(instruments, DataFrame):
        return bars.join(instruments.select("instrument"), "instrument", "left_semi")
    return bars.filter(F.col("instrument").isin(*instruments))


def read_news_xml(spark: SparkSession, path: str) -> DataFrame:
    """RSS dumps: one row per <item>, missing parts as empty text."""
    items = spark.read.format("xml").option("rowTag", "item").schema(NEWS_ITEM).load(path)
    return items.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in (("title", "title"), ("source", "source"), ("pubDate", "date"), ("link", "url"))])


def write_news_xml(news: DataFrame, path: str, mode: str = "overwrite") -> None:
    """RSS dumps of (title, source, pubDate, link): items in a channel, missing parts left out."""
    news.select("title", "source", "pubDate", "link").write.mode(mode).format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)


def record_frame(spark: SparkSession, record: Mapping[str, object]) -> DataFrame:
    """One row from a dictionary of scalars."""
    return spark.createDataFrame([tuple(record.values())], list(record))


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    flat.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row, times in ISO form."""
    df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append to a store of events (alerts, predictions, transactions); current state is always a view over it."""
    df.write.mode("append").parquet(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _model_of_file(suffix: str):
    return F.regexp_extract(F.input_file_name(), f"([^/]+?)(_stock_model)?{suffix}$", 1)


def read_training_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Trained models from <name>_stock_model_config.json files, defaults where a field is missing."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).option("pathGlobFilter", "*_config.json").json(folder)
    return raw.select(
        _model_of_file("_config\\.json").alias("instrument"),
        F.coalesce("architecture", F.lit("lstm_attention_v2")).alias("architecture"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
        F.coalesce("sequence_length", F.lit(60)).alias("sequence_length"),
    )


def write_training_configs(configs: DataFrame, path: str, mode: str = "append") -> None:
    """Configurations (instrument, and the fields of CONFIG that are known), one folder per model."""
    configs.write.mode(mode).partitionBy("instrument").json(path)


def trained_models(spark: SparkSession, path: str, models: DataFrame) -> DataFrame:
    """Listing of all configured models, with defaults for missing fields; `has_model` where `models` has the instrument's parameters."""
    raw = spark.read.schema(f"{CONFIG}, instrument string").json(path)
    listed = raw.select(
        "instrument", F.coalesce("architecture", F.lit("lstm_attention_v2")).alias("architecture"), F.coalesce("n_features", F.lit(0)).alias("n_features"),
        F.coalesce("sequence_length", F.lit(60)).alias("sequence_length"),
    )
    stored = models.select("instrument").distinct().withColumn("has_model", F.lit(True))
    return listed.join(stored, "instrument", "left").withColumn("has_model", F.coalesce("has_model", F.lit(False)))


def read_training_histories(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.schema(HISTORY).option("multiLine", True).option("pathGlobFilter", "*_history.json").json(folder)
    return raw.select(_model_of_file("_history\\.json").alias("model"), "train_loss", "val_loss")
