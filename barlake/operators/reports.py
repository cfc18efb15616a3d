"""One nested report per instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BACKTEST = ("total_return", "win_rate", "sharpe_ratio", "max_drawdown", "total_trades")


def reports(predictions: DataFrame, signals: DataFrame, results: DataFrame) -> DataFrame:
    """instrument, prediction, signals and five figures of the backtest as structs, and the whole as JSON text."""
    part = lambda df, name, columns: df.select("instrument", F.struct(*columns).alias(name))
    other = lambda df: [c for c in df.columns if c != "instrument"]
    joined = (
        part(predictions, "prediction", other(predictions))
        .join(part(signals, "signals", other(signals)), "instrument", "left")
        .join(part(results, "backtest", BACKTEST), "instrument", "left")
    )
    return joined.withColumn("report", F.to_json(F.struct("instrument", "prediction", "signals", "backtest"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}))


def training_progress(trained: DataFrame) -> DataFrame:
    """'done (xx.x%)' or 'error: reason' per instrument of a training run."""
    text = F.when(F.col("status") == "success", F.concat(F.lit("done ("), F.format_string("%.1f", F.floor(F.col("val_accuracy") * 10 + 0.5) / 10), F.lit("%)")))
    return trained.select("instrument", "status", text.otherwise(F.concat(F.lit("error: "), F.coalesce("message", F.lit("unknown")))).alias("progress"))
