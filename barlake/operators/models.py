"""Models per instrument, their evaluation, blends and walk-forward folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.features import SEQUENCE, min_max_scaled, with_target
from barlake.operators.series import BLOCK_ROWS, index_rows, own_block, running, with_blocks
from barlake.session import materialise

# Least rows for training, and blend weights of the ensemble members.
LEAST_BARS, LEAST_PREPARED, LEAST_SEQUENCES = 100, 80, 20
BLEND = {"lstm": 0.30, "rf": 0.15, "gb": 0.15, "lgbm": 0.20, "catboost": 0.20}


class Model(Protocol):
    """A model fitted for all series at once: `fit` gives one row of parameters per series, `score` adds `prediction`."""

    def fit(self, samples: DataFrame, by: Sequence[str]) -> DataFrame: ...

    def score(self, samples: DataFrame, parameters: DataFrame, by: Sequence[str]) -> DataFrame: ...


class Mergeable(Model, Protocol):
    """A model whose parameters follow from sums over its samples, so that fits of growing sets of samples are running sums."""

    def sums(self) -> dict[str, Column]: ...

    def parameters(self) -> dict[str, Column]: ...


class LeastSquares:
    """y = slope * x + intercept, in closed form per series."""

    def sums(self) -> dict[str, Column]:
        x, y = F.col("x"), F.col("y")
        whole = x.isNotNull() & y.isNotNull()
        return {name: F.when(whole, value) for name, value in {"_n": F.lit(1.0), "_x": x, "_y": y, "_xx": x * x, "_xy": x * y}.items()}

    def parameters(self) -> dict[str, Column]:
        slope = "try_divide(_n * _xy - _x * _y, _n * _xx - _x * _x)"
        return {"slope": F.expr(slope), "intercept": F.expr(f"(_y - {slope} * _x) / _n")}

    def fit(self, samples: DataFrame, by: Sequence[str]) -> DataFrame:
        return samples.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))

    def score(self, samples: DataFrame, parameters: DataFrame, by: Sequence[str]) -> DataFrame:
        return samples.join(parameters, list(by)).withColumn("prediction", F.col("slope") * F.col("x") + F.col("intercept"))


class BinnedMeans:
    """The mean label of the training samples in the same of `bins` equal parts of [0, 1] as x (beyond it: the first or last
    part); in a part without samples the mean of all. Samples without x or y do not enter, without x there is no prediction."""

    def __init__(self, bins: int = 10):
        self.bins = bins

    def _bin(self) -> Column:
        inside = F.greatest(F.least(F.floor(F.col("x") * self.bins), F.lit(self.bins - 1)), F.lit(0))
        return F.when(F.col("x").isNotNull(), inside)  # greatest and least pass over nulls

    def sums(self) -> dict[str, Column]:
        whole = F.col("x").isNotNull() & F.col("y").isNotNull()
        here = {i: whole & (self._bin() == i) for i in range(self.bins)}
        counts = {f"_n{i}": F.when(at, 1.0).otherwise(0.0) for i, at in here.items()}
        return counts | {f"_y{i}": F.when(at, F.col("y")).otherwise(0.0) for i, at in here.items()}

    def parameters(self) -> dict[str, Column]:
        total = lambda kind: reduce(lambda a, b: a + b, [F.col(f"_{kind}{i}") for i in range(self.bins)])
        mean = F.try_divide(total("y"), total("n"))
        return {"means": F.array(*[F.coalesce(F.try_divide(F.col(f"_y{i}"), F.col(f"_n{i}")), mean) for i in range(self.bins)])}

    def fit(self, samples: DataFrame, by: Sequence[str]) -> DataFrame:
        summed = samples.groupBy(*by).agg(*[F.sum(x).alias(name) for name, x in self.sums().items()])
        return summed.select(*by, *[x.alias(name) for name, x in self.parameters().items()])

    def score(self, samples: DataFrame, parameters: DataFrame, by: Sequence[str]) -> DataFrame:
        return samples.join(parameters, list(by)).withColumn("prediction", F.get("means", self._bin().cast("int")))


def samples(bars: DataFrame, by: Sequence[str] = ("instrument",), length: int = SEQUENCE) -> DataFrame:
    """x: scaled close of the last row of the sequence; y: scaled price one bar after the row that follows it."""
    scaled = min_max_scaled(with_target(bars, by), ["close", "future_price"], by)
    order = Window.partitionBy(*by, "block").orderBy("pos")
    shifted = with_blocks(scaled, BLOCK_ROWS, 1).withColumn("x", F.lag("close_scaled").over(order)).filter(~F.col("is_halo") & (F.col("pos") > length))
    return shifted.select(
        *by, "ts", "close", F.col("n").alias("prepared"), (F.col("pos") - length).alias("sample"), (F.col("n") - length).alias("samples"), "x", F.col("future_price_scaled").alias("y")
    )


def is_train(fraction: float) -> Column:
    return F.col("sample") <= F.floor(F.col("samples") * fraction)


def regression_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Errors and direction accuracy (both sides cut at one half); rows with actual 0 do not enter the percent error."""
    error = actual - predicted
    same = (actual > 0.5) == (predicted > 0.5)
    return [
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, actual))) * 100).alias("mape"),
        (F.avg(same.cast("double")) * 100).alias("direction_accuracy"),
    ]


def classification_metrics(scored: DataFrame, by: Sequence[str], actual: Column, predicted: Column) -> DataFrame:
    """Accuracy, precision, recall and F1 in percent, 0 where undefined."""
    a, p = actual > 0.5, predicted > 0.5
    counts = scored.groupBy(*by).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")
    )
    share = lambda top, bottom: f"coalesce(try_divide(double({top}), double({bottom})), 0D) * 100D"
    return counts.selectExpr(
        *by, "tp", "fp", "fn", "tn", f"{share('tp + tn', 'tp + fp + fn + tn')} AS accuracy", f"{share('tp', 'tp + fp')} AS precision",
        f"{share('tp', 'tp + fn')} AS recall", f"{share('2 * tp', '2 * tp + fp + fn')} AS f1_score",
    )


def signal_shares(signals: DataFrame, by: Sequence[str]) -> DataFrame:
    share = lambda n: f"double({n}) / double(total) * 100D"
    counted = signals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("signal") == 1).alias("buys"), F.count_if(F.col("signal") == -1).alias("sells"), F.count_if(F.col("signal") == 0).alias("holds")
    )
    return counted.selectExpr("*", f"{share('buys')} AS buy_share", f"{share('sells')} AS sell_share", f"{share('holds')} AS hold_share")


def train(bars: DataFrame, by: Sequence[str] = ("instrument",), model: Model | None = None, fraction: float = 0.9) -> DataFrame:
    """One row per instrument: status with reason, sample counts, losses, validation accuracy and the parameters."""
    model = model or LeastSquares()
    points = bars.groupBy(*by).agg(F.count(F.lit(1)).alias("data_points"))
    rows = samples(bars, by)
    parameters = model.fit(rows.filter(is_train(fraction)), by)
    scored = model.score(rows, parameters, by)
    error = F.pow(F.col("y") - F.col("prediction"), F.lit(2.0))
    same = ((F.col("y") > 0.5) == (F.col("prediction") > 0.5)).cast("double")
    outcome = scored.groupBy(*by).agg(
        F.max("samples").alias("_samples"),
        F.count_if(is_train(fraction)).alias("train_samples"),
        F.count_if(~is_train(fraction)).alias("val_samples"),
        F.avg(F.when(is_train(fraction), error)).alias("train_loss"),
        F.avg(F.when(~is_train(fraction), error)).alias("val_loss"),
        (F.avg(F.when(~is_train(fraction), same)) * 100).alias("val_accuracy"),
    )
    found = F.coalesce(F.col("_samples"), F.lit(0))
    message = (
        F.when(F.col("data_points") < LEAST_BARS, "Insufficient data")
        .when(F.col("data_points") - 1 < LEAST_PREPARED, "Not enough data after preprocessing")
        .when(found < LEAST_SEQUENCES, "Not enough sequences")
    )
    return (
        points.join(outcome, list(by), "left").join(parameters, list(by), "left")
        .withColumns({"message": message, "status": F.when(message.isNull(), "success").otherwise("error")}).drop("_samples")
    )


def batch_status(trained: DataFrame) -> DataFrame:
    """Counts of a training run."""
    return trained.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed")
    )


def next_value(bars: DataFrame, trained: DataFrame, by: Sequence[str] = ("instrument",), model: Model | None = None) -> DataFrame:
    """Prediction from the latest prepared row of each trained instrument, by the model whose parameters `trained` holds."""
    scaled = min_max_scaled(with_target(bars, by), ["close"], by).filter("pos = n").select(*by, F.col("close_scaled").alias("x"))
    price = bars.groupBy(*by).agg(F.max_by("close", "ts").alias("current_price"))
    good = trained.filter(F.col("status") == "success").drop("x")
    if model is None:
        good, model = good.select(*by, "slope", "intercept"), LeastSquares()
    return model.score(scaled, good, by).join(price, list(by))


def blend(members: Mapping[str, Column], weights: Mapping[str, float] = BLEND, renormalise: bool = False) -> Column:
    """Weighted sum of the member predictions; a missing member counts 0. The weights of those present are brought to
    sum 1 only if asked."""
    total = sum((F.coalesce(x, F.lit(0.0)) * weights[name] for name, x in members.items()), F.lit(0.0))
    if not renormalise:
        return total
    present = sum((F.when(x.isNotNull(), weights[name]).otherwise(0.0) for name, x in members.items()), F.lit(0.0))
    return F.try_divide(total, present)


def member_metrics(scored: DataFrame, members: Sequence[str], actual: str) -> DataFrame:
    """Errors and direction accuracy of each prediction column."""
    stacked = ", ".join(f"'{m}', {m}" for m in members)
    long = scored.selectExpr(actual, f"stack({len(members)}, {stacked}) AS (member, prediction)").filter("prediction is not null")
    return long.groupBy("member").agg(*regression_metrics(F.col(actual), F.col("prediction")))


#: Samples of one task of a fit, while there are fewer tasks than four a core; at most MOST_SAMPLES in one.
TASK_SAMPLES, MOST_SAMPLES = 2048, 65_536


def gathered(samples: DataFrame) -> DataFrame:
    """The same samples, checkpointed in as many partitions as their own number asks for.

    A tree fit runs hundreds of jobs with one task per partition. Samples inherit their partitions from the shuffles
    of the ticks behind them, so without this a fit of the same samples slows down as the ticks grow.
    """
    kept = samples.persist()
    n, cores = kept.count(), samples.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-n // TASK_SAMPLES), 4 * cores), -(-n // MOST_SAMPLES))
    out = materialise(kept.repartition(parts))
    kept.unpersist()
    return out


def random_forest(**settings):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(**{"featuresCol": "features", "labelCol": "label", "numTrees": 100, "maxDepth": 10, "seed": 42, **settings})


def gradient_boosting(**settings):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(**{"featuresCol": "features", "labelCol": "label", "maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": 42, **settings})


def walk_forward(rows: DataFrame, by: Sequence[str] = ("instrument",), first: int = 252, test: int = 63, step: int = 21, block_rows: int = BLOCK_ROWS, model: Model | None = None) -> DataFrame:
    """Test rows of every fold with the prediction of a model fitted to all samples before the fold.

    Fold k (1, 2, ...) trains on the first `first + (k-1) * step` samples and tests on the next `test`; only whole test
    windows count. Each row works out its own folds. Without `model` a line is fitted. A `Mergeable` model is fitted from sums: samples
    are added up by the first fold that trains on them, and the folds' sums are added up in turn, in blocks of
    `block_rows`; the work grows with the samples. Any other model is fitted fold by fold, on as many copies of a sample as there are
    folds after it, grouped by series and fold.
    """
    by, model = list(by), model or LeastSquares()
    index = "(sample - 1)"
    last = f"floor((samples - {first} - {test}) / {step}) + 1"
    newest = f"least(floor(({index} - {first}) / {step}) + 1, {last})"
    oldest = f"greatest(ceil(({index} - {first} - {test - 1}) / {step}) + 1, 1)"
    earliest = f"greatest(ceil((sample - {first}) / {step}) + 1, 1)"
    spread = lambda low, high: f"explode(if({low} <= {high}, sequence(bigint({low}), bigint({high})), array())) AS fold"
    enough = F.col("samples") >= first + test
    folded = rows.filter((F.col("sample") > first) & enough).selectExpr("*", spread(oldest, newest))
    if hasattr(model, "sums"):
        added = rows.filter(enough).withColumn("fold", F.expr(f"bigint({earliest})")).filter(F.expr(f"fold <= {last}"))
        sums = added.groupBy(*by, "fold").agg(*[F.sum(x).alias(name) for name, x in model.sums().items()])
        whole = running(sums.withColumns({"pos": F.col("fold"), "block": F.floor((F.col("fold") - 1) / F.lit(block_rows))}), by, {name: ("sum", F.col(name)) for name in model.sums()})
        fitted = whole.select(*by, "fold", *[x.alias(name) for name, x in model.parameters().items()])
    else:
        fitted = model.fit(rows.filter(enough).selectExpr("*", spread(earliest, last)), [*by, "fold"])
    scored = model.score(folded, fitted, [*by, "fold"])
    return _fold_places(scored.withColumn("train_end", F.lit(first) + (F.col("fold") - 1) * step), test)


def _fold_places(scored: DataFrame, test: int) -> DataFrame:
    """`pos`, `n` and `test_end` within the fold."""
    return scored.withColumns({"pos": F.col("sample") - F.col("train_end"), "n": F.lit(test).cast("long"), "test_end": F.col("train_end") + test})


def walk_forward_summary(folds: DataFrame, tests: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Fold count, means over folds, return of the last fold, and buy-and-hold from the first to the last test row."""
    totals = folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_folds"), F.avg("accuracy").alias("avg_accuracy"), F.avg("return_pct").alias("avg_return"), F.max_by("return_pct", "fold").alias("total_return")
    )
    held = tests.groupBy(*by).agg(((F.max_by("close", "sample") / F.min_by("close", "sample") - 1) * 100).alias("buy_and_hold_return"))
    return totals.join(held, list(by)).withColumn("outperformance", F.col("total_return") - F.col("buy_and_hold_return"))


def loss_curve(epochs: DataFrame, patience: int = 15, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per model: epochs, best and last validation loss, the best epoch, and the epoch at which training had to stop
    (`patience` epochs without a new best), from one row per epoch (keys, epoch, val_loss). Epochs without a loss are left out.

    The lowest loss so far and the epoch that set it are running values over blocks of epochs, so the work grows with the
    epochs and a curve of any length is spread over tasks.
    """
    rows = index_rows(epochs.filter("val_loss IS NOT NULL").select(*by, F.col("epoch").cast("long").alias("epoch"), "val_loss"), by, ("epoch",), F.floor(F.col("epoch") / BLOCK_ROWS))
    placed = running(rows.withColumn("block", own_block()), by, {"_low": ("min", F.col("val_loss"))}, before={"_was": "_low"})
    fresh = F.col("_was").isNull() | (F.col("val_loss") < F.col("_was"))
    since = running(placed.withColumn("_set", F.when(fresh, F.col("pos"))).drop("_low", "_was"), by, {"_best_at": ("last", F.col("_set"))})
    waited = F.col("pos") - F.col("_best_at")
    return since.groupBy(*by).agg(
        F.count(F.lit(1)).alias("epochs"), F.min("val_loss").alias("best_loss"), F.max("_best_at").alias("best_epoch"),
        F.max_by("val_loss", "pos").alias("last_loss"), F.min(F.when(waited >= patience, F.col("pos"))).alias("stop_epoch"),
    )


def epochs_of(history: DataFrame, key: str = "model") -> DataFrame:
    """One row per epoch (key, epoch, val_loss) from curves that files hold as arrays."""
    return history.select(key, F.posexplode("val_loss").alias("epoch", "val_loss"))
