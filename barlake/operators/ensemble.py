"""Ensembles of fitted members: any MLlib regressors over one vector column, lined up per sample, blended and evaluated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Transformer
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators.models import BLEND, blend, gradient_boosting, member_metrics, random_forest

#: Names of the columns that members read and the stop rule looks at.
FEATURES, LABEL, HELD = "features", "label", "held_out"


def linear(**settings):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(**{"featuresCol": FEATURES, "labelCol": LABEL, "regParam": 0.01, "elasticNetParam": 0.0, **settings})


def boosting_with_stop(**settings):
    """Gradient boosting that stops when the held-out samples get no better."""
    return gradient_boosting(**{"validationIndicatorCol": HELD, "validationTol": 0.001, **settings})


def default_members() -> dict[str, Estimator]:
    return {"rf": random_forest(), "gb": boosting_with_stop()}


def fit_members(train: DataFrame, members: Mapping[str, Estimator] | None = None, held_share: float = 0.1) -> dict[str, Transformer]:
    """Fit every member on the samples (instrument, sample, features, label) of all instruments together.

    The last `held_share` of each series' training samples are marked as held out: members with a stop rule fit on the others
    and stop by these; members without one fit on all. Each member writes its prediction under its own name.
    """
    members = dict(members or default_members())
    rows = train.join(train.groupBy("instrument").agg(F.max("sample").alias("_last")), "instrument")
    marked = rows.withColumn(HELD, F.col("sample") > F.floor(F.col("_last") * (1 - held_share))).select(FEATURES, LABEL, HELD)
    return {name: estimator.copy({estimator.predictionCol: name}).fit(marked) for name, estimator in members.items()}


def member_predictions(samples: DataFrame, fitted: Mapping[str, Transformer]) -> DataFrame:
    """One column per member. All of them are scored on the same row, so nothing is joined."""
    for model in fitted.values():
        samples = model.transform(samples)
    return samples


def ensemble_predictions(samples: DataFrame, fitted: Mapping[str, Transformer], weights: Mapping[str, float] = BLEND, renormalise: bool = True) -> DataFrame:
    """The members' columns and `ensemble`, their weighted sum. Weights of members that are not there count only without `renormalise`."""
    scored = member_predictions(samples, fitted)
    return scored.withColumn("ensemble", blend({name: F.col(name) for name in fitted}, weights, renormalise))


def evaluate(scored: DataFrame, fitted: Mapping[str, Transformer]) -> DataFrame:
    """Errors and direction accuracy of every member and of the ensemble."""
    return member_metrics(scored, [*fitted, "ensemble"], LABEL)


def save_members(fitted: Mapping[str, Transformer], path: str) -> None:
    """Each member in a folder of its own; a member that is there is replaced."""
    for name, model in fitted.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_members(spark: SparkSession, names: Sequence[str], path: str) -> dict[str, Transformer]:
    """Saved members under their names, of whatever class they are."""
    return {name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", spark) for name in names}
