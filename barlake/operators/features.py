"""Targets, scaling, sequences and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.operators.series import BLOCK_ROWS, index_rows, with_blocks

SEQUENCE = 60


def with_target(bars: DataFrame, by: Sequence[str] = ("instrument",), ahead: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the close `ahead` bars later and whether it is higher; the last `ahead` rows of a series have none and go.

    `n` counts the rows that stay. The look ahead runs on the series turned round, so that blocks see later rows.
    """
    indexed = bars if {"pos", "n"} <= set(bars.columns) else index_rows(bars, by)
    turned = with_blocks(indexed.withColumn("pos", F.col("n") + 1 - F.col("pos")), block_rows, ahead)
    order = Window.partitionBy(*by, "block").orderBy("pos")
    later = turned.withColumn("future_price", F.lag("close", ahead).over(order)).filter(~F.col("is_halo") & F.col("future_price").isNotNull())
    return later.withColumns(
        {
            "price_direction": (F.col("future_price") > F.col("close")).cast("int"),
            "pos": F.col("n") + 1 - F.col("pos"),
            "n": F.col("n") - ahead,
        }
    ).drop("block", "is_halo")


def numeric_columns(df: DataFrame, without: Sequence[str] = ("price_direction", "pos", "n")) -> list[str]:
    """Names of the numeric columns of the schema that are not in the deny list."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def min_max_scaled(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("instrument",), fit_on=None) -> DataFrame:
    """Columns scaled to 0..1 per series as `<name>_scaled`; a constant column becomes 0. `fit_on`, a condition, keeps
    the limits free of later rows (by default the whole series counts)."""
    value = lambda x: F.col(x) if fit_on is None else F.when(fit_on, F.col(x))
    limits = df.groupBy(*by).agg(*[f(value(x)).alias(f"_{name}_{x}") for x in columns for name, f in (("low", F.min), ("high", F.max))])
    spread = lambda x: F.col(f"_high_{x}") - F.col(f"_low_{x}")
    scaled = {
        f"{x}_scaled": F.when(spread(x) == 0, F.lit(0.0)).otherwise((F.col(x) - F.col(f"_low_{x}")) / F.nullif(spread(x), F.lit(0.0))) for x in columns
    }
    return df.join(limits, list(by)).withColumns(scaled).drop(*[c for c in limits.columns if c not in by])


def sequences(
    df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ("instrument",), length: int = SEQUENCE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For each row with `length` rows before it: those rows' features as an array of arrays, the row's own label, and
    the sample number (1, 2, ...) and count of the series. Multiplies the data by `length`: use it last."""
    order = Window.partitionBy(*by, "block").orderBy("pos").rowsBetween(-length, -1)
    window = with_blocks(df, block_rows, length).withColumn("sequence", F.collect_list(F.array(*[F.col(f) for f in features])).over(order))
    return window.filter(~F.col("is_halo") & (F.col("pos") > length)).select(
        *by, "ts", (F.col("pos") - length).alias("sample"), (F.col("n") - length).alias("samples"), "sequence", F.col(label).alias("label")
    )


def chronological_split(samples: DataFrame, fraction: float = 0.8) -> DataFrame:
    """'train' for the first int(samples * fraction) samples of a series, 'test' for the rest."""
    return samples.withColumn("part", F.when(F.col("sample") <= F.floor(F.col("samples") * fraction), "train").otherwise("test"))


def flat_vectors(samples: DataFrame) -> DataFrame:
    """The sequence as one dense vector for MLlib."""
    from pyspark.ml.functions import array_to_vector

    return samples.withColumn("features", array_to_vector(F.flatten("sequence")))
