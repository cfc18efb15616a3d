"""As-of join at any skew: no key, no day and no moment is bounded to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.series import running
from barlake.session import materialise


def asof_join(
    left: DataFrame,
    right: DataFrame,
    value: str,
    by: Sequence[str] = ("instrument",),
    left_on: str = "ts",
    right_on: str = "ts",
    direction: str = "backward",
    partitions: int | None = None,
) -> DataFrame:
    """Add to each left row the `value` of the last right row at or before its time (`backward`), or of the first one
    at or after it (`forward`); null without one, or where the left row has no key or no time.

    Only keys, times and values are sorted. Both sides are first reduced to one row per key and moment (of several right
    rows at one moment the largest value counts, nulls none), then cut at the quantiles of (key, time), so a key or a day that
    holds all rows spreads over all parts; what a part needs from the parts before it comes from a table with one row per key and part.
    The left rows look their moment up in the result.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    sign = 1 if direction == "backward" else -1
    by = list(by)
    kind = right.schema[value].dataType
    # at one moment right rows come before left ones
    moment = lambda at, side: (F.unix_micros(at) * (2 * sign) + side).alias("_order")
    asked = left.select(*by, moment(left_on, 1), F.lit(None).cast(kind).alias("_value"))
    given = right.select(*by, moment(right_on, 0), F.col(value).alias("_value"))
    moments = materialise(asked.unionByName(given).dropna(subset=[*by, "_order"]).groupBy(*by, "_order").agg(F.max("_value").alias("_value")))
    ranged = moments.repartitionByRange(partitions, *by, "_order") if partitions else moments.repartitionByRange(*by, "_order")
    parts = materialise(ranged.withColumn("_part", F.spark_partition_id()))
    known = running(parts, by, {"_found": ("last", F.col("_value"))}, block="_part", order="_order")
    found = known.filter(F.pmod("_order", F.lit(2)) == 1).select(*by, "_order", F.col("_found").alias(value))
    return left.withColumn("_order", moment(left_on, 1)).join(found, [*by, "_order"], "left").select(*left.columns, value)
