"""Numeric helpers and the display formats of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column | str, dp: int = 6) -> Column:
    """Round half up by `floor(x * 10^dp + 0.5) / 10^dp`: the same double operations in every SQL engine."""
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10**dp)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def change(x: Column, before: Column) -> Column:
    """Relative change from `before` to `x`."""
    return ratio(x, before) - F.lit(1.0)


def fraction_to_percent(x: Column) -> Column:
    """0.1234 -> 12.34, null stays null."""
    return fixed(x * F.lit(100.0), 2)


def clamp(x: Column, low: float, high: float) -> Column:
    """x kept inside low..high; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def gauge_position(x: Column, low: Column, high: Column) -> Column:
    """Marker position on a gauge from 0 to 100."""
    return clamp(ratio(x - low, high - low) * F.lit(100.0), 0.0, 100.0)


def implied_open(current: Column, change_: Column) -> Column:
    return current - change_


def _text(x: Column, dp: int) -> Column:
    return F.format_string(f"%.{dp}f", fixed(x, dp))


def plain_text(x: Column | str, dp: int = 2) -> Column:
    """`fixed` as digits without an exponent, whatever the size; zeros at the end go, one decimal stays: 15729095.58, 2.5, 3.0."""
    digits = fixed(x, dp).cast(f"decimal(38,{dp})").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")


def magnitude(x: Column, dp: int = 2) -> Column:
    """Short text for large amounts: $1.50T, $2.25B, 3.1M, otherwise plain with `dp` decimals; null is '--'."""
    size = F.abs(x)
    return (
        F.when(x.isNull(), F.lit("--"))
        .when(size >= 1e12, F.concat(F.lit("$"), _text(x / 1e12, 2), F.lit("T")))
        .when(size >= 1e9, F.concat(F.lit("$"), _text(x / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(_text(x / 1e6, 1), F.lit("M")))
        .otherwise(_text(x, dp))
    )


def market_cap_text(x: Column) -> Column:
    """Market value in the company header: always with $ and a unit."""
    return (
        F.when(x >= 1e12, F.concat(F.lit("$"), _text(x / 1e12, 2), F.lit("T")))
        .when(x >= 1e9, F.concat(F.lit("$"), _text(x / 1e9, 2), F.lit("B")))
        .otherwise(F.concat(F.lit("$"), _text(x / 1e6, 0), F.lit("M")))
    )


def fixed_text(x: str, dp: int = 6) -> str:
    """`fixed` as text for `selectExpr`."""
    scale = f"1{'0' * dp}D"
    return f"double(floor(({x}) * {scale} + 0.5D)) / {scale}"
