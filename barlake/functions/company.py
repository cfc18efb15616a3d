"""Fundamental scores and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.functions.numeric import clamp, fixed

# Fixed values: (column, [(test, points, text)]) - the first test that holds counts. Margin, return on equity and growth
# are in percent, debt to equity in percent units.
RULES = (
    ("pe_ratio", (("< 15", 10, "Low PE (+10)"), ("< 25", 5, "Fair PE (+5)"), ("> 40", -10, "High PE (-10)"))),
    ("profit_margin", (("> 20", 10, "High margin (+10)"), ("> 10", 5, "Good margin (+5)"), ("< 0", -15, "Negative margin (-15)"))),
    ("roe", (("> 20", 10, "High ROE (+10)"), ("> 10", 5, "Good ROE (+5)"), ("< 0", -10, "Negative ROE (-10)"))),
    ("debt_to_equity", (("< 50", 5, "Low debt (+5)"), ("> 200", -10, "High debt (-10)"))),
    ("revenue_growth", (("> 15", 10, "High growth (+10)"), ("> 5", 5, "Moderate growth (+5)"), ("< -5", -10, "Declining revenue (-10)"))),
)
BASE_SCORE = 50


def _first_rule(column: str, tests, part: int) -> Column:
    return F.coalesce(*[F.when(F.expr(f"{column} {test}"), F.lit((points, text)[part])) for test, points, text in tests])


def score() -> Column:
    """0 to 100 from the five metrics; missing metrics do not count."""
    points = sum((F.coalesce(_first_rule(c, tests, 0), F.lit(0)) for c, tests in RULES), F.lit(BASE_SCORE))
    return clamp(points, 0, 100).cast("long")


def factors() -> Column:
    """Array of the reasons behind the score, in rule order."""
    return F.filter(F.array(*[_first_rule(c, tests, 1) for c, tests in RULES]), lambda text: text.isNotNull())


def rating(points: Column) -> Column:
    return F.when(points >= 75, "Strong Buy").when(points >= 60, "Buy").when(points >= 40, "Hold").when(points >= 25, "Sell").otherwise("Strong Sell")


def _part(x: str, before: str, after: str) -> Column:
    c = F.col(x)
    return F.when(c.isNotNull() & (c != 0), F.concat(F.lit(before), F.format_string("%.1f", fixed(c, 1)), F.lit(after)))


def summary_line(points: Column) -> Column:
    """Rating with score, then P/E, margin and ROE where they are known and not 0, parted by ' | '."""
    head = F.concat(F.lit("Overall rating: "), rating(points), F.lit(" (score: "), points.cast("string"), F.lit("/100)"))
    return F.concat_ws(" | ", head, _part("pe_ratio", "P/E ", ""), _part("profit_margin", "Margin ", "%"), _part("roe", "ROE ", "%"))
