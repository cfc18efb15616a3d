"""Fundamental records from raw company information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.company import factors, rating, score, summary_line
from barlake.functions.numeric import fraction_to_percent, plain_text

# Groups of the record. Each field names its source column; those in PERCENT are fractions there.
GROUPS = {
    "valuation": {"peg_ratio": "pegRatio", "price_to_book": "priceToBook", "price_to_sales": "priceToSalesTrailing12Months", "ev_to_ebitda": "enterpriseToEbitda"},
    "profitability": {
        "profit_margin": "profitMargins", "gross_margin": "grossMargins", "operating_margin": "operatingMargins", "roe": "returnOnEquity",
        "roa": "returnOnAssets", "revenue_growth": "revenueGrowth", "earnings_growth": "earningsGrowth",
    },
    "financial_health": {
        "debt_to_equity": "debtToEquity", "current_ratio": "currentRatio", "quick_ratio": "quickRatio", "free_cash_flow": "freeCashflow",
        "total_cash": "totalCash", "total_debt": "totalDebt",
    },
    "per_share": {"eps_trailing": "trailingEps", "eps_forward": "forwardEps", "book_value": "bookValue", "dividend_per_share": "dividendRate"},
    "size": {"market_cap": "marketCap", "enterprise_value": "enterpriseValue", "shares_outstanding": "sharesOutstanding", "float_shares": "floatShares"},
    "dividends": {"dividend_yield": "dividendYield", "payout_ratio": "payoutRatio", "ex_dividend_date": "exDividendDate"},
    "analysts": {
        "target_mean_price": "targetMeanPrice", "target_high_price": "targetHighPrice", "target_low_price": "targetLowPrice",
        "recommendation": "recommendationKey", "number_of_analysts": "numberOfAnalystOpinions",
    },
}
PERCENT = {
    "profit_margin", "gross_margin", "operating_margin", "roe", "roa", "revenue_growth", "earnings_growth", "dividend_yield", "payout_ratio",
}
TEXTS = {"ex_dividend_date", "recommendation"}
#: Texts that are empty, not missing, where the source has none: they stay in the record.
NEVER_MISSING = {"ex_dividend_date"}
COMPARED = ("pe_ratio", "peg_ratio", "price_to_book", "ev_to_ebitda", "profit_margin", "roe", "revenue_growth")
FIELDS = {field: source for group in GROUPS.values() for field, source in group.items()}


def fundamentals(info: DataFrame) -> DataFrame:
    """One flat row per instrument with every field (missing source columns are null), percent where due, the score,
    rating, factors and summary. The price-earnings ratio is the trailing one, or the forward one where that is 0 or missing."""
    have = set(info.columns)
    raw = lambda source: F.col(source) if source in have else F.lit(None)
    cell = lambda field, source: (
        F.coalesce(raw(source).cast("string"), F.lit("")) if field in NEVER_MISSING else raw(source).cast("string") if field in TEXTS else fraction_to_percent(raw(source).cast("double")) if field in PERCENT else raw(source).cast("double")
    )
    trailing = F.nullif(raw("trailingPE").cast("double"), F.lit(0.0))
    flat = info.select(
        "instrument", F.coalesce(raw("longName"), F.col("instrument")).alias("name"), F.coalesce(raw("sector"), F.lit("N/A")).alias("sector"),
        F.coalesce(raw("industry"), F.lit("N/A")).alias("industry"), F.coalesce(trailing, raw("forwardPE").cast("double")).alias("pe_ratio"),
        raw("trailingPE").cast("double").alias("_trailing_pe"), *[cell(field, source).alias(field) for field, source in FIELDS.items()],
    )
    scored = flat.withColumns({"score": score(), "factors": factors()})
    return scored.withColumns({"rating": rating(F.col("score")), "summary": summary_line(F.col("score"))})


def grouped_record(flat: DataFrame) -> DataFrame:
    """The record with one map of text per group, without missing values, numbers to 2 decimals."""

    def shown(field: str):
        text = F.col(field) if field in TEXTS else plain_text(field, 2)
        return F.struct(F.lit(field).alias("key"), text.alias("value"))

    def group(name: str):
        fields = (["pe_ratio"] if name == "valuation" else []) + list(GROUPS[name])
        return F.map_filter(F.map_from_entries(F.array(*[shown(f) for f in fields])), lambda _, v: v.isNotNull()).alias(name)

    return flat.select("instrument", "name", "sector", "industry", *[group(g) for g in GROUPS], "score", "rating", "factors", "summary")


def valuation_comparison(flat: DataFrame, instruments: Sequence[str] | None = None) -> DataFrame:
    """Seven metrics of the named instruments, or of all; here the price-earnings ratio is the trailing one only."""
    chosen = flat if instruments is None else flat.filter(F.col("instrument").isin(*instruments))
    return chosen.select("instrument", *[(F.col("_trailing_pe") if c == "pe_ratio" else F.col(c)).alias(c) for c in COMPARED])
