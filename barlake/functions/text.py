"""Lexicon sentiment of texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default lexicon. A term with a space is looked for as a phrase and counts double.
BULLISH = (
    "surge", "soar", "rally", "boom", "breakout", "record high", "all-time high",
    "upgrade", "outperform", "buy", "strong buy", "bullish", "beat", "beats",
    "exceeded", "exceeds", "profit", "growth", "revenue", "innovation",
    "rise", "gain", "up", "higher", "positive", "optimistic", "recovery",
    "partnership", "expansion", "launch", "approval", "deal", "contract",
    "dividend", "buyback", "boost", "momentum", "strength", "demand",
)
BEARISH = (
    "crash", "plunge", "collapse", "tumble", "slump", "sell-off", "panic",
    "downgrade", "underperform", "sell", "bearish", "miss", "misses",
    "lawsuit", "fraud", "investigation", "ban", "recall", "bankruptcy",
    "fall", "drop", "decline", "down", "lower", "negative", "concern",
    "risk", "loss", "debt", "warning", "cut", "reduction", "layoff",
    "competition", "threat", "slowdown", "inflation", "recession", "tariff",
)


@dataclass(frozen=True)
class Lexicon:
    """Terms by polarity. It travels inside the plan as literals, which suits a word list; `table_hits` takes a table of any size."""

    bullish: Sequence[str] = BULLISH
    bearish: Sequence[str] = BEARISH

    def __post_init__(self) -> None:
        if len(self.bullish) + len(self.bearish) > 10000:
            raise ValueError("a lexicon of more than 10000 terms belongs in a table: see table_hits")


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def _hits(text: Column, tokens: Column, terms: Sequence[str]) -> Column:
    single = [t for t in terms if " " not in t]
    phrases = [t for t in terms if " " in t]
    found = F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in single]))) if single else F.lit(0)
    lower = F.lower(text)
    return sum((F.when(lower.contains(p), 2).otherwise(0) for p in phrases), found)


def hits(text: Column, tokens: Column, lexicon: Lexicon = Lexicon()) -> dict[str, Column]:
    """Bullish and bearish points of a text whose `words` are already in a column."""
    return {"bullish": _hits(text, tokens, lexicon.bullish).cast("long"), "bearish": _hits(text, tokens, lexicon.bearish).cast("long")}


def table_hits(texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, bullish, bearish) for every row, by a lexicon of any size: a table (term, polarity). `key` names rows uniquely.

    Words of a text meet the terms of one word, and runs of 2, 3, ... words those of as many words, as far as the
    lexicon goes, each run once per text. The terms are joined by equality, so neither side is
    collected and Spark broadcasts the lexicon only while it is small. A phrase counts 2 points, a word 1.
    """
    terms = lexicon.select(F.lower("term").alias("term"), "polarity").distinct()
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    listed = texts.select(F.col(key).alias("_key"), F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)).alias("_words"))
    runs = lambda n: F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.array_join(F.slice("_words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    found = listed.select("_key", F.explode(F.array_distinct(F.concat(*[runs(n) for n in range(1, longest + 1)]))).alias("term")).join(terms, "term")
    points = F.when(F.contains("term", F.lit(" ")), 2).otherwise(1)
    sums = found.groupBy("_key").agg(*[F.sum(F.when(F.col("polarity") == p, points).otherwise(0)).alias(p) for p in ("bullish", "bearish")])
    joined = texts.select(F.col(key).alias("_key")).join(sums, "_key", "left")
    return joined.select(F.col("_key").alias(key), *[F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in ("bullish", "bearish")])


def label(score: Column, cut: float) -> Column:
    return F.when(score > cut, "bullish").when(score < -cut, "bearish").otherwise("neutral")


def sentiment(bullish: Column, bearish: Column) -> dict[str, Column]:
    """Score from -1 to 1, its label, and confidence in percent (5 points make 100)."""
    total = (bullish + bearish).cast("double")
    score = F.coalesce(F.try_divide((bullish - bearish).cast("double"), total), F.lit(0.0))
    return {"score": score, "label": label(score, 0.15), "confidence": F.least(total / 5, F.lit(1.0)) * 100}
