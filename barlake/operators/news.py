"""Headline sentiment per instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed
from barlake.functions.text import Lexicon, hits, label, sentiment, words


def clean_news(raw: DataFrame) -> DataFrame:
    """Missing title, source or url become the empty text."""
    return raw.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "source", "url") if c in raw.columns})


def first_articles(news: DataFrame, n: int = 20) -> DataFrame:
    """The newest n articles of each instrument; ties by `doc`."""
    newest = Window.partitionBy("instrument").orderBy(F.desc("published"), "doc")
    return news.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def scored_articles(news: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Articles with points, score to 3 decimals, label and confidence. Stays on the row: no shuffle."""
    tokens = news.withColumn("_words", words(F.col("title")))
    points = tokens.withColumns(hits(F.col("title"), F.col("_words"), lexicon)).drop("_words")
    out = points.withColumns(sentiment(F.col("bullish"), F.col("bearish")))
    return out.withColumns({"score": fixed("score", 3), "confidence": fixed("confidence", 1)})


def news_sentiment(scored: DataFrame) -> DataFrame:
    """Counts by label, mean score, overall label at 0.1 and agreement per instrument."""
    of = lambda what: F.count_if(F.col("label") == what)
    counted = scored.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("article_count"), of("bullish").alias("bullish_count"), of("bearish").alias("bearish_count"), of("neutral").alias("neutral_count"),
        F.sum(F.round(F.col("score") * 1000).cast("long")).alias("_points"),
    )
    mean = F.col("_points") / 1000.0 / F.col("article_count")
    agreement = F.greatest("bullish_count", "bearish_count", "neutral_count") / F.col("article_count") * 100
    return counted.withColumns({"overall": label(mean, 0.1), "score": fixed(mean, 3), "confidence": fixed(agreement, 1)}).drop("_points")


def with_sentiment(instruments: DataFrame, rolled: DataFrame) -> DataFrame:
    """Every instrument; those without news are neutral with score 0."""
    joined = instruments.join(rolled, "instrument", "left")
    return joined.withColumns({"overall": F.coalesce("overall", F.lit("neutral")), "score": F.coalesce("score", F.lit(0.0)), "article_count": F.coalesce("article_count", F.lit(0))})
