"""Company directory: information, search, facets, peers and watchlists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_TEXT = ("name", "sector", "industry", "country", "website", "description")
UNKNOWN_NUMBER = ("market_cap", "employees")


def company_info(directory: DataFrame) -> DataFrame:
    """Missing texts become 'N/A', missing numbers 0."""
    texts = {c: F.coalesce(F.col(c), F.lit("N/A")) for c in UNKNOWN_TEXT if c in directory.columns}
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in UNKNOWN_NUMBER if c in directory.columns}
    return directory.withColumns({**texts, **numbers})


def in_sector(directory: DataFrame, sector: str) -> DataFrame:
    return directory if sector == "All" else directory.filter(F.col("sector") == sector)


def search(directory: DataFrame, query: str) -> DataFrame:
    """Companies whose ticker, name or sector contains the query in any case. If there is none and the query is one to
    five letters, a single row offers it as a ticker of its own."""
    text = query.lower()
    found = directory.filter(F.lower("instrument").contains(text) | F.lower("name").contains(text) | F.lower("sector").contains(text))
    found = found.select("instrument", "name", "sector")
    if not re.fullmatch("[A-Za-z]{1,5}", query.strip()):
        return found
    offered = found.agg(F.count(F.lit(1)).alias("_found")).filter("_found = 0").select(
        F.lit(query.upper()).alias("instrument"), F.lit("Not in the directory").alias("name"), F.lit("Custom").alias("sector")
    )
    return found.unionByName(offered)


def symbols(text: Column) -> Column:
    """'a, b ,,C' -> [A, B, C]."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")


def peer_quotes(wanted: DataFrame, peers: DataFrame, quotes: DataFrame, directory: DataFrame, fallback: str) -> DataFrame:
    """Peers of each wanted instrument with price, change in percent and name. Instruments without peers of their own
    take those of `fallback`; peers without a quote are left out."""
    listed = peers.select("instrument", F.col("instrument").alias("_has")).distinct()
    owner = wanted.join(listed, "instrument", "left").select("instrument", F.coalesce("_has", F.lit(fallback)).alias("_of"))
    found = owner.join(peers.select(F.col("instrument").alias("_of"), "peer"), "_of")
    named = found.join(quotes.select(F.col("instrument").alias("peer"), "current_price", "change_percent"), "peer")
    names = directory.select(F.col("instrument").alias("peer"), "name")
    return named.join(names, "peer", "left").select("instrument", "peer", F.coalesce("name", F.col("peer")).alias("name"), "current_price", "change_percent")


def watchlist_quotes(watched: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every watched instrument with its quote, nulls where there is none."""
    return watched.join(quotes.select("instrument", "current_price", "change", "change_percent"), "instrument", "left")
