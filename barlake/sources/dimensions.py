"""Reference dimensions of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sectors with their instruments in listing order, and peers.
SECTORS = {
    "Technology": ["AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "TSLA", "CRM", "ADBE", "AMD", "INTC", "ORCL", "NFLX", "AVGO", "QCOM"],
    "Finance": ["JPM", "V", "MA", "BAC", "GS", "MS", "AXP", "PYPL", "SQ"],
    "Healthcare": ["JNJ", "UNH", "PFE", "ABBV", "LLY", "MRK", "TMO", "ABT"],
    "Consumer": ["WMT", "PG", "KO", "PEP", "COST", "MCD", "NKE", "SBUX"],
    "Energy": ["XOM", "CVX", "COP", "SLB", "EOG"],
    "Industrial": ["CAT", "BA", "HON", "UPS", "GE"],
}
PEERS = {
    "AAPL": ["MSFT", "GOOGL", "AMZN", "META", "NVDA"],
    "MSFT": ["AAPL", "GOOGL", "AMZN", "META", "CRM"],
    "GOOGL": ["AAPL", "MSFT", "AMZN", "META", "NFLX"],
    "AMZN": ["AAPL", "MSFT", "GOOGL", "META", "TSLA"],
    "TSLA": ["AAPL", "NIO", "RIVN", "GM", "F"],
    "NVDA": ["AMD", "INTC", "QCOM", "AVGO", "MRVL"],
    "META": ["AAPL", "MSFT", "GOOGL", "SNAP", "PINS"],
}
DEFAULT_PEERS_OF = "AAPL"
DEFAULT_WATCHLIST = ("AAPL", "MSFT", "GOOGL", "TSLA", "NVDA")


def sector_instruments(spark: SparkSession) -> DataFrame:
    """sector, instrument, place in the listing."""
    rows = [(sector, name, place) for sector, names in SECTORS.items() for place, name in enumerate(names, 1)]
    return spark.createDataFrame(rows, "sector string, instrument string, place int")


def peers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, peer) for name, names in PEERS.items() for peer in names], "instrument string, peer string")


def with_sector(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Add the sector by an inner join: rows of unknown instruments go. Spark broadcasts the directory if it is small."""
    return rows.join(instruments.select("instrument", "sector"), "instrument")


def sector_members(instruments: DataFrame, sector: str) -> DataFrame:
    """Instruments of one sector; none for an unknown sector."""
    return instruments.filter(instruments.sector == sector).select("instrument")
