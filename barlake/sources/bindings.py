"""The sample tables seen as market data.

The sample data has no prices, so ticks, bars, news, predictions, transactions and so on are derived from its tables;
each definition has a SQL twin in `barlake.plans.sqltext`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators.asof import asof_join
from barlake.operators.resample import bars_from_ticks, coarser_bars
from barlake.operators.series import index_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: 1990-01-01 in microseconds; ticks begin after it.
FIRST_MOMENT = 631_152_000 * 10**6


def price_e4() -> Column:
    """Price in 1/10000, an exact integer."""
    tenths = F.round(F.col("p_retailprice") * 10).cast("long")
    percent = F.lit(100).cast("long") - F.round(F.col("l_discount") * 100).cast("long")
    return tenths * percent * F.lit(10)


def lineitem_price() -> Column:
    """Price with exactly four decimals, from integers only, so that every engine gets the same double."""
    return price_e4().cast("double") / F.lit(10000.0)


def tick_key() -> Column:
    """Order of ticks (time, order, line, price) packed into one decimal. A decimal is fixed-width, so first and last
    price stay in the hash aggregate; a struct key would force a sort. A part that outgrows its digits raises:
    microseconds since 1990 16 (until 2306), order 12, line 2 and price 8 digits. Null parts make a null key."""
    moment = F.unix_micros("ts") - F.lit(FIRST_MOMENT)
    order, line, price = F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), price_e4()
    parts = ((moment, 16), (order, 12), (line, 2), (price, 8))
    outgrown = reduce(lambda a, b: a | b, [~x.between(0, 10**digits - 1) for x, digits in parts])  # null parts do not raise
    low = (order * F.lit(100) + line).cast("decimal(14,0)") * F.lit(10**8).cast("decimal(9,0)") + price.cast("decimal(8,0)")
    key = (moment.cast("decimal(16,0)") * F.lit("1" + "0" * 22).cast("decimal(23,0)") + low).cast("decimal(38,0)")
    told = F.concat_ws(", ", *[x.cast("string") for x, _ in parts])
    return F.when(outgrown, F.raise_error(F.concat(F.lit("a part of the tick order has too many digits: "), told)).cast("decimal(38,0)")).otherwise(key)


def places(spark: SparkSession, folder: str) -> DataFrame:
    """instrument number, instrument, sector: one row per nation."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("place"), F.col("n_name").alias("instrument"), F.col("r_name").alias("sector")
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(places(spark, folder), F.col("s_nationkey") == F.col("place"))
        .join(part, line.l_partkey == part.p_partkey)
        .select("instrument", "sector", "ts", lineitem_price().alias("price"), F.col("l_quantity").alias("volume"), tick_key().alias("tick_key"))
    )


def bars(spark: SparkSession, folder: str, grain: str = "week") -> DataFrame:
    """Bars of all instruments. Most operators read them twice (positions, then values), so the aggregated bars are
    kept; they are smaller than the ticks by the number of ticks per bar."""
    return bars_from_ticks(ticks(spark, folder), grain, ("instrument", "sector"), "tick_key").persist()


def grains(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Daily bars from the ticks, weekly and monthly ones from the daily bars: the ticks are read once."""
    daily = bars(spark, folder, "day")
    return {"day": daily, **{grain: coarser_bars(daily, grain, ("instrument", "sector")) for grain in ("week", "month")}}


def series(spark: SparkSession, folder: str, grain: str = "week") -> DataFrame:
    """`bars` with `pos` and `n`: what a user would keep as a table, because every window operator starts from it."""
    return index_rows(bars(spark, folder, grain), ("instrument",)).persist()


def news(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: instrument number = doc_id mod 25, whole text as title, day number from doc_id."""
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("doc"), F.col("text").alias("title"), "source", (F.col("doc_id") % 25).cast("int").alias("place")
    )
    published = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc") * 37, F.lit(365)).cast("int"))
    return documents.join(places(spark, folder), "place").select("instrument", published.cast("timestamp").alias("published"), "doc", "title", "source")


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("ordered"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return placed.join(places(spark, folder), F.col("c_nationkey") == F.col("place")).select(
        F.col("o_orderkey").alias("id"), "instrument", "ordered", F.col("o_orderstatus").alias("status")
    )


def alert_events(spark: SparkSession, folder: str) -> DataFrame:
    """One created alert per order, its type and value from the order number; orders in process remove it again."""
    orders = customer_orders(spark, folder)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("price_above", "price_below", "rsi_above", "rsi_below")]), (F.col("id") % 4 + 1).cast("int"))
    value = F.when(F.col("id") % 4 < 2, F.lit(820) + F.pmod(F.col("id") * 7, F.lit(170))).otherwise(F.lit(35) + F.pmod(F.col("id") * 3, F.lit(30)))
    created = orders.select(
        F.lit("create").alias("action"), "id", "instrument", kind.alias("alert_type"), value.cast("double").alias("value"), F.col("ordered").alias("created_at"),
        F.lit(True).alias("active"), F.lit(False).alias("triggered"),
    )
    removed = created.join(orders.filter("status = 'P'").select("id"), "id", "left_semi").withColumn("action", F.lit("remove"))
    return created.unionByName(removed)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as predictions; the price is the close of the week before or of the order day."""
    signal = F.when(F.col("status") == "F", "BUY").when(F.col("status") == "O", "SELL").otherwise("HOLD")
    made = customer_orders(spark, folder).select("id", "instrument", F.col("ordered").alias("recorded_at"), signal.alias("signal"))
    closes = bars(spark, folder).select("instrument", "ts", F.col("close").alias("price"))
    return asof_join(made, closes, "price", left_on="recorded_at").filter(F.col("price").isNotNull())


TRANSACTION_ORDER = ("traded_at", "o_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("l_shipdate")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("traded_at"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(places(spark, folder), F.col("s_nationkey") == F.col("place"))
        .join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("o_custkey").alias("portfolio"), *TRANSACTION_ORDER, "instrument",
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"), F.col("l_quantity").alias("shares"), lineitem_price().alias("price"),
        )
    )


def company_information(spark: SparkSession, folder: str) -> DataFrame:
    """Raw company figures per instrument, from whole cents and counts of customers, suppliers and orders. Some are null."""
    place = places(spark, folder)
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("place"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    supplier = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("place")).agg(
        F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("assets"), F.count("*").alias("suppliers")
    )
    orders = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    newest = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("place").agg(
        F.sum("amount").alias("revenue"), F.sum(F.when(F.col("year") == 1999, F.col("amount"))).alias("now"), F.sum(F.when(F.col("year") == 1998, F.col("amount"))).alias("past"),
    )
    wealth = customer.groupBy("place").agg(F.sum("cents").alias("earnings"), F.count("*").alias("customers"))
    joined = place.join(wealth, "place", "left").join(supplier, "place", "left").join(newest, "place", "left")
    d = lambda x: F.col(x).cast("double")
    hidden = lambda every, x: F.when(F.col("place") % every != 0, x)
    return joined.select(
        "instrument", F.concat(F.lit("Company of "), "instrument").alias("longName"), "sector", hidden(4, F.concat(F.lit("Industry "), (F.col("place") % 3).cast("string"))).alias("industry"),
        hidden(3, F.try_divide(d("revenue"), d("earnings") * 10)).alias("trailingPE"), hidden(5, F.try_divide(d("revenue"), d("earnings") * 12)).alias("forwardPE"),
        hidden(7, F.try_divide(d("earnings"), d("revenue")) * 3).alias("profitMargins"), F.try_divide(d("earnings") - d("assets") * 10, d("assets") * 10).alias("returnOnEquity"),
        hidden(6, F.try_divide(d("assets") * 1000, d("earnings"))).alias("debtToEquity"), F.try_divide(d("now") - d("past"), d("past")).alias("revenueGrowth"),
        d("revenue").alias("marketCap"), d("customers").alias("employees"), hidden(8, d("earnings") / 100).alias("totalCash"), F.lit("buy").alias("recommendationKey"),
    )


def peers(spark: SparkSession, folder: str) -> DataFrame:
    """The other instruments of the same sector."""
    left, right = places(spark, folder), places(spark, folder).select("sector", F.col("instrument").alias("peer"))
    return left.join(right, "sector").filter("instrument <> peer").select("instrument", "peer")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of ticks: event type as instrument, value as price. The pattern stands for the table's own path,
    one file or a folder of part files; a plain path could only be a folder."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(4 << 30)).parquet(f"{folder}/events.parque[t]")
    return events.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
