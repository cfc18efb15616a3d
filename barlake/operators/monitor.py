"""Alerts and prediction scorekeeping as views over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numeric import fixed
from barlake.functions.votes import direction_correct
from barlake.operators.asof import asof_join
from barlake.operators.series import index_rows, own_block, with_blocks
from barlake.session import materialise

SEARCH_ROWS = 256


def current_alerts(events: DataFrame) -> DataFrame:
    """Alerts that were created and not removed, from events (action 'create' or 'remove', id, ...)."""
    removed = events.filter(F.col("action") == "remove").select("id")
    return events.filter(F.col("action") == "create").drop("action").join(removed, "id", "left_anti")


def select_alerts(alerts: DataFrame, instrument: str | None = None, active_only: bool = True) -> DataFrame:
    """By instrument (any case) and, with `active_only`, only those that can still fire."""
    if instrument is not None:
        alerts = alerts.filter(F.col("instrument") == instrument.upper())
    return alerts.filter(F.col("active") & ~F.col("triggered")) if active_only else alerts


def _fires(alert_type: Column, value: Column, price: Column, rsi: Column) -> Column:
    hit = (
        F.when(alert_type == "price_above", price > value).when(alert_type == "price_below", price < value)
        .when(alert_type == "rsi_above", rsi > value).when(alert_type == "rsi_below", rsi < value)
    )
    return F.coalesce(hit, F.lit(False))


def _observed(alert_type: Column, price: Column, rsi: Column) -> Column:
    return F.when(alert_type.startswith("rsi"), rsi).otherwise(price)


def check_alerts(alerts: DataFrame, latest: DataFrame) -> DataFrame:
    """Open alerts that fire on the latest row (instrument, close, rsi) of their instrument, with the value seen."""
    kind, value = F.col("alert_type"), F.col("value")
    joined = select_alerts(alerts).join(latest.select("instrument", "close", "rsi"), "instrument")
    return joined.filter((F.col("close") != 0) & _fires(kind, value, F.col("close"), F.col("rsi"))).withColumn(
        "triggered_value", _observed(kind, F.col("close"), F.col("rsi"))
    ).drop("close", "rsi")


def _when_fired(price_up: str, price_down: str, rsi_up: str, rsi_down: str) -> str:
    return (
        f"CASE alert_type WHEN 'price_above' THEN x.{price_up} > value WHEN 'price_below' THEN x.{price_down} < value"
        f" WHEN 'rsi_above' THEN x.{rsi_up} > value WHEN 'rsi_below' THEN x.{rsi_down} < value END"
    )


def first_triggers(alerts: DataFrame, bars: DataFrame, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """Each alert with the first bar at or after its creation that fires it (null if none does): it fires once.

    Bars (instrument, ts, pos, n, close, rsi) are kept as arrays of `search_rows` rows, their extremes as arrays of
    `search_rows` blocks, and the extremes of those as one array per instrument. What is looked up are questions: type, value
    and first bar, once for all alerts that share them. A question looks into its own rows, then its own blocks, then the
    rest, and comes down again to the row: five joins that each meet one array per question, so alerts and bars of a hot
    instrument are never paired with each other. All joins are by instrument too, so a filter by instrument reaches the search.
    """
    rows = bars.select("instrument", "pos", "ts", "close", "rsi").withColumn("b0", own_block(search_rows))
    listed = lambda *columns: F.sort_array(F.collect_list(F.struct(*columns)))
    extremes = lambda up, down, rsi_up, rsi_down: [
        F.max(up).alias("high"), F.min(down).alias("low"), F.max(rsi_up).alias("rsi_high"), F.min(rsi_down).alias("rsi_low"),
    ]
    names = ("high", "low", "rsi_high", "rsi_low")
    level0 = rows.groupBy("instrument", "b0").agg(listed("pos", "ts", "close", "rsi").alias("_rows"))
    blocks = rows.groupBy("instrument", "b0").agg(*extremes("close", "close", "rsi", "rsi")).withColumn("b1", F.floor(F.col("b0") / search_rows))
    level1 = blocks.groupBy("instrument", "b1").agg(listed("b0", *names).alias("_blocks"))
    top = blocks.groupBy("instrument", "b1").agg(*extremes(*names)).groupBy("instrument").agg(listed("b1", *names).alias("_parts"))

    row_fires, block_fires = _when_fired("close", "close", "rsi", "rsi"), _when_fired(*names)
    first = lambda array, condition: f"try_element_at(filter({array}, x -> coalesce({condition}, false)), 1)"
    spread = "-1 - pmod(hash(start, value), 4096)"  # a place that no block has, so that questions with nothing to look up do not pile up
    asked = ["instrument", "alert_type", "value", "start"]
    fields = [*asked, "home0", "home1", "hit", "c0", "c1"]
    keep = lambda **new: [f"{new[f]} AS {f}" if f in new else f for f in fields]

    begun = asof_join(alerts.select("instrument", "created_at").distinct(), bars.select("instrument", "ts", F.col("pos").alias("start")), "start", left_on="created_at", direction="forward")
    begun = materialise(begun.filter("start is not null").select("instrument", "created_at", "start"))
    found = alerts.join(begun, ["instrument", "created_at"]).select(asked).distinct().selectExpr(
        *asked, f"floor((start - 1) / {search_rows}) AS home0", f"floor((start - 1) / {search_rows * search_rows}) AS home1"
    )
    found = found.withColumn("b0", F.col("home0")).join(level0, ["instrument", "b0"], "left")
    found = found.selectExpr(*fields[:6], f"{first('_rows', f'x.pos >= start AND {row_fires}')} AS hit", "bigint(null) AS c0", "bigint(null) AS c1")
    found = found.withColumn("b1", F.expr(f"if(hit is null, home1, {spread})")).join(level1, ["instrument", "b1"], "left")
    found = found.selectExpr(*keep(c0=f"{first('_blocks', f'x.b0 > home0 AND {block_fires}')}.b0"))
    found = found.join(top, "instrument", "left")
    found = found.selectExpr(*keep(c1=f"if(hit is null and c0 is null, {first('_parts', f'x.b1 > home1 AND {block_fires}')}.b1, null)"))
    found = found.withColumn("b1", F.expr(f"coalesce(c1, {spread})")).join(level1, ["instrument", "b1"], "left")
    found = found.selectExpr(*keep(c0=f"coalesce(c0, {first('_blocks', block_fires)}.b0)"))
    found = found.withColumn("b0", F.expr(f"if(hit is null, coalesce(c0, {spread}), {spread})")).join(level0, ["instrument", "b0"], "left")
    fired = found.selectExpr(*asked, f"coalesce(hit, {first('_rows', row_fires)}) AS hit").filter("hit is not null")
    fired = fired.selectExpr(*asked, "hit.ts AS triggered_at", "if(startswith(alert_type, 'rsi'), hit.rsi, hit.close) AS triggered_value")
    told = alerts.join(begun, ["instrument", "created_at"], "left").join(fired, asked, "left")
    return told.select(*alerts.columns, "triggered_at", "triggered_value").withColumn("triggered", F.col("triggered_at").isNotNull())


def alert_statistics(alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("active") & ~F.col("triggered")).alias("active"), F.count_if("triggered").alias("triggered")
    )


def verify_predictions(predictions: DataFrame, bars: DataFrame, days: int = 5) -> DataFrame:
    """Predictions (id, instrument, recorded_at, signal, price) with the close `days` later: a view, so running it
    again changes nothing. Those with no bar yet stay unverified."""
    due = predictions.withColumn("_due", F.col("recorded_at") + F.make_dt_interval(F.lit(days)))
    later = bars.select("instrument", "ts", F.col("close").alias("price_after"))
    seen = asof_join(due, later, "price_after", left_on="_due", direction="forward").drop("_due")
    known = F.col("price_after").isNotNull()
    return seen.withColumns(
        {
            "verified": known,
            "return_pct": fixed((F.col("price_after") - F.col("price")) / F.col("price") * 100, 2),
            "correct": F.when(known, direction_correct(F.col("signal"), F.col("price"), F.col("price_after"))),
        }
    )


def scorecard(verified: DataFrame, by: Sequence[str] = ("instrument",), days: int | None = None) -> DataFrame:
    """Accuracy, average return and win rate of the verified predictions, per key; `days` keeps the latest ones only."""
    rows = verified.filter("verified")
    if days is not None:
        newest = rows.agg(F.max("recorded_at")).scalar()
        rows = rows.filter(F.col("recorded_at") >= newest - F.make_dt_interval(F.lit(days)))
    counted = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.count_if("correct").alias("_correct"), F.avg("return_pct").alias("_avg"), F.count_if(F.col("return_pct") > 0).alias("profitable_trades"),
    )
    total = F.col("total_predictions").cast("double")
    return counted.select(
        *by, "total_predictions", fixed(F.col("_correct") / total * 100, 1).alias("accuracy"), fixed("_avg", 2).alias("avg_return"),
        fixed(F.col("profitable_trades") / total * 100, 1).alias("win_rate"), "profitable_trades", (F.col("total_predictions") - F.col("profitable_trades")).alias("losing_trades"),
    )


def accuracy_trend(verified: DataFrame, by: Sequence[str] = ("instrument",), window: int = 10) -> DataFrame:
    """Accuracy of the last `window` verified predictions, from the `window`-th on."""
    # one day per bucket: unlike bars, any number of predictions may share a day
    one_day = F.floor(F.unix_seconds("recorded_at") / 86400)
    indexed = index_rows(verified.filter("verified"), by, ("recorded_at", "id"), one_day)
    frame = Window.partitionBy(*by, "block").orderBy("pos").rowsBetween(1 - window, 0)
    rolled = with_blocks(indexed, halo=window - 1).withColumn("_share", F.avg(F.col("correct").cast("double")).over(frame))
    return rolled.filter(~F.col("is_halo") & (F.col("pos") >= window)).select(
        *by, F.col("pos").alias("period"), fixed(F.col("_share") * 100, 1).alias("accuracy"), F.lit(window).cast("long").alias("predictions"), F.date_format("recorded_at", "yyyy-MM-dd").alias("day")
    )
