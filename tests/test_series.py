"""Series of any length: blocks must not show in the results."""

import numpy as np
import pandas as pd
import pytest
from helpers import START, plain_indicators, plain_ledger, shaped, walk
from pyspark.sql import functions as F

from barlake.operators import ledger as book
from barlake.operators.asof import asof_join
from barlake.operators.indicators import ALL_INDICATORS, HALO, exponential_average, indicators, latest, latest_indicators
from barlake.operators.series import fill_gaps, index_by_range, index_rows, last_rows, running, with_blocks

CHECKED = [
    "sma_20", "sma_50", "ema_12", "ema_26", "rsi", "macd", "macd_signal", "bb_upper", "atr", "stoch_k", "stoch_d", "williams_r", "obv", "vwap",
    "mfi", "cci", "adx", "rsi_divergence", "roc_20", "ewma_volatility",
]


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame, columns, tolerance=1e-7):
    for c in columns:
        np.testing.assert_allclose(ours[c].to_numpy(float), theirs[c].to_numpy(float), rtol=tolerance, atol=tolerance, err_msg=c)


def per_series(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([plain_indicators(part) for _, part in frame.groupby("instrument")], ignore_index=True)


def test_positions_are_dense_and_ordered(spark):
    rows = pd.concat([walk("A", 500), walk("B", 3), walk("C", 1)])
    got = index_rows(spark.createDataFrame(rows.sample(frac=1, random_state=3)), ["instrument"]).toPandas().sort_values(["instrument", "ts"])
    assert got[got.instrument == "A"].pos.tolist() == list(range(1, 501))
    assert got.groupby("instrument").n.first().to_dict() == {"A": 500, "B": 3, "C": 1}


def test_positions_by_range(spark):
    rows = spark.createDataFrame(pd.concat([walk("A", 900), walk("B", 3)]).sample(frac=1, random_state=3))
    by_range = index_by_range(rows, ["instrument"], ["ts"], 7)
    assert by_range.exceptAll(index_rows(rows, ["instrument"]).select(*by_range.columns)).count() == 0
    assert by_range.count() == 903


def test_halo_rows_come_from_the_block_before(spark):
    indexed = index_rows(spark.createDataFrame(walk("A", 10)), ["instrument"])
    got = with_blocks(indexed, 4, 2).groupBy("block").agg(F.sort_array(F.collect_list("pos")).alias("p")).orderBy("block").collect()
    assert [r.p for r in got] == [[1, 2, 3, 4], [3, 4, 5, 6, 7, 8], [7, 8, 9, 10]]


def test_indicators_do_not_depend_on_blocks(spark):
    rows = pd.concat([walk("A", 2600, 1), walk("B", 700, 2), walk("C", 100, 3)])
    expected = per_series(rows).sort_values(["instrument", "ts"])
    got = indicators(spark.createDataFrame(rows), CHECKED, block_rows=HALO + 60).toPandas().sort_values(["instrument", "ts"])
    assert len(got) == len(rows)
    assert_same(got, expected, CHECKED)


def test_strides_inside_a_long_block(spark):
    rows = walk("A", 5000, 4)
    expected = plain_indicators(rows)
    got = indicators(spark.createDataFrame(rows), ["ema_12", "ema_26", "macd_signal", "ewma_volatility"]).toPandas().sort_values("ts")
    assert_same(got, expected, ["ema_12", "ema_26", "macd_signal", "ewma_volatility"])


@pytest.mark.parametrize("span", [2, 9, 200])
def test_exponential_average_of_any_span(spark, span):
    rows = walk("A", 3000, 5)
    indexed = index_rows(spark.createDataFrame(rows), ["instrument"])
    got = exponential_average(indexed, "close", span, "e", block_rows=500).toPandas().sort_values("ts")
    np.testing.assert_allclose(got.e, rows.close.ewm(span=span, adjust=False).mean(), rtol=1e-9)


def test_short_series_use_shrinking_windows(spark):
    rows = pd.concat([walk(f"N{n}", n, n) for n in (1, 2, 12, 30, 60, 99, 100)])
    expected = per_series(rows).sort_values(["instrument", "ts"])
    got = indicators(spark.createDataFrame(rows), CHECKED).toPandas().sort_values(["instrument", "ts"])
    assert_same(got, expected, CHECKED)


def test_hand_sized_shapes(spark):
    rows = pd.concat([shaped("flat", [50.0] * 40), shaped("rising", list(range(1, 41))), shaped("quiet", [10, 11, 12, 11], volume=0.0)])
    got = indicators(spark.createDataFrame(rows), ["rsi", "mfi", "stoch_k", "bb_width", "volume_change", "vwap", "obv"]).toPandas()
    last = got.sort_values("ts").groupby("instrument").tail(1).set_index("instrument")
    assert np.isnan(last.rsi["flat"]) and np.isnan(last.stoch_k["flat"]) and last.bb_width["flat"] == 0
    assert last.rsi["rising"] == 100 and last.mfi["rising"] == 100
    assert np.isnan(last.volume_change["quiet"]) and np.isnan(last.vwap["quiet"]) and last.obv["quiet"] == 0


def test_value_ranges(spark):
    got = indicators(spark.createDataFrame(walk("A", 400, 8)), ALL_INDICATORS, fill=True).toPandas()
    assert got[list(ALL_INDICATORS)].notna().all().all()
    for c in ("rsi", "mfi", "stoch_k", "adx"):
        assert got[c].between(0, 100).all(), c
    assert got.williams_r.between(-100, 0).all()
    assert ((got.bb_lower <= got.bb_middle) & (got.bb_middle <= got.bb_upper)).all()


def test_fill_crosses_blocks(spark):
    values = [None, None, 1.0] + [None] * 6 + [2.0, None]
    rows = pd.DataFrame({"k": "a", "pos": range(1, 12), "x": values, "y": [None] * 11}).astype({"x": float, "y": float})
    frame = spark.createDataFrame(rows).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("y", F.lit(None).cast("double"))
    got = fill_gaps(frame.withColumn("block", F.floor((F.col("pos") - 1) / 3)), ["k"], ["x", "y"]).orderBy("pos").toPandas()
    assert got.x.tolist() == [1.0] * 9 + [2.0, 2.0] and got.y.isna().all()


def test_running_aggregates_cross_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1, 0.1, 50)
    frame = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": range(1, 51), "x": x})).withColumn("block", F.floor((F.col("pos") - 1) / 7))
    got = running(frame, ["k"], {"s": ("sum", F.col("x")), "p": ("product", F.col("x")), "m": ("max", F.col("x"))}, before={"old": "s"}).orderBy("pos").toPandas()
    np.testing.assert_allclose(got.s, np.cumsum(x))
    np.testing.assert_allclose(got.p, np.cumprod(x))
    np.testing.assert_allclose(got.m, np.maximum.accumulate(x))
    np.testing.assert_allclose(got.old[1:], np.cumsum(x)[:-1])


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame(pd.concat([walk("A", 300, 1), walk("B", 120, 2)]))
    seen = []
    for partitions in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        seen.append(indicators(rows, ["rsi", "macd_signal", "obv"], fill=True).toPandas().sort_values(["instrument", "ts"]).reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(seen[0], seen[1])


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join(spark, direction):
    rng = np.random.default_rng(2)
    day = lambda k: START + pd.to_timedelta(k, unit="D")
    left = pd.DataFrame({"instrument": rng.choice(["A", "B", "C"], 200), "ts": day(rng.integers(0, 400, 200)), "id": range(200)})
    right = pd.DataFrame({"instrument": "A", "ts": day(rng.choice(400, 40, replace=False)), "v": rng.normal(size=40)})
    right = pd.concat([right, right.head(5).assign(instrument="B")])
    expected = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="instrument", direction=direction).sort_values("id")
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "v", direction=direction, partitions=6).toPandas().sort_values("id")
    np.testing.assert_allclose(got.v.to_numpy(float), expected.v.to_numpy(float))


@pytest.mark.parametrize("block_rows", [4, 8192])
def test_ledger_equals_a_row_loop(spark, block_rows):
    rng = np.random.default_rng(7)
    parts = []
    for name, chance in (("often", 0.3), ("seldom", 0.03), ("none", 0.0)):
        price = np.round(50 + np.abs(np.cumsum(rng.normal(0, 1, 120))), 2)
        wish = rng.choice([1, -1, 0], 120, p=[chance, chance, 1 - 2 * chance])
        parts.append(pd.DataFrame({"instrument": name, "pos": np.arange(1, 121), "n": 120, "price": price, "signal": wish}))
    rows = pd.concat(parts)
    frame = book.ledger(spark.createDataFrame(rows), ["instrument"], block_rows=block_rows)
    equity = frame.toPandas().sort_values(["instrument", "pos"])
    totals = book.results(frame, ["instrument"]).toPandas().set_index("instrument")
    sales = book.trades(frame, ["instrument"]).filter("type <> 'BUY'").toPandas()
    for name, part in rows.groupby("instrument"):
        curve, final, profits = plain_ledger(part.price.to_numpy(), part.signal.to_numpy())
        np.testing.assert_allclose(equity[equity.instrument == name].equity, curve, rtol=1e-9)
        assert totals.final_capital[name] == pytest.approx(final)
        assert totals.total_trades[name] == len(profits)
        np.testing.assert_allclose(sales[sales.instrument == name].sort_values("index").profit, profits, rtol=1e-7, atol=1e-7)
        points = np.array([10000.0, *curve])
        change = np.diff(points) / points[:-1]
        peak = np.maximum.accumulate(points)
        assert totals.max_drawdown[name] == pytest.approx(((points - peak) / peak).min() * 100)
        if change.std() > 0:
            assert totals.sharpe_ratio[name] == pytest.approx((change.mean() - 0.02 / 252) / change.std() * np.sqrt(252))
    assert book.equity_curve(frame, ["instrument"]).count() == 3 * 121


def test_six_bar_trade(spark):
    rows = pd.DataFrame({"instrument": "x", "pos": range(1, 7), "n": 6, "price": [10.0, 11, 12, 13, 10, 9], "signal": [1, 0, -1, -1, 1, 0]})
    frame = book.ledger(spark.createDataFrame(rows), ["instrument"])
    assert [r.type for r in book.trades(frame, ["instrument"]).orderBy("index", "trade_no").collect()] == ["BUY", "SELL", "BUY", "SELL (final)"]
    trips = book.round_trips(frame, ["instrument"]).orderBy("trade_no").collect()
    assert [(t.entry_index, t.exit_index, t.closed_at_end) for t in trips] == [(0, 2, False), (4, 5, True)]
    final = book.results(frame, ["instrument"]).first().final_capital
    assert final == pytest.approx(10000 * (1.2 * 0.999 - 0.001) * (0.9 * 0.999 - 0.001))


def test_short_blocks_keep_the_memory_of_averages(spark):
    bars = spark.createDataFrame(walk("A", 1500))
    columns = ["ema_26", "macd", "macd_signal", "sma_50", "ewma_volatility"]
    a, b = (indicators(bars, columns, block_rows=n).orderBy("ts").toPandas() for n in (64, 8192))
    for c in columns:
        np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-9)


def plain_asof(left, right, direction):
    """(id, value) by looking at every right row."""
    out = {}
    for i, key, at in left:
        near = [(t, v) for k, t, v in right if k == key and v is not None and (t <= at if direction == "backward" else t >= at)]
        best = (max if direction == "backward" else min)((t for t, _ in near), default=None)
        out[i] = max((v for t, v in near if t == best), default=None)
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_at_any_skew(spark, direction):
    """One key holds most rows and one second holds most of those; repeated moments, null values, keys and times."""
    rng = np.random.default_rng(7)
    moment = lambda k: pd.Timestamp("2024-01-01") + pd.Timedelta(int(rng.integers(0, 1000 if k == "hot" else 10**9)), "us")
    keys = lambda n: rng.choice(["hot", "a", "b", "only"], n, p=[0.85, 0.05, 0.05, 0.05]).tolist()
    left = [(i, k, moment(k)) for i, k in enumerate(keys(600))]
    right = [(k, moment(k), None if rng.random() < 0.1 else float(rng.integers(0, 50))) for k in keys(500) if k != "only"]
    odd = [(1000, None, pd.Timestamp("2024-01-01")), (1001, "hot", None)]
    names = "id long, instrument string, ts timestamp"
    clean = [(i, k, t.to_pydatetime() if t is not None else None) for i, k, t in left + odd]
    a = spark.createDataFrame(clean, names).withColumn("value", F.lit("mine")).drop("value")
    b = spark.createDataFrame([(k, t.to_pydatetime(), v) for k, t, v in right], "instrument string, ts timestamp, value double")
    out = asof_join(a, b, "value", direction=direction, partitions=7)
    assert out.columns == ["id", "instrument", "ts", "value"]
    got = {r.id: r.value for r in out.collect()}
    assert got == plain_asof(left, right, direction) | {1000: None, 1001: None}


def test_asof_spreads_one_moment_and_one_key(spark):
    """All rows in one key and one day: the sorted parts are even, whole left rows are not in them."""
    rows = spark.range(20_000).select(F.lit("one").alias("instrument"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.col("id").cast("double").alias("value"))
    wide = rows.select("instrument", "ts", F.repeat(F.lit("x"), 100).alias("text"))
    out = asof_join(wide, rows.filter("value % 7 = 0"), "value", partitions=8)
    assert out.filter("value IS NULL OR value != floor(unix_millis(ts) / 7) * 7").count() == 0 and out.count() == 20_000
    empty = rows.limit(0)
    assert asof_join(wide, empty, "value").filter("value IS NOT NULL").count() == 0 and asof_join(empty.drop("value"), rows, "value").count() == 0


def test_latest_indicators(spark):
    """As the last rows of all indicators, where series are short, long, flat at the end or without a volume for long."""
    parts = [walk(name, n, seed) for seed, (name, n) in enumerate([("one", 1), ("few", 40), ("short", 99), ("exact", 540), ("long", 3000), ("longer", 9000)])]
    for name, flat in (("flat", 700), ("idle", 2950)):  # last known values stand far back, or nowhere
        bars = walk(name, 3000, 9)
        bars.loc[len(bars) - flat :, ["open", "high", "low", "close"]] = 50.0
        bars.loc[len(bars) - flat :, "volume"] = 0.0
        parts.append(bars)
    frame = spark.createDataFrame(pd.concat(parts)).repartition(5)
    columns = ["sma_20", "rsi", "macd", "macd_signal", "bb_upper", "stoch_k", "stoch_d", "williams_r", "mfi", "cci", "adx", "obv"]
    for bars, wanted, fill in ((frame, columns[:-1], True), (index_rows(frame, ("instrument",)), columns[:-1], True), (frame, columns[:-1], False), (frame, columns, False)):
        whole = bars if "pos" in bars.columns else index_rows(bars, ("instrument",))
        plain = latest(indicators(whole, wanted, fill=fill)).toPandas().set_index("instrument").sort_index()
        got = latest_indicators(bars, wanted, fill=fill, stretch=64).toPandas().set_index("instrument").sort_index()
        assert sorted(got.columns) == sorted(plain.columns) and (got["n"] == got["pos"]).all() and len(got) == 8
        pd.testing.assert_frame_equal(got[plain.columns], plain, rtol=1e-9, atol=1e-9, check_dtype=False)
    assert latest_indicators(frame.limit(0), ["rsi"], fill=True).count() == 0


def test_last_rows(spark):
    frame = spark.createDataFrame(pd.concat([walk("a", 1000), walk("b", 3), walk("c", 129, freq="h")]))
    whole = {(r.instrument, r.ts): (r.pos, r.n) for r in index_rows(frame, ("instrument",)).collect()}
    for rows in (1, 5, 200, 5000):
        got = {(r.instrument, r.ts): (r.pos, r.n) for r in last_rows(frame, ("instrument",), rows).collect()}
        assert got == {k: (pos, n) for k, (pos, n) in whole.items() if pos > n - rows}
    for column in ("instrument", "ts"):
        lost = frame.withColumn(column, F.expr(f"if(close > 101, null, {column})"))
        for placed in (last_rows(lost, ("instrument",), 5), index_rows(lost, ("instrument",))):
            with pytest.raises(Exception, match="no instrument"):
                placed.collect()
