"""Files, streams and the registered queries."""

import json
import os
import shutil
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import START, walk
from pyspark.sql import functions as F

from barlake.operators.crosssection import simple_returns
from barlake.plans.catalog import REGISTRY
from barlake.sources import dimensions, files
from barlake.streaming import alerts, live

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="barlake-test-", dir="/tmp")


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_bars_round_trip(spark, folder, form):
    rows = spark.createDataFrame(walk("A", 90)).union(spark.createDataFrame(walk("B", 40)))
    files.write_bars(rows, folder + "/bars", form=form)
    assert files.read_bars(spark, folder + "/bars", form=form).exceptAll(rows).count() == 0
    some = files.read_bars(spark, folder + "/bars", "2020-02-10", "2020-03-05", form)
    assert some.count() == 24 and str(some._jdf.queryExecution().executedPlan()).count("bar_month") > 0
    assert files.bars_of(some, ["B"]).count() == 0 and files.bars_of(some, rows.select("instrument").distinct()).count() == 24


def test_exports(spark, folder):
    record = files.record_frame(spark, {"instrument": "A", "price": 1.5, "n": 3})
    files.export_csv(record.withColumn("s", F.struct("price")), folder + "/csv")
    text = "".join(open(os.path.join(folder, "csv", f)).read() for f in os.listdir(folder + "/csv") if f.startswith("part"))
    assert "instrument,price,n,s\n" in text and "A,1.5,3," in text
    files.export_json(record.withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp")), folder + "/json")
    text = "".join(open(os.path.join(folder, "json", f)).read() for f in os.listdir(folder + "/json") if f.startswith("part"))
    assert json.loads(text)["at"] == "2024-01-02T03:04:05"


def test_news_and_training_files(spark, folder):
    os.makedirs(folder + "/m")
    with open(folder + "/news.xml", "w") as f:
        f.write("<rss><channel><item><title>Up</title><link>u</link></item><item><title>Down</title><source>s</source></item></channel></rss>")
    assert sorted(tuple(r) for r in files.read_news_xml(spark, folder + "/news.xml").collect()) == [("Down", "s", "", ""), ("Up", "", "", "u")]
    with open(folder + "/m/AB_stock_model_config.json", "w") as f:
        f.write('{\n "n_features": 26,\n "model_name": "x"\n}')
    with open(folder + "/m/AB_stock_model_history.json", "w") as f:
        json.dump({"train_loss": [2.0, 1.0], "val_loss": [3.0, 4.0]}, f, indent=1)
    assert tuple(files.read_training_configs(spark, folder + "/m").first()) == ("AB", "lstm_attention_v2", 26, 60)
    assert tuple(files.read_training_histories(spark, folder + "/m").first()) == ("AB", [2.0, 1.0], [3.0, 4.0])


def test_record_store(spark, folder):
    schema = "id long, action string"
    for rows in ([(1, "create")], [(2, "create"), (1, "remove")]):
        files.append_records(spark.createDataFrame(rows, schema), folder + "/store")
    assert files.read_records(spark, folder + "/store", schema).count() == 3


def test_dimensions(spark):
    listed = dimensions.sector_instruments(spark)
    assert listed.count() == 50 and dimensions.sector_members(listed, "Nowhere").count() == 0
    assert dimensions.peers(spark).filter("instrument = 'TSLA'").count() == 5
    rows = spark.createDataFrame(pd.concat([walk("AAPL", 5), walk("WHO", 5)]))
    assert dimensions.with_sector(rows, listed).select("sector").distinct().collect()[0][0] == "Technology"
    assert simple_returns(rows).count() == 8


def test_alerts_on_a_stream_fire_once_over_restarts(spark, folder):
    alerts = spark.createDataFrame([(1, "A", "price_above", 10.0), (2, "A", "price_below", 5.0), (3, "B", "price_above", 1e9)], "id long, instrument string, alert_type string, value double")
    os.makedirs(folder + "/in")

    def arrive(name, prices):
        rows = [("A", (START + pd.Timedelta(hours=h)).to_pydatetime(), float(p), 1.0) for h, p in prices]
        spark.createDataFrame(rows, live.TICK).coalesce(1).write.parquet(f"{folder}/stage-{name}")
        part = next(f for f in os.listdir(f"{folder}/stage-{name}") if f.endswith(".parquet"))
        shutil.copy(f"{folder}/stage-{name}/{part}", f"{folder}/in/{name}.parquet")
        ticks = spark.readStream.schema(live.TICK).parquet(folder + "/in")
        live.price_alerts(ticks, alerts, folder + "/out", folder + "/check").awaitTermination()

    arrive("one", [(1, 9), (2, 12), (3, 11)])
    arrive("two", [(4, 20), (5, 4)])
    fired = {r.id: (r.triggered_value, r.triggered_at.hour) for r in spark.read.schema(live.FIRED).parquet(folder + "/out").collect()}
    assert fired == {1: (12.0, 2), 2: (4.0, 5)}
    assert spark.read.schema(live.FIRED).parquet(folder + "/out").count() == 2


def test_verification_run_writes_each_prediction_once(spark, folder):
    bars = spark.createDataFrame(walk("A", 30))
    bars.filter("ts < '2020-01-12'").write.parquet(folder + "/bars/first")
    rows = [(i, "A", (START + pd.Timedelta(days=i)).to_pydatetime(), "BUY", 100.0) for i in (1, 4, 15)]
    predictions = spark.createDataFrame(rows, "id long, instrument string, recorded_at timestamp, signal string, price double")

    def run():
        stream = spark.readStream.schema(bars.schema).parquet(folder + "/bars/*")
        stored = spark.read.schema(bars.schema).parquet(folder + "/bars/*")
        live.verification_run(stream, predictions, stored, folder + "/out", folder + "/check").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(folder + "/out").select("id").collect())

    assert run() == [1, 4]
    bars.filter("ts >= '2020-01-12'").write.parquet(folder + "/bars/second")
    assert run() == [1, 4, 15]


QUICK = ["bars_week", "rsi", "max_sharpe_portfolio", "strategy_risk", "alert_first_triggers", "combined_votes", "position_book", "fundamental_scores", "live_bars", "period_returns", "live_alerts", "cash_account", "portfolio_summary", "verification_run", "stored_bars_parquet", "loss_curves", "widening_period", "peer_quotes"]
NAMES = list(REGISTRY) if os.environ.get("BARLAKE_ALL_QUERIES") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_registered_query(spark, name):
    query = REGISTRY[name]
    ours = query.build(spark, DATA).toPandas()
    if query.check is None:
        return
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    theirs = db.execute(query.check).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    clean = lambda frame: sorted((tuple(None if v is None or v != v else v for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=repr)
    assert clean(ours) == clean(theirs)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams_over_shuffled_part_files(spark, folder):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(5, "event_id").write.parquet(f"{folder}/events.parquet")
    for name in ("live_bars", "live_alerts"):
        query = REGISTRY[name]
        got, want = query.build(spark, folder), query.build(spark, DATA)
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.count() > 0


def test_price_records_are_few_and_complete(spark):
    rows = pd.concat([walk("A", 3000, seed=4, freq="min"), walk("B", 500, seed=5, freq="h")]).assign(price=lambda x: x.close)
    records = live.price_records(spark.createDataFrame(rows)).toPandas()
    for name, part in rows.groupby("instrument"):
        part = part.sort_values("ts")
        high, low = part.price.cummax().shift(), part.price.cummin().shift()
        want = part[high.isna() | (part.price > high) | (part.price < low)]
        assert sorted(records[records.instrument == name].ts) == sorted(want.ts)
    assert len(records) < len(rows) / 5


def test_tick_order_by_time_and_loud_limits(spark):
    from barlake.sources import bindings

    def keyed(*rows):
        frame = spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), o, n, 1000.0, 0.1) for t, o, n in rows], "ts timestamp, l_orderkey long, l_linenumber int, p_retailprice double, l_discount double")
        return [r.k for r in frame.select(bindings.tick_key().alias("k")).collect()]

    keys = keyed(("2001-01-01 09:00:00.000001", 10**12 - 1, 99), ("2001-01-01 09:00:00.000002", 1, 1), ("2001-01-02", 1, 1), ("2001-01-02", 1, 12), ("2001-01-02", 2, 1))
    assert keys == sorted(keys) and len(set(keys)) == 5
    for bad in (("2001-01-01", 10**12, 1), ("2001-01-01", 1, 100)):
        with pytest.raises(Exception, match="tick order"):
            keyed(bad)


# ---------------------------------------------------------------- live alerts on keyed state


def plain_firings(closes, levels):
    """(id, bar, value) of the first close or RSI beyond each level, by hand."""
    rsi = []
    for i in range(len(closes)):
        moves = [0.0 if j == 0 else closes[j] - closes[j - 1] for j in range(i - 13, i + 1)] if i >= 13 else []
        up, down = sum(max(m, 0) for m in moves) / 14, sum(max(-m, 0) for m in moves) / 14
        rsi.append(None if not moves or up == down == 0 else 100.0 if down == 0 else 100 - 100 / (1 + up / down))
    out = {}
    for key, (kind, level, since) in levels.items():
        line = rsi if kind.startswith("rsi") else closes
        hits = [i for i, v in enumerate(line) if i >= since and v is not None and (v > level if kind.endswith("above") else v < level)]
        if hits:
            out[key] = hits[0], round(line[hits[0]], 6)
    return out


def test_live_rsi_alerts_over_restarts(spark, tmp_path):
    """Three runs of one query, stopped between: firings as over the whole series, each once, with alerts that come and go on the way."""
    rng = np.random.default_rng(11)
    closes = {k: np.round(100 + np.cumsum(rng.normal(0, 2, 70)), 2).tolist() for k in ("A", "B")} | {"flat": [5.0] * 70}
    levels = {k: {f"{k}-{kind}-{level}": (kind, level, 0) for kind, level in [("price_above", 104.0), ("price_below", 96.0), ("rsi_above", 60.0), ("rsi_above", 99.9), ("rsi_below", 40.0), ("other", 1.0)]} for k in closes}
    rows = [(k, f"{k}-{kind}-{level}", kind, level) for k, own in levels.items() for kind, level, _ in own.values()]
    first = spark.createDataFrame([*rows, ("A", "none", "price_above", None), (None, "lost", "price_above", 1.0)], "instrument string, id string, alert_type string, value double")
    changes = {1: [("A", "late", "price_above", 0.0, "create"), ("B", "B-rsi_above-60.0", "rsi_above", 60.0, "remove"), ("B", "gone", "price_above", 0.0, "create"), ("B", "gone", None, None, "remove")], 2: [("flat", "last", "price_below", 6.0, "create")]}
    cuts = [0, 9, 40, 70]
    for run in range(3):
        part = [(k, START + pd.Timedelta(i, "h"), c[i]) for k, c in closes.items() for i in range(cuts[run], cuts[run + 1])]
        rng.shuffle(part)
        part.append(("A", START + pd.Timedelta(cuts[run], "h"), None))
        spark.createDataFrame([(k, pd.Timestamp(t).to_pydatetime(), None if c is None else float(c)) for k, t, c in part], "instrument string, ts timestamp, close double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
        spark.createDataFrame(changes.get(run, []), "instrument string, id string, alert_type string, value double, action string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        bars = spark.readStream.schema("instrument string, ts timestamp, close double").parquet(f"{tmp_path}/bars")
        events = spark.readStream.schema("instrument string, id string, alert_type string, value double, action string").parquet(f"{tmp_path}/events")
        alerts.alert_run(alerts.fired_alerts(bars, first, events), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    levels["A"]["late"], levels["flat"]["last"] = ("price_above", 0.0, 9), ("price_below", 6.0, 40)
    if plain_firings(closes["B"][:9], {"x": levels["B"]["B-rsi_above-60.0"]}) == {}:
        del levels["B"]["B-rsi_above-60.0"]
    want = {k: v for key, own in levels.items() for k, v in plain_firings(closes[key], own).items()}
    fired = spark.read.schema(alerts.FIRED).parquet(f"{tmp_path}/out").collect()
    got = {r.id: (int((pd.Timestamp(r.triggered_at) - START) / pd.Timedelta(1, "h")), round(r.triggered_value, 6)) for r in fired}
    assert got == want and len(fired) == len(want) and len(want) > 8


def test_rsi_of_parts_is_that_of_the_whole():
    closes = np.round(50 + np.cumsum(np.random.default_rng(2).normal(0, 1, 60)), 2)
    whole = alerts.rolling_rsi(closes, True)
    assert np.isnan(whole[:13]).all() and not np.isnan(whole[13:]).any()
    for cut in (14, 15, 30):
        np.testing.assert_allclose(alerts.rolling_rsi(closes[cut - 14 :], False)[14:], whole[cut:])
    assert np.isnan(alerts.rolling_rsi(np.full(20, 3.0), True)).all() and alerts.rolling_rsi(np.arange(20.0), True)[-1] == 100


def test_feeds_and_listing(spark, tmp_path):
    items = spark.createDataFrame([("A <b> & \"c\"", "wire", "2024-01-02", None), (None, "wire", None, "https://x/1?a=1&b=2")], "title string, source string, pubDate string, link string")
    files.write_news_xml(items, f"{tmp_path}/feed")
    got = {tuple(r) for r in files.read_news_xml(spark, f"{tmp_path}/feed").collect()}
    assert got == {('A <b> & "c"', "wire", "2024-01-02", ""), ("", "wire", "", "https://x/1?a=1&b=2")}
    configs = spark.createDataFrame([("A", 30, None, "line"), ("B/C", None, 4, None)], "instrument string, sequence_length int, n_features int, architecture string")
    files.write_training_configs(configs, f"{tmp_path}/configs")
    listed = files.trained_models(spark, f"{tmp_path}/configs", spark.createDataFrame([("A",), ("A",), ("Z",)], "instrument string"))
    assert {tuple(r) for r in listed.select("instrument", "architecture", "n_features", "sequence_length", "has_model").collect()} == {("A", "line", 0, 30, True), ("B/C", "lstm_attention_v2", 4, 60, False)}


def test_period_of_a_store_reads_its_months(spark, tmp_path):
    """Two writes; each instrument's year ends at its own last bar, and only month folders of those years are scanned."""
    path = f"{tmp_path}/bars"
    early, late = walk("A", 900), walk("B", 400)
    for part in (early.iloc[:500], pd.concat([early.iloc[500:], late])):
        frame = spark.createDataFrame(part)
        files.write_bars(frame, path)
        files.write_extents(frame, path)
    got = files.read_period(spark, path, 12).toPandas().sort_values(["instrument", "ts"])
    want = pd.concat([b[b.ts >= b.ts.max() - pd.DateOffset(months=12)] for b in (early, late)])
    assert got[["instrument", "ts", "close"]].values.tolist() == want[["instrument", "ts", "close"]].values.tolist()
    months = {m[:7] for m in want.ts.astype(str)}
    plan = files.read_period(spark, path, 12)._jdf.queryExecution().executedPlan().toString()
    every = set(pd.concat([early, late]).ts.dt.strftime("%Y-%m"))
    assert "PartitionFilters" in plan and {m for m in every if m in plan} == months < every


def test_snapshots_of_live_output(spark, tmp_path):
    path = f"{tmp_path}/out"
    write = lambda n, rows: spark.createDataFrame(rows, "instrument string, price double").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")
    state = lambda: {r.instrument: r.price for r in live.newest_of(spark, path, ["instrument"]).collect()}
    for n in range(12):
        write(n, [("all", float(n)), (f"only{n}", 1.0)])
    before = state()
    assert live.compact(spark, path, ["instrument"]) == 11 and state() == before and len(before) == 13
    read = {f.split("/out")[1].split("/")[0] for f in (r[0] for r in live._since(spark, path).select(F.input_file_name()).distinct().collect())}
    assert read == {"-snapshots"}
    write(12, [("all", 99.0)])
    assert state() == before | {"all": 99.0}
    (tmp_path / "out-snapshots" / "upto=12").mkdir()  # a snapshot that was broken off
    assert state() == before | {"all": 99.0} and live.compact(spark, path, ["instrument"]) == 12 and state() == before | {"all": 99.0}
