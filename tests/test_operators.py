"""Cross-section, votes, alerts, portfolios, texts, companies, models."""

import itertools
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from helpers import START, walk
from pyspark.sql import functions as F

from barlake.functions.company import rating
from barlake.functions.numeric import clamp, fixed, magnitude
from barlake.functions.text import hits, sentiment, words
from barlake.functions.votes import combined_votes, majority
from barlake.operators import companies, ensemble, features, fundamentals, models, monitor, optimise, portfolio
from barlake.operators.crosssection import aligned_returns, correlations, low_correlation_pairs, pair_moments, portfolio_statistics
from barlake.operators.series import index_rows
from barlake.operators.weights import best, candidate_weights, with_sharpe

# prediction, price, rsi, macd, signal line, average, sentiment -> votes (ml rsi macd trend sentiment), direction, confidence
VOTES = [
    (0.70, 150, 30, 2.5, 1.0, 145, 0.3, "UUUUU", "UP", 100), (0.30, 150, 75, -1.0, 0.5, 160, -0.4, "DDDDD", "DOWN", 100),
    (0.60, 150, 30, 2.5, 1.0, 155, -0.2, "UUUDD", "UP", 60), (0.40, 150, 70, -1.0, 0.5, 160, -0.3, "DDDDD", "DOWN", 100),
    (0.55, 150, 50, 2.5, 1.0, 155, -0.3, "NNUDD", "DOWN", 67), (0.50, 150, 30, 2.5, 1.0, 145, 0.3, "NUUUU", "UP", 100),
    (0.50, 150, 25, 0.0, 0.0, 150, 0.0, "NUNNN", "UP", 100), (0.50, 150, 80, 0.0, 0.0, 150, 0.0, "NDNNN", "DOWN", 100),
    (0.50, 150, 50, 2.0, 1.0, 150, 0.0, "NNUNN", "UP", 100), (0.50, 150, 50, -1.0, 0.5, 150, 0.0, "NNDNN", "DOWN", 100),
    (0.50, 155, 50, 0.0, 0.0, 150, 0.0, "NNNUN", "UP", 100), (0.50, 145, 50, 0.0, 0.0, 150, 0.0, "NNNDN", "DOWN", 100),
    (0.50, 150, 50, 0.0, 0.0, 150, 0.3, "NNNNU", "UP", 100), (0.50, 150, 50, 0.0, 0.0, 150, -0.3, "NNNND", "DOWN", 100),
    (0.60, 150, 40, 1.0, 0.5, 148, 0.2, "UNUUU", "UP", 100), (0.50, 150, 50, 0.0, 0.0, 0, 0.0, "NNNNN", "UNCERTAIN", 0),
]


def test_votes(spark):
    names = ["p", "price", "rsi", "macd", "line", "avg", "s"]
    frame = spark.createDataFrame([(i, *map(float, row[:7])) for i, row in enumerate(VOTES)], ["i", *names])
    voted = frame.withColumns(combined_votes("p", "price", "rsi", "macd", "line", "avg", "s"))
    cast = {v: F.col(f"{v}_vote") for v in ("ml", "rsi", "macd", "trend", "sentiment")}
    for row in voted.withColumns(majority(cast)).collect():
        *_, letters, direction, confidence = VOTES[row.i]
        assert "".join(row[f"{v}_vote"][0] for v in cast) == letters
        assert (row.direction, row.confidence) == (direction, confidence)
        assert (row.up_votes, row.down_votes, row.neutral_votes) == tuple(letters.count(x) for x in "UDN")


def test_missing_votes_are_neutral(spark):
    frame = spark.sql("SELECT double(null) p, 10D price, double(null) rsi, double(null) macd, double(null) line, double(null) avg, double(null) s")
    row = frame.withColumns(combined_votes("p", "price", "rsi", "macd", "line", "avg", "s")).first()
    assert {row[f"{v}_vote"] for v in ("ml", "rsi", "macd", "trend", "sentiment")} == {"NEUTRAL"}


def market(spark, names="ABCDE", drop=0.1):
    rng = np.random.default_rng(5)
    rows = pd.concat([walk(n, 150, i).sample(frac=1 - drop, random_state=i) for i, n in enumerate(names)])
    return rows.assign(sector=np.where(rows.instrument.isin(list("AB")), "s", "t")), rng


@pytest.mark.parametrize("align", ["all_present", "pad"])
@pytest.mark.parametrize("block_rows", [20, 8192])
def test_aligned_returns(spark, align, block_rows):
    rows, _ = market(spark)
    got = aligned_returns(spark.createDataFrame(rows), "sector", align, block_rows).toPandas()
    for sector, part in rows.groupby("sector"):
        wide = part.pivot(index="ts", columns="instrument", values="close").sort_index()
        wide = wide.dropna() if align == "all_present" else wide.ffill()
        expected = wide.pct_change(fill_method=None).dropna()
        ours = got[got.sector == sector].pivot(index="ts", columns="instrument", values="ret").sort_index()
        np.testing.assert_allclose(ours.to_numpy(), expected.to_numpy())
        assert list(ours.index) == list(expected.index)


@pytest.mark.parametrize("tile", [1, 2, 256])
def test_pair_moments(spark, tile):
    rows, _ = market(spark, "ABCDEFG")
    rows["sector"] = "all"
    returns = aligned_returns(spark.createDataFrame(rows), "sector").persist()
    wide = returns.toPandas().pivot(index="ts", columns="instrument", values="ret")
    got = pair_moments(returns, tile=tile, chunk_seconds=20 * 86400).toPandas().set_index(["a", "b"])
    assert len(got) == 28
    for a, b in combinations("ABCDEFG", 2):
        assert got["cov"][a, b] == pytest.approx(wide[a].cov(wide[b]))
        assert got["corr"][a, b] == pytest.approx(wide[a].corr(wide[b]))
    assert got.var_a["C", "C"] == pytest.approx(wide.C.var()) and got.n["A", "B"] == len(wide)


def test_low_correlations_and_p_values(spark):
    rows, _ = market(spark)
    moments = pair_moments(aligned_returns(spark.createDataFrame(rows.assign(sector="x")), "sector")).persist()
    pairs = correlations(moments).toPandas()
    assert pairs.correlation.between(-1, 1).all() and pairs.p_approx.between(0, 1).all()
    low = low_correlation_pairs(moments, 0.3, 4).toPandas()
    assert len(low) == 4 and low.correlation.abs().is_monotonic_increasing


def test_weight_search(spark):
    rows, _ = market(spark, "ABC")
    rows["sector"] = "x"
    returns = aligned_returns(spark.createDataFrame(rows), "sector").persist()
    moments = pair_moments(returns).persist()
    wide = returns.toPandas().pivot(index="ts", columns="instrument", values="ret")
    grid = [np.array([i, j, 10 - i - j]) / 10 for i in range(11) for j in range(11 - i)]
    risk = lambda w: np.sqrt(w @ wide.cov().to_numpy() @ w * 252)
    gain = lambda w: wide.mean().to_numpy() @ w * 252
    candidates = with_sharpe(candidate_weights(moments, "sector", 3, 10)).persist()
    assert candidates.count() == len(grid) and candidates.filter("abs(w1 + w2 + w3 - 1) > 1e-9").count() == 0
    calm = best(candidates, "sector", 3, "volatility").first()
    assert calm.volatility == pytest.approx(min(map(risk, grid)))
    sharp = best(candidates, "sector", 3, "sharpe").first()
    assert sharp.sharpe == pytest.approx(max((gain(w) - 0.02) / risk(w) for w in grid))
    aimed = best(candidates, "sector", by="volatility", target_return=calm.annual_return).first()
    assert aimed.volatility == pytest.approx(calm.volatility)
    pair = moments.filter("a <> 'C' AND b <> 'C'").withColumn("sector", F.lit("y"))
    mixed = best(with_sharpe(candidate_weights(moments.unionByName(pair), "sector", step_percent=10)), "sector", by="volatility").collect()
    assert {r.sector: r.w3 is None for r in mixed} == {"x": False, "y": True}
    w = np.array([0.2, 0.3, 0.5])
    held = spark.createDataFrame([("x", n, float(x)) for n, x in zip("ABC", w)], "sector string, instrument string, weight double")
    stats = portfolio_statistics(moments, held, "sector").first()
    assert (stats.annual_return, stats.volatility) == (pytest.approx(gain(w)), pytest.approx(risk(w)))


def test_first_triggers(spark):
    rows = walk("A", 300, 9).assign(rsi=np.linspace(20, 80, 300))
    indexed = index_rows(spark.createDataFrame(rows), ["instrument"])
    rng = np.random.default_rng(1)
    kinds = ("price_above", "price_below", "rsi_above", "rsi_below")
    alerts = pd.DataFrame(
        {"id": range(80), "instrument": "A", "alert_type": [kinds[i % 4] for i in range(80)], "created_at": START + pd.to_timedelta(rng.integers(0, 300, 80), unit="D"), "active": True, "triggered": False}
    )
    alerts["value"] = np.where(alerts.index % 4 < 2, rng.uniform(rows.close.min() - 1, rows.close.max() + 1, 80), rng.uniform(15, 85, 80))
    got = monitor.first_triggers(spark.createDataFrame(alerts), indexed, search_rows=16).toPandas().set_index("id")
    for a in alerts.itertuples():
        seen = rows.rsi if a.alert_type.startswith("rsi") else rows.close
        hit = rows[(rows.ts >= a.created_at) & ((seen > a.value) if a.alert_type.endswith("above") else (seen < a.value))]
        assert got.triggered[a.id] == (len(hit) > 0)
        if len(hit):
            assert got.triggered_at[a.id] == hit.ts.iloc[0] and got.triggered_value[a.id] == pytest.approx(seen[hit.index[0]])


def test_equal_alerts_are_looked_up_once(spark):
    """Alerts with one question, and one alert that stands twice, each get their row."""
    rows = pd.concat([walk(name, 60, 9).assign(rsi=50.0) for name in "AB"])
    indexed = index_rows(spark.createDataFrame(rows), ["instrument"])
    low, start = float(rows.close.min()) - 1, START.to_pydatetime()
    alerts = [(i // 2, "AB"[i % 2], "price_above", low, start, True, False) for i in range(400)] + [(1000, "A", "rsi_above", None, start, True, False), (1001, "A", "rsi_above", 90.0, None, True, False)]
    frame = spark.createDataFrame(alerts, "id long, instrument string, alert_type string, value double, created_at timestamp, active boolean, triggered boolean")
    told = monitor.first_triggers(frame, indexed, search_rows=16)
    got = told.toPandas()
    assert len(got) == 402 and set(got.id[~got.triggered]) == {1000, 1001} and (got.triggered_at.dropna() == START).all()
    open_ = monitor.select_alerts(told, "a")
    assert {r.id for r in open_.collect()} == {1000, 1001}


def test_cash_account(spark):
    rows = [
        (1, 1, "A", "BUY", 10.0, 100.0), (1, 2, "B", "BUY", 1.0, 99500.0), (1, 3, "A", "SELL", 20.0, 120.0), (1, 4, "A", "SELL", 4.0, 120.0),
        (1, 5, "A", "BUY", 6.0, 200.0), (1, 6, "B", "SELL", 1.0, 5.0), (1, 7, "A", "SELL", 12.0, 50.0), (2, 1, "A", "BUY", 1000.0, 100.0),
    ]
    frame = spark.createDataFrame(rows, "portfolio long, seq long, instrument string, action string, shares double, price double")
    got = portfolio.cash_account(frame, ["seq"]).orderBy("portfolio", "seq").collect()
    assert [r.accepted for r in got] == [True, False, False, True, True, False, True, True]
    assert got[3].profit == pytest.approx(80) and got[4].avg_price_after == pytest.approx(150) and got[6].profit == pytest.approx(-1200)
    assert got[6].cash_after == pytest.approx(100000 - 1000 + 480 - 1200 + 600) and got[7].cash_after == 0
    book = portfolio.position_book(frame, ["seq"]).orderBy("portfolio", "seq").collect()
    assert [r.accepted for r in book] == [True, True, False, True, True, True, True, True]
    kept = portfolio.open_positions(portfolio.position_book(frame, ["seq"]), ["seq"])
    assert [(r.portfolio, r.instrument, r.shares) for r in kept.collect()] == [(2, "A", 1000.0)]
    prices = spark.createDataFrame([("Z", 1.0)], "instrument string, current_price double")
    assert portfolio.valued_positions(kept, prices).first().current_value == 100000
    assert portfolio.valued_positions(kept, prices, "zero").first().current_value == 0


def test_cash_account_of_many_batches(spark):
    rng = np.random.default_rng(11)
    n = 4000
    rows = pd.DataFrame({"portfolio": rng.integers(0, 3, n), "seq": range(n), "instrument": rng.choice(["A", "B"], n), "action": rng.choice(["BUY", "SELL"], n), "shares": rng.integers(1, 200, n).astype(float), "price": rng.integers(1, 50, n).astype(float)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = portfolio.cash_account(spark.createDataFrame(rows), ["seq"], 5000.0).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    flow = np.where(got.action == "BUY", -1, 1) * got.shares * got.price * got.accepted
    for _, part in got.assign(flow=flow).sort_values("seq").groupby("portfolio"):
        np.testing.assert_allclose(part.cash_after, 5000 + part.flow.cumsum())
        assert (part.cash_after >= 0).all() and (part.shares_after >= 0).all() and part.accepted.any() and not part.accepted.all()


def test_sentiment(spark):
    texts = [("Shares SURGE to record high on strong buy", 6, 0), ("sell-off after fraud, profit down", 1, 3), ("nothing here", 0, 0), ("upbeat upgrade", 1, 0)]
    frame = spark.createDataFrame([(t,) for t, *_ in texts], "title string").withColumn("w", words(F.col("title")))
    got = frame.withColumns(hits(F.col("title"), F.col("w"))).withColumns(sentiment(F.col("bullish"), F.col("bearish"))).collect()
    # surge 1, buy 1, two phrases of 2; of the hyphenated word only "sell" counts
    assert [(r.bullish, r.bearish) for r in got] == [(b, s) for _, b, s in texts]
    assert [r.label for r in got] == ["bullish", "bearish", "neutral", "bullish"]
    assert [r.confidence for r in got] == [100, 80, 0, 20]


def test_companies(spark):
    directory = spark.createDataFrame([("AAA", "Alpha Air", "Energy"), ("BBB", "Beta", "Finance")], "instrument string, name string, sector string")
    assert {r.instrument for r in companies.search(directory, "air").collect()} == {"AAA"}
    assert {r.instrument for r in companies.search(directory, "FINAN").collect()} == {"BBB"}
    assert companies.search(directory, "zzz").collect()[0] == ("ZZZ", "Not in the directory", "Custom")
    assert companies.search(directory, "not there").count() == 0
    row = spark.sql("SELECT ' a, b ,,C' AS s").select(companies.symbols(F.col("s")).alias("x")).first()
    assert row.x == ["A", "B", "C"]


def test_numbers(spark):
    row = spark.range(1).select(
        fixed(F.lit(2.345), 2).alias("f"), magnitude(F.lit(2.5e9)).alias("b"), magnitude(F.lit(-3.14e6)).alias("m"), magnitude(F.lit(None).cast("double")).alias("n"),
        clamp(F.lit(None).cast("double"), 0, 1).alias("c"), rating(F.lit(60)).alias("r"),
    ).first()
    assert (row.b, row.m, row.n, row.c, row.r) == ("$2.50B", "-3.1M", "--", None, "Buy")
    assert row.f in (2.34, 2.35)


def test_targets_sequences_and_split(spark):
    rows = walk("A", 90, 2)
    target = features.with_target(spark.createDataFrame(rows), block_rows=16, ahead=2).orderBy("ts").toPandas()
    np.testing.assert_allclose(target.future_price, rows.close.shift(-2).dropna())
    assert target.pos.tolist() == list(range(1, 89)) and (target.n == 88).all()
    scaled = features.min_max_scaled(spark.createDataFrame(target.assign(flat=3.0)), ["close", "flat"])
    assert scaled.filter("flat_scaled <> 0 or close_scaled < 0 or close_scaled > 1").count() == 0
    samples = features.chronological_split(features.sequences(scaled, ["close_scaled"], "future_price", block_rows=61)).orderBy("sample").toPandas()
    assert len(samples) == 28 and (samples.part == "train").sum() == int(28 * 0.8)
    np.testing.assert_allclose([s[0][0] for s in samples.sequence], scaled.orderBy("pos").toPandas().close_scaled[:28])


def test_walk_forward_lines(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=n)
    rows = pd.DataFrame({"instrument": "A", "ts": pd.date_range(START, periods=n), "close": 10.0 + np.arange(n), "sample": range(1, n + 1), "samples": n, "x": x, "y": 2 * x + rng.normal(size=n)})
    got = models.walk_forward(spark.createDataFrame(rows), block_rows=37).toPandas()
    folds = [(k, 252 + 21 * (k - 1)) for k in range(1, 30) if 252 + 21 * (k - 1) + 63 <= n]
    assert len(got) == 63 * len(folds)
    for k, end in folds:
        slope, start = np.polyfit(rows.x[:end], rows.y[:end], 1)
        part = got[got.fold == k].sort_values("sample")
        assert part["sample"].tolist() == list(range(end + 1, end + 64)) and (part.train_end == end).all()
        np.testing.assert_allclose(part.prediction, slope * rows.x[end : end + 63] + start)
    by_model = models.walk_forward(spark.createDataFrame(rows), model=models.LeastSquares()).toPandas().sort_values(["fold", "sample"])
    np.testing.assert_allclose(by_model.prediction, got.sort_values(["fold", "sample"]).prediction)
    assert by_model[["fold", "sample", "train_end", "pos", "test_end"]].astype(int).to_numpy().tolist() == got.sort_values(["fold", "sample"])[["fold", "sample", "train_end", "pos", "test_end"]].astype(int).to_numpy().tolist()


class Mean:
    """A model of another shape: the mean of the labels."""

    def fit(self, samples, by):
        return samples.groupBy(*by).agg(F.avg("y").alias("mean"), F.count("*").alias("size"))

    def score(self, samples, parameters, by):
        return samples.join(parameters, list(by)).withColumn("prediction", F.col("mean"))


def test_any_model_walks_forward_and_predicts(spark):
    rows = pd.DataFrame({"instrument": "A", "ts": pd.date_range(START, periods=360), "close": 1.0, "sample": range(1, 361), "samples": 360, "x": 0.0, "y": np.arange(360.0)})
    got = models.walk_forward(spark.createDataFrame(rows), model=Mean()).groupBy("fold").agg(F.max("size").alias("size"), F.max("prediction").alias("p")).collect()
    assert {r.fold: (r["size"], r.p) for r in got} == {k: (252 + 21 * (k - 1), (251 + 21 * (k - 1)) / 2) for k in (1, 2, 3)}
    bars = spark.createDataFrame(walk("A", 150))
    trained = spark.createDataFrame([("A", "success", 0.25)], "instrument string, status string, mean double")
    assert models.next_value(index_rows(bars, ("instrument",)), trained, model=Mean()).first().prediction == 0.25


def test_binned_means_walk_forward_from_sums(spark):
    rng = np.random.default_rng(8)
    rows = pd.concat([pd.DataFrame({"instrument": name, "ts": pd.date_range(START, periods=n), "close": 1.0, "sample": range(1, n + 1), "samples": n, "x": rng.uniform(-0.1, 1.1, n), "y": rng.uniform(size=n)}) for name, n in (("A", 500), ("B", 314), ("C", 315))])
    rows.loc[(rows.instrument == "A") & rows["sample"].isin([5, 330]), ["x", "y"]] = np.nan, 0.5
    rows.loc[(rows.x > 0.3) & (rows.x < 0.4) & (rows["sample"] < 300), "x"] = 0.95  # a part without samples at first
    frame = spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None)))
    model = models.BinnedMeans()
    got = models.walk_forward(frame, model=model, block_rows=3).toPandas().sort_values(["instrument", "fold", "sample"])
    parted = lambda x: np.clip(np.floor(x * 10), 0, 9)
    assert got.groupby("instrument").fold.max().to_dict() == {"A": 9, "C": 1}
    for (name, k), part in got.groupby(["instrument", "fold"]):
        mine, end = rows[rows.instrument == name], 252 + 21 * (k - 1)
        known = mine[(mine["sample"] <= end) & mine.x.notna()]
        means = known.y.groupby(parted(known.x)).mean()
        wanted = [np.nan if np.isnan(x) else means.get(parted(x), known.y.mean()) for x in mine[(mine["sample"] > end) & (mine["sample"] <= end + 63)].x]
        np.testing.assert_allclose(part.prediction.to_numpy(float), wanted)
    once = model.score(frame, model.fit(frame, ["instrument"]), ["instrument"]).toPandas()
    assert once.prediction.isna().sum() == 2 and abs(once.prediction.mean() - 0.5) < 0.1


def test_loss_curve(spark):
    curve = [5.0, 4.0, 4.5, 3.0] + [3.5] * 20
    history = spark.createDataFrame([("a", curve), ("b", [3.0, 2.0, 1.0])], "model string, val_loss array<double>")
    got = {r.model: r for r in models.loss_curve(models.epochs_of(history)).collect()}
    assert (got["a"].best_epoch, got["a"].stop_epoch, got["a"].epochs) == (4, 19, 24)
    assert got["b"].stop_epoch is None and got["b"].last_loss == 1.0


def test_lexicon_as_a_table(spark):
    from barlake.functions import text

    rows = spark.createDataFrame([(1, "Profit up, profit up on the news"), (2, "loss of a deal"), (3, None), (4, "")], "id long, text string")
    terms = spark.createDataFrame([("profit", "bullish"), ("on the", "bullish"), ("Loss", "bearish"), ("loss of a", "bearish")], "term string, polarity string")
    assert {tuple(r) for r in text.table_hits(rows, terms, "id").collect()} == {(1, 3, 0), (2, 0, 3), (3, 0, 0), (4, 0, 0)}


def test_cash_account_sells_all_and_never_overdraws(spark):
    trades = [("p", 1, "A", "BUY", 100.0, 500.0), ("p", 2, "B", "BUY", 300.0, 200.0), ("p", 3, "A", "SELL", None, 600.0), ("p", 4, "B", "BUY", 10.0, 200.0), ("p", 5, "A", "SELL", None, 1.0), ("q", 1, "A", "SELL", 1.0, 1.0)]
    frame = spark.createDataFrame(trades, "portfolio string, seq long, instrument string, action string, shares double, price double")
    account = portfolio.cash_account(frame, ("seq",))
    got = [(r.accepted, r.shares_after, r.profit if r.profit == r.profit else None, r.cash_after) for r in account.orderBy("portfolio", "seq").collect()]
    assert got == [(True, 100.0, None, 50000.0), (False, 0.0, None, 50000.0), (True, 0.0, 10000.0, 110000.0), (True, 10.0, None, 108000.0), (False, 0.0, None, 108000.0), (False, 0.0, None, 100000.0)]
    assert {(r.portfolio, r.current_cash) for r in portfolio.cash_left(account, ("seq",)).collect()} == {("p", 108000.0), ("q", 100000.0)}


def test_account_goes_on_over_batches(spark):
    """A portfolio longer than an Arrow batch, against a plain loop."""
    rng = np.random.default_rng(8)
    n = 3000
    rows = [("p" if i < 2500 else f"q{i % 7}", i, "ABC"[rng.integers(3)], "BUY" if rng.random() < 0.55 else "SELL", float(rng.integers(1, 50)), float(rng.integers(10, 400))) for i in range(n)]
    frame = spark.createDataFrame(rows, "portfolio string, seq long, instrument string, action string, shares double, price double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    got = {r.seq: (r.accepted, r.shares_after, r.cash_after) for r in portfolio.cash_account(frame, ("seq",)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    cash, held = {}, {}
    for p, i, who, action, shares, price in rows:
        money, have = cash.get(p, 100000.0), held.get((p, who), 0.0)
        ok = shares * price <= money if action == "BUY" else 0 < shares <= have
        if ok:
            sign = 1 if action == "BUY" else -1
            money, have = money - sign * shares * price, have + sign * shares
        cash[p], held[p, who] = money, have
        assert got[i] == (ok, have, money)


# ---------------------------------------------------------------- weights of any size


def asset_moments(rng, sizes, shift=0.0):
    """Rows (grp, a, b, mean_a, cov) of random groups, with the arrays behind them."""
    rows, known = [], {}
    for g, k in sizes.items():
        base = rng.normal(0, 0.02, (k + 30, k)) + rng.normal(0, 0.01, (k + 30, 1))
        mean, cov = base.mean(axis=0) + shift, np.cov(base.T).reshape(k, k)
        names = [f"{g}{i:04d}" for i in range(k)]
        known[g] = names, mean * 252, cov * 252
        rows += [(g, names[i], names[j], float(mean[i]), float(cov[i, j])) for i in range(k) for j in range(i, k)]
    return rows, known


def on_simplex(cov, gain, steps):
    """Weights on a grid, all of them."""
    k = len(gain)
    cuts = itertools.combinations(range(steps + k - 1), k - 1)
    return np.array([np.diff([-1, *c, steps + k - 1]) - 1 for c in cuts]) / steps


@pytest.mark.parametrize("active", [4, 32])
def test_optimal_weights_of_small_and_large_groups(spark, active):
    """Groups of 1, 3, 5 and 40 in one run: no grid point is better, and no asset's price is below the solution's."""
    rows, known = asset_moments(np.random.default_rng(3), {"a": 1, "b": 3, "c": 5, "d": 40})
    moments = spark.createDataFrame(rows, "grp string, a string, b string, mean_a double, cov double")
    for goal in ("volatility", "sharpe"):
        found = {}
        for r in optimise.optimal_weights(moments, "grp", goal, active=active).collect():
            found.setdefault(r.grp, {})[r.instrument] = r
        assert set(found) == set(known)
        for g, (names, gain, cov) in known.items():
            w = np.array([found[g][x].weight if x in found[g] else 0.0 for x in names])
            one = next(iter(found[g].values()))
            assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
            assert np.isclose(one.annual_return, w @ gain) and np.isclose(one.volatility, np.sqrt(w @ cov @ w))
            excess, slope = gain - 0.02, cov @ w
            if goal == "volatility":
                assert (slope >= w @ slope * (1 - 1e-6)).all()
            elif (excess > 0).any():
                assert (slope * (w @ excess) - excess * (w @ slope) >= -1e-8).all()
            if len(names) in (3, 5):
                grid = on_simplex(cov, gain, 20)
                spread = np.sqrt(np.einsum("ij,jk,ik->i", grid, cov, grid))
                best = spread.min() if goal == "volatility" else ((grid @ excess) / spread).max()
                ours = one.volatility if goal == "volatility" else one.sharpe
                assert ours <= best + 1e-9 if goal == "volatility" else ours >= best - 1e-9
                assert abs(ours - best) < 0.02 * abs(best)


def test_optimal_weights_where_nothing_earns(spark):
    """No asset above the risk-free rate: the one with the least loss for its risk, also in groups that need pricing."""
    rows, known = asset_moments(np.random.default_rng(4), {"a": 4, "b": 50}, shift=-0.02)
    moments = spark.createDataFrame(rows, "grp string, a string, b string, mean_a double, cov double")
    found = optimise.optimal_weights(moments, "grp", "sharpe", active=8).collect()
    for g, (names, gain, cov) in known.items():
        best = names[int(np.argmax((gain - 0.02) / np.sqrt(np.diag(cov))))]
        assert [(r.instrument, r.weight) for r in found if r.grp == g] == [(best, 1.0)]


@pytest.mark.parametrize("active", [4, 32])
def test_frontier_against_a_grid(spark, active):
    rows, known = asset_moments(np.random.default_rng(5), {"a": 2, "b": 4, "c": 20})
    moments = spark.createDataFrame(rows, "grp string, a string, b string, mean_a double, cov double")
    targets = {(r.grp, r.spot): r.target for r in optimise.frontier_targets(moments, "grp", 8).collect()}
    weights = optimise.optimal_weights(moments, "grp", "target", targets=optimise.frontier_targets(moments, "grp", 8), active=active)
    held = {}
    for r in weights.collect():
        held.setdefault((r.grp, r.spot), {})[r.instrument] = r
    reached = {k for k, t in targets.items() if known[k[0]][1].min() <= t <= known[k[0]][1].max()}
    assert set(held) == reached and reached != set(targets)
    for (g, spot), found in held.items():
        names, gain, cov = known[g]
        w = np.array([found[x].weight if x in found else 0.0 for x in names])
        assert abs(w.sum() - 1) < 1e-8 and abs(w @ gain - targets[g, spot]) < 1e-8
        if g == "b":
            grid = on_simplex(cov, gain, 60)
            near = grid[np.abs(grid @ gain - targets[g, spot]) < 0.02 * np.ptp(gain)]
            if len(near):
                spread = np.sqrt(np.einsum("ij,jk,ik->i", near, cov, near))
                assert next(iter(found.values())).volatility <= spread.min() * 1.03
        if g == "c":  # the same from the small problem over all assets
            low, high = int(np.argmin(gain)), int(np.argmax(gain))
            start = np.zeros(len(gain))
            start[high] = (targets[g, spot] - gain[low]) / (gain[high] - gain[low])
            start[low] += 1 - start[high]
            best, _ = optimise.least_variance(cov, np.stack([np.ones(len(gain)), gain]), np.array([1.0, targets[g, spot]]), start)
            assert np.isclose(w @ cov @ w, best @ cov @ best, rtol=1e-6)


def test_weights_of_no_group(spark):
    none = spark.createDataFrame([], "grp string, a string, b string, mean_a double, cov double")
    assert optimise.optimal_weights(none, "grp").count() == 0 and optimise.frontier(none, "grp").count() == 0
    with pytest.raises(ValueError):
        optimise.optimal_weights(none, "grp", "target")


# ---------------------------------------------------------------- fitted members


def test_fitted_members_line_up(spark, tmp_path):
    """Members on one line of samples: each close to the truth, their blend between them, the same after saving and loading."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    rows = [(k, i, Vectors.dense(x := rng.uniform(-1, 1, 3)), float(2 * x[0] - x[1])) for k in "ab" for i in range(1, 151)]
    samples = spark.createDataFrame(rows, ["instrument", "sample", "features", "label"])
    members = {"rf": models.random_forest(numTrees=10, maxDepth=5), "gb": ensemble.boosting_with_stop(maxIter=15, maxDepth=3), "linear": ensemble.linear(regParam=0.0)}
    fitted = ensemble.fit_members(samples.filter("sample <= 120"), members)
    ensemble.save_members(fitted, str(tmp_path))
    loaded = ensemble.load_members(spark, list(members), str(tmp_path))
    weights = {"rf": 0.15, "gb": 0.15, "linear": 0.3, "absent": 0.4}
    test = samples.filter("sample > 120")
    first = ensemble.ensemble_predictions(test, fitted, weights).orderBy("instrument", "sample").collect()
    again = ensemble.ensemble_predictions(test, loaded, weights).orderBy("instrument", "sample").collect()
    assert len(first) == 60 and [r.ensemble for r in first] == [r.ensemble for r in again]
    for r in first:
        assert abs(r.linear - r.label) < 1e-6 and abs(r.rf - r.label) < 1.5
        assert np.isclose(r.ensemble, (0.15 * r.rf + 0.15 * r.gb + 0.3 * r.linear) / 0.6)
    whole = ensemble.ensemble_predictions(test, fitted, weights, renormalise=False).first()
    assert np.isclose(whole.ensemble, 0.15 * whole.rf + 0.15 * whole.gb + 0.3 * whole.linear)
    scores = {r.member: r for r in ensemble.evaluate(ensemble.ensemble_predictions(test, fitted, weights), fitted).collect()}
    assert set(scores) == {"rf", "gb", "linear", "ensemble"} and scores["linear"].mse < 1e-9 < scores["rf"].mse


def test_boosting_stops_where_held_out_samples_get_no_better(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    rows = [("a", i, Vectors.dense(rng.uniform(-1, 1, 2)), float(rng.normal())) for i in range(1, 201)]  # nothing to learn
    samples = spark.createDataFrame(rows, ["instrument", "sample", "features", "label"])
    stopped = ensemble.fit_members(samples, {"gb": ensemble.boosting_with_stop(maxIter=30, maxDepth=3)})["gb"]
    assert stopped.getNumTrees < 30


def test_samples_are_gathered_by_their_own_number(spark):
    """Few samples out of many partitions are fitted in few tasks; none goes and none comes."""
    few = models.gathered(spark.range(3000).repartition(150).withColumn("x", F.lit(1.0)))
    assert few.rdd.getNumPartitions() == 2 and sorted(r.id for r in few.collect()) == list(range(3000))
    assert models.gathered(spark.range(0)).count() == 0


def test_record_keeps_the_empty_date(spark):
    info = spark.createDataFrame([("A", 10.0, None), ("B", None, "2024-05-01")], "instrument string, trailingPE double, exDividendDate string")
    got = {r.instrument: r.dividends for r in fundamentals.grouped_record(fundamentals.fundamentals(info)).collect()}
    assert got == {"A": {"ex_dividend_date": ""}, "B": {"ex_dividend_date": "2024-05-01"}}
    assert fundamentals.valuation_comparison(fundamentals.fundamentals(info)).count() == 2
    assert fundamentals.valuation_comparison(fundamentals.fundamentals(info), ["B"]).count() == 1


def test_record_shows_large_numbers_as_digits(spark):
    """As SQL casts a double to text: no exponent from ten millions on."""
    values = [15729095.58, -12345678.5, 162404958.0, 9999999.9, 0.004, 2.5, 1000000000000.25, None]
    info = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "instrument string, totalCash double")
    got = {r.instrument: r.financial_health.get("total_cash") for r in fundamentals.grouped_record(fundamentals.fundamentals(info)).collect()}
    assert got == dict(zip("01234567", ["15729095.58", "-12345678.5", "162404958.0", "9999999.9", "0.0", "2.5", "1000000000000.25", None]))


def test_loss_curve_over_blocks(spark):
    """A curve longer than a block, with ties and lost epochs, against a plain pass."""
    rng = np.random.default_rng(8)
    losses = np.round(np.maximum(1.0, 40 - np.arange(20_000) / 300) + rng.integers(0, 5, 20_000) / 2, 2).tolist()
    rows = [("a", i, v) for i, v in enumerate(losses)] + [("a", 30_000, None), ("b", 5, 2.0), ("b", 9, 2.0)]
    best, at, stop = None, 0, None
    for i, v in enumerate(losses, 1):
        if best is None or v < best:
            best, at = v, i
        elif stop is None and i - at >= 40:
            stop = i
    got = {r.model: r for r in models.loss_curve(spark.createDataFrame(rows, "model string, epoch int, val_loss double"), 40).collect()}
    assert tuple(got["a"])[1:] == (20_000, best, at, losses[-1], stop) and tuple(got["b"])[1:] == (2, 2.0, 1, 2.0, None)


def test_low_correlation_pairs_of_each_group(spark):
    rng = np.random.default_rng(12)
    rows = [(g, f"{g}{i}", f"{g}{j}", float(np.round(rng.uniform(-1, 1), 3)), 50) for g in "xy" for i in range(9) for j in range(i, 9)]
    moments = spark.createDataFrame(rows, "grp string, a string, b string, corr double, n long")
    got = [tuple(r) for r in low_correlation_pairs(moments, 0.4, 4, "grp").collect()]
    for g in "xy":
        want = sorted((abs(c), a, b) for h, a, b, c, _ in rows if h == g and a != b and abs(c) <= 0.4)[:4]
        assert [(k, a, b) for h, k, a, b, *_ in got if h == g] == [(i + 1, a, b) for i, (_, a, b) in enumerate(want)]
