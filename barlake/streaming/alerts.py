"""Price and RSI alerts on a live stream, with keyed state: nothing that was written before is read again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barlake.streaming.live import to_batches

RSI_BARS = 14
ALERT = "id string, alert_type string, value double"
FIRED = f"instrument string, {ALERT}, triggered_at timestamp, triggered_value double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rolling_rsi(closes: np.ndarray, fresh: bool, bars: int = RSI_BARS) -> np.ndarray:
    """RSI of simple averages over the last `bars` moves, one value a close; NaN while there are fewer, and where nothing moved.

    `fresh`: the first close is the first of its series, whose move counts as zero; else it only starts the moves.
    """
    moves = np.diff(closes, prepend=closes[:1])
    if not fresh:
        moves = moves[1:]
    out = np.full(len(moves), np.nan)
    if len(moves) >= bars:
        seen = np.lib.stride_tricks.sliding_window_view(moves, bars)
        up, down = np.maximum(seen, 0).mean(axis=1), np.maximum(-seen, 0).mean(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[bars - 1 :] = np.where((down == 0) & (up > 0), 100.0, 100 - 100 / (1 + up / down))
    return out if fresh else np.r_[np.nan, out]


class AlertProcessor(StatefulProcessor):
    """State of an instrument: its last closes and the alerts that can still fire. An alert that fires leaves the state."""

    def __init__(self, bars: int = RSI_BARS):
        self.bars = bars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closes = handle.getValueState("closes", "closes array<double>, fresh boolean")
        self.open = handle.getMapState("open", "id string", "alert_type string, value double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for a in initialState.itertuples():
            self.open.updateValue((a.id,), (a.alert_type, float(a.value)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        for a in batch[batch["action"].notna()].itertuples():
            if a.action == "remove":
                self.open.removeKey((a.id,))
            else:
                self.open.updateValue((a.id,), (a.alert_type, float(a.value)))
        seen = batch[batch["action"].isna() & batch["close"].notna()].sort_values("ts", kind="stable")
        if len(seen):
            fired = self._fired(key[0], seen)
            if len(fired):
                yield fired

    def _fired(self, instrument: str, seen: pd.DataFrame) -> pd.DataFrame:
        before, fresh = ([], True) if not self.closes.exists() else (list(self.closes.get()[0]), bool(self.closes.get()[1]))
        closes = np.r_[np.array(before, float), seen["close"].to_numpy(float)]
        rsi = rolling_rsi(closes, fresh, self.bars)[len(before) :]
        price, ts = closes[len(before) :], seen["ts"].to_numpy()
        # the first of the kept closes starts the moves, unless all closes of the series are still there
        self.closes.update((closes[-self.bars - 1 :].tolist(), fresh and len(closes) <= self.bars))
        out = []
        known = ~np.isnan(rsi)
        edges = {"price_above": price.max(), "price_below": price.min(), "rsi_above": rsi[known].max(initial=-np.inf), "rsi_below": rsi[known].min(initial=np.inf)}
        for (id_,), (kind, value) in list(self.open.iterator()):
            up = kind.endswith("above")
            if kind not in edges or not (edges[kind] > value if up else edges[kind] < value):
                continue
            line = rsi if kind.startswith("rsi") else price
            first = int(np.argmax(line > value if up else line < value))
            out.append((instrument, id_, kind, value, ts[first], float(line[first])))
            self.open.removeKey((id_,))
        return pd.DataFrame(out, columns=["instrument", "id", "alert_type", "value", "triggered_at", "triggered_value"])

    def close(self) -> None:
        pass


def fired_alerts(bars: DataFrame, alerts: DataFrame, events: DataFrame | None = None, rsi_bars: int = RSI_BARS) -> DataFrame:
    """Stream of firings: every alert at most once, at the first closed bar whose close or RSI is beyond its level.

    `bars` is a stream (instrument, ts, close, ...) of closed bars, such as `live_bars` in append mode, which come in time order from
    batch to batch. `alerts` (id, instrument, alert_type, value) are open when the query first starts; `events` is a stream of the
    same with `action` ('create' or 'remove'), which counts before the bars of its batch. Rows without an instrument, alerts
    without a level and bars without a close are left out. State per instrument: `rsi_bars` + 1 closes and the open alerts.
    """
    none = {c: F.lit(None).cast(k) for c, k in (("ts", "timestamp"), ("close", "double"), ("action", "string"), ("id", "string"), ("alert_type", "string"), ("value", "double"))}
    columns = ["instrument", *none]
    rows = bars.filter("instrument IS NOT NULL").withColumns({c: x for c, x in none.items() if c not in ("ts", "close")}).select(columns)
    if events is not None:
        changed = events.filter("instrument IS NOT NULL AND (value IS NOT NULL OR action = 'remove')").withColumns({c: none[c] for c in ("ts", "close")})
        rows = rows.unionByName(changed.withColumn("id", F.col("id").cast("string")).select(columns))
    first = alerts.filter("instrument IS NOT NULL AND value IS NOT NULL").select("instrument", F.col("id").cast("string").alias("id"), "alert_type", F.col("value").cast("double").alias("value"))
    return rows.groupBy("instrument").transformWithStateInPandas(AlertProcessor(rsi_bars), FIRED, "Append", "None", first.groupBy("instrument"))


def alert_run(fired: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start `fired_alerts`, each micro-batch in a folder of its own. The state is kept in RocksDB, spilled and checkpointed there."""
    spark: SparkSession = fired.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return to_batches(fired, path, checkpoint, "append", every)
    finally:
        spark.conf.set(_PROVIDER, before)
