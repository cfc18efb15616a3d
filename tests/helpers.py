"""Series for the tests and plain pandas versions of what the operators compute."""

import numpy as np
import pandas as pd

START = pd.Timestamp("2020-01-01")


def walk(instrument: str, n: int, seed: int = 1, freq: str = "D") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    close = np.round(np.maximum(close, 5), 2)
    opening = np.round(close + rng.normal(0, 0.5, n), 2)
    high = np.round(np.maximum(close, opening) + rng.uniform(0, 1, n), 2)
    low = np.round(np.minimum(close, opening) - rng.uniform(0, 1, n), 2)
    volume = rng.integers(1, 1000, n).astype(float)
    ts = pd.date_range(START, periods=n, freq=freq)
    return pd.DataFrame({"instrument": instrument, "ts": ts, "open": opening, "high": high, "low": low, "close": close, "volume": volume})


def shaped(instrument: str, close: list[float], volume: float = 10.0) -> pd.DataFrame:
    c = np.array(close, dtype=float)
    ts = pd.date_range(START, periods=len(c), freq="D")
    return pd.DataFrame({"instrument": instrument, "ts": ts, "open": c, "high": c, "low": c, "close": c, "volume": volume})


def _widths(n: int) -> dict:
    from barlake.operators.indicators import SIZES

    return {name: min(top, max(bottom, n // part)) for name, (top, bottom, part) in SIZES.items()}


def plain_indicators(bars: pd.DataFrame) -> pd.DataFrame:
    """One series, pandas rolling windows."""
    b = bars.sort_values("ts").reset_index(drop=True)
    w = _widths(len(b))
    c, h, lo, v = b.close, b.high, b.low, b.volume
    out = b.copy()
    mean = lambda s, k: s.rolling(w[k]).mean()
    smooth = lambda s, k: s.ewm(span=w[k], adjust=False).mean()

    def strength(up, down):
        value = 100 - 100 / (1 + up / down.where(down != 0))
        return value.mask((down == 0) & (up > 0), 100.0)

    move = c.diff().fillna(0)
    out["sma_20"], out["sma_50"] = mean(c, "sma_20"), mean(c, "sma_50")
    out["ema_12"], out["ema_26"] = smooth(c, "ema_12"), smooth(c, "ema_26")
    out["rsi"] = strength(mean(move.clip(lower=0), "rsi"), mean((-move).clip(lower=0), "rsi"))
    out["macd"] = out.ema_12 - out.ema_26
    out["macd_signal"] = smooth(out.macd, "macd_signal")
    out["bb_upper"] = mean(c, "bollinger") + 2 * c.rolling(w["bollinger"]).std()
    before = c.shift()
    reach = np.fmax(h - lo, np.fmax((h - before).abs(), (lo - before).abs()))
    out["atr"] = mean(reach, "atr")
    bottom, top = lo.rolling(w["stochastic"]).min(), h.rolling(w["stochastic"]).max()
    span = (top - bottom).where(top != bottom)
    out["stoch_k"] = (c - bottom) / span * 100
    out["stoch_d"] = mean(out.stoch_k, "stochastic_d")
    out["williams_r"] = -100 * (top - c) / span
    out["obv"] = (np.sign(c.diff()) * v).fillna(0).cumsum()
    tp = (h + lo + c) / 3
    out["vwap"] = (v * tp).cumsum() / v.cumsum()
    gone = tp.diff()
    flow = lambda cond: (tp * v).where(cond, 0).rolling(w["mfi"]).sum()
    out["mfi"] = strength(flow(gone > 0), flow(gone < 0))
    spread = tp.rolling(w["cci"]).apply(lambda x: np.mean(np.abs(x - np.mean(x))), raw=True)
    out["cci"] = (tp - mean(tp, "cci")) / (0.015 * spread.where(spread != 0))
    rise, sink = h.diff(), -lo.diff()
    plus = rise.where((rise > sink) & (rise > 0), 0)
    minus = sink.where((sink > plus) & (sink > 0), 0)
    width = mean(reach, "adx")
    pdi, mdi = 100 * mean(plus, "adx") / width, 100 * mean(minus, "adx") / width
    total = (pdi + mdi).where(pdi + mdi != 0)
    out["adx"] = mean(100 * (pdi - mdi).abs() / total, "adx")
    out["rsi_divergence"] = c / c.shift(5) - 1 - (out.rsi / out.rsi.shift(5).where(out.rsi.shift(5) != 0) - 1)
    out["roc_20"] = (c / c.shift(w["roc_20"]) - 1) * 100
    out["ewma_volatility"] = ((c / before - 1) * 100).ewm(span=w["ewma"]).std() * np.sqrt(252)
    return out


def plain_ledger(prices, signals, initial=10000.0, cost=0.001):
    """Row by row: equity after each row, final capital, profits of the sales."""
    cash, units, paid, curve, profits = initial, None, 0.0, [], []
    for price, signal in zip(prices, signals):
        if units is None and signal == 1:
            units = cash / price
            paid = cash * (1 + cost)
            cash -= paid
        elif units is not None and signal == -1:
            got = units * price * (1 - cost)
            cash, units = cash + got, None
            profits.append(got - paid)
        curve.append(cash if units is None else cash + units * price)
    if units is not None:
        got = units * prices[-1] * (1 - cost)
        cash += got
        profits.append(got - paid)
    return curve, cash, profits
