"""Recursive indicators (EMA, MACD, RSI, KDJ, ATR): one Arrow-batched fold for each instrument."""

from __future__ import annotations

import numpy as np
import pandas as pd


def smoothed(x: np.ndarray, seed_at: int, seed: float, alpha: float) -> np.ndarray:
    """Exponential smoothing that starts with ``seed`` at ``seed_at``; NaN before."""
    out = np.full(len(x), np.nan)
    if 0 <= seed_at < len(x):
        value = out[seed_at] = seed
        for i in range(seed_at + 1, len(x)):
            value = out[i] = alpha * x[i] + (1 - alpha) * value
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the mean of the first n values in a row that are all there."""
    run = np.convolve(~np.isnan(x), np.ones(n), "valid") if len(x) >= n else np.zeros(0)
    full = np.flatnonzero(run > n - 0.5)
    if not len(full):
        return np.full(len(x), np.nan)
    at = int(full[0]) + n - 1
    return smoothed(x, at, float(x[at - n + 1 : at + 1].mean()), 2 / (n + 1))


def macd(close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dif = ema(close, 12) - ema(close, 26)
    dea = ema(dif, 9)
    return dif, dea, 2 * (dif - dea)


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if len(close) <= n:
        return out
    step = np.r_[0.0, np.diff(close)]
    gain, loss = np.maximum(step, 0), np.maximum(-step, 0)
    up = smoothed(gain, n, float(gain[1 : n + 1].mean()), 1 / n)
    down = smoothed(loss, n, float(loss[1 : n + 1].mean()), 1 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(down > 0, 100 - 100 / (1 + up / down), np.where(up > 0, 100.0, np.nan))
    out[:n] = np.nan
    return out


def kdj(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extremes of the n bars before the current one; K = D = J = 50 at row n - 1."""
    k, d = np.full(len(close), np.nan), np.full(len(close), np.nan)
    if len(close) >= n:
        k[n - 1] = d[n - 1] = 50.0
        for i in range(n, len(close)):
            top, bottom = high[i - n : i].max(), low[i - n : i].min()
            raw = 50.0 if top == bottom else (close[i] - bottom) / (top - bottom) * 100
            k[i] = k[i - 1] * 2 / 3 + raw / 3
            d[i] = d[i - 1] * 2 / 3 + k[i] / 3
    return k, d, 3 * k - 2 * d


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    if len(close) <= n:
        return np.full(len(close), np.nan)
    before = np.r_[np.nan, close[:-1]]
    span = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    return smoothed(span, n - 1, float(span[:n].mean()), 1 / n)


RECURSIVE = "dif dea macd_hist k d j rsi6 rsi14 rsi24 atr14".split()


def recursive_indicators(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("trade_date", kind="stable")
    high, low, close = (frame[c].to_numpy(float) for c in ("high", "low", "close"))
    values = [*macd(close), *kdj(high, low, close), *(rsi(close, n) for n in (6, 14, 24)), atr(high, low, close)]
    return pd.DataFrame({"ts_code": frame["ts_code"], "trade_date": frame["trade_date"], **{n: np.where(np.isnan(v), None, v) for n, v in zip(RECURSIVE, values)}})
