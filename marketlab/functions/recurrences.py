"""Indicators that are true recurrences: pure NumPy kernels, run per instrument in Arrow batches.

A null input gives a null output and leaves the state as it was.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from marketlab.workers import importable

NAN = float("nan")


def rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n, min_periods=n).mean().to_numpy()


def seeded(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential mean from a simple mean of the first n values; where a full window comes back after a hole, its mean enters as the observation."""
    out = np.full(len(x), NAN)
    run, state = 0, NAN
    for i, v in enumerate(x):
        if math.isnan(v):
            run = 0
            continue
        run += 1
        if math.isnan(state):
            if run >= n:
                state = out[i] = float(np.mean(x[i - n + 1 : i + 1]))
        else:
            seen = float(np.mean(x[i - n + 1 : i + 1])) if run == n else v
            state = out[i] = alpha * seen + (1 - alpha) * state
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 2 / (n + 1))


def rma(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 1 / n)


def ewm_std(x: np.ndarray, half_life: float) -> np.ndarray:
    """Bias-corrected exponential standard deviation by half-life; null for the first value."""
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    return pd.Series(x).ewm(halflife=half_life, adjust=False, ignore_na=True, min_periods=2).std().where(~np.isnan(x)).to_numpy()


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, NAN, a / b)


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:  # noqa: E741
    prior = np.concatenate([[NAN], c[:-1]])
    return np.fmax(h - l, np.fmax(abs(h - prior), abs(l - prior)))


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    """No loss: 100; no move at all: 50."""
    d = np.concatenate([[NAN], np.diff(x)])
    gain, loss = rma(np.where(np.isnan(d), NAN, np.maximum(d, 0)), n), rma(np.where(np.isnan(d), NAN, np.maximum(-d, 0)), n)
    out = 100 - 100 / (1 + ratio(gain, loss))
    out = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), out)
    return np.where(np.isnan(gain) | np.isnan(loss), NAN, out)


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if slow <= fast:
        raise ValueError("slow must exceed fast")
    line = ema(x, fast) - ema(x, slow)
    sig = ema(line, signal)
    return line, sig, line - sig


def adx(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    up, down = np.concatenate([[NAN], np.diff(h)]), np.concatenate([[NAN], -np.diff(l)])
    plus = np.where(np.isnan(up), NAN, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), NAN, np.where((down > up) & (down > 0), down, 0.0))
    atr = rma(true_range(h, l, c), n)
    p, m = 100 * ratio(rma(plus, n), atr), 100 * ratio(rma(minus, n), atr)
    return rma(100 * ratio(abs(p - m), p + m), n), p, m


def supertrend(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = 10, k: float = 3.0) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Ratcheting bands about the middle; rows with a null are skipped and the last valid row is used."""
    atr, mid = rma(true_range(h, l, c), n), (h + l) / 2
    line, way = np.full(len(c), NAN), np.full(len(c), NAN)
    up = low = last = NAN
    trend = 0
    for i in range(len(c)):
        if math.isnan(atr[i]) or math.isnan(mid[i]) or math.isnan(c[i]):
            continue
        u, d = mid[i] + k * atr[i], mid[i] - k * atr[i]
        if not trend:
            trend = -1 if c[i] <= u else 1
        else:
            u = u if u < up or last > up else up
            d = d if d > low or last < low else low
            trend = (1 if c[i] > u else -1) if trend < 0 else (-1 if c[i] < d else 1)
        up, low, last = u, d, c[i]
        line[i], way[i] = (d if trend > 0 else u), trend
    return line, way


def stoch_of(x: np.ndarray, n: int) -> np.ndarray:
    s = pd.Series(x).rolling(n, min_periods=n)
    low, high = s.min().to_numpy(), s.max().to_numpy()
    return ratio(100 * (x - low), high - low)


def per_instrument(df: DataFrame, add: Callable[[pd.DataFrame], dict[str, np.ndarray]], columns: list[str]) -> DataFrame:
    """df with the double columns that ``add`` computes from each instrument's rows in time order."""
    names = df.columns
    importable(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_utc", kind="stable")
        return pdf.assign(**add(pdf))[[*names, *columns]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy("instrument_id").applyInPandas(run, kinds + "".join(f", `{c}` double" for c in columns))


def _np(pdf: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [pdf[n].to_numpy(dtype=float, na_value=NAN) for n in names]


def with_ema(df: DataFrame, n: int = 20, x: str = "close") -> DataFrame:
    return per_instrument(df, lambda p: {"ema": ema(*_np(p, x), n)}, ["ema"])


def with_rma(df: DataFrame, n: int = 14, x: str = "close") -> DataFrame:
    return per_instrument(df, lambda p: {"rma": rma(*_np(p, x), n)}, ["rma"])


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close") -> DataFrame:
    return per_instrument(df, lambda p: dict(zip(("macd", "macd_signal", "macd_hist"), macd(*_np(p, x), fast, slow, signal), strict=True)), ["macd", "macd_signal", "macd_hist"])


def with_rsi(df: DataFrame, n: int = 14, x: str = "close") -> DataFrame:
    return per_instrument(df, lambda p: {"rsi": rsi(*_np(p, x), n)}, ["rsi"])


def with_stoch_rsi(df: DataFrame, n: int = 14, k: int = 14, d: int = 3, x: str = "close") -> DataFrame:
    def add(p: pd.DataFrame) -> dict[str, np.ndarray]:
        line = stoch_of(rsi(*_np(p, x), n), k)
        return {"stoch_rsi_k": line, "stoch_rsi_d": rolling_mean(line, d)}

    return per_instrument(df, add, ["stoch_rsi_k", "stoch_rsi_d"])


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    return per_instrument(df, lambda p: {"atr": rma(true_range(*_np(p, "high", "low", "close")), n)}, ["atr"])


def with_adx(df: DataFrame, n: int = 14) -> DataFrame:
    return per_instrument(df, lambda p: dict(zip(("adx", "plus_di", "minus_di"), adx(*_np(p, "high", "low", "close"), n), strict=True)), ["adx", "plus_di", "minus_di"])


def with_supertrend(df: DataFrame, n: int = 10, k: float = 3.0) -> DataFrame:
    return per_instrument(df, lambda p: dict(zip(("supertrend", "st_direction"), supertrend(*_np(p, "high", "low", "close"), n, k), strict=True)), ["supertrend", "st_direction"])


def with_keltner(df: DataFrame, n: int = 20, k: float = 2.0, atr_length: int | None = None) -> DataFrame:
    if k <= 0:
        raise ValueError("the multiplier must be positive")

    def add(p: pd.DataFrame) -> dict[str, np.ndarray]:
        h, l, c = _np(p, "high", "low", "close")  # noqa: E741
        mid, atr = ema(c, n), rma(true_range(h, l, c), atr_length or n)
        return {"kc_mid": mid, "kc_upper": mid + k * atr, "kc_lower": mid - k * atr}

    return per_instrument(df, add, ["kc_mid", "kc_upper", "kc_lower"])


def with_ewm_std(df: DataFrame, half_life: float = 10.0, x: str = "close") -> DataFrame:
    return per_instrument(df, lambda p: {"ewm_std": ewm_std(*_np(p, x), half_life)}, ["ewm_std"])
