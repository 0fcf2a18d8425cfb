"""Recurrences over streams: what is carried from bar to bar of an instrument is kept as state, so a stream gives what a batch over all its bars gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlab.operators.broker import band_step
from marketlab.workers import importable


def stream_ema(bars: DataFrame, n: int, column: str = "close") -> DataFrame:
    """instrument_id, ts_utc and ema: the exponential mean of n bars, seeded by the mean of the first n; null before.

    Bars of an instrument must come in order from batch to batch; within one they are sorted.  The state is three numbers.
    """
    if n < 1:
        raise ValueError("a mean needs one bar at least")
    importable(bars.sparkSession)
    alpha = 2 / (n + 1)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, total, mean = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(pdfs)).sort_values("ts_utc", kind="stable")
        out = []
        for x in rows[column].to_numpy(dtype=float, na_value=np.nan):
            if np.isnan(x):
                out.append(None)
                continue
            count += 1
            if count <= n:
                total += x
                mean = total / count
            else:
                mean += alpha * (x - mean)
            out.append(mean if count >= n else None)
        state.update((count, total, mean))
        yield pd.DataFrame({"instrument_id": key[0], "ts_utc": rows["ts_utc"].to_numpy(), "ema": pd.array(out, dtype="Float64").astype(object)})

    return bars.groupBy("instrument_id").applyInPandasWithState(
        step, "instrument_id string, ts_utc timestamp, ema double", "count long, total double, mean double", "append", GroupStateTimeout.NoTimeout
    )


def stream_banded(rows: DataFrame, flat: float = 0.0, floor: float = 0.0, fraction: float = 0.0, half: bool = False) -> DataFrame:
    """instrument_id, ts_utc, w and dw: holdings under a no-trade band from rows with ``desired`` and ``open``; the state is what is held."""
    importable(rows.sparkSession)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array([state.get[0] if state.exists else 0.0])
        part = pd.concat(list(pdfs)).sort_values("ts_utc", kind="stable")
        target, open_ = (part[c].to_numpy(dtype=float, na_value=np.nan) for c in ("desired", "open"))
        w = []
        start = float(held[0])
        for a, b in zip(target, open_, strict=True):
            held = band_step(held, np.array([a]), np.array([b]), flat, floor, fraction, half)
            w.append(float(held[0]))
        state.update((float(held[0]),))
        yield pd.DataFrame({"instrument_id": key[0], "ts_utc": part["ts_utc"].to_numpy(), "w": w, "dw": np.diff(w, prepend=start)})

    return rows.groupBy("instrument_id").applyInPandasWithState(step, "instrument_id string, ts_utc timestamp, w double, dw double", "held double", "append", GroupStateTimeout.NoTimeout)
