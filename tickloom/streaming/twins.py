"""Streaming twins: bars by watermark, late flags and CUSUM by keyed state.

Each gives, over a stream read to its end, what the batch operator gives on the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.events import cusum_scan


def stream_bars(ticks: DataFrame, *, time: str, key: str, price: str, order: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Tumbling OHLC bars: emitted once the watermark is past a bar, so state is bounded by the delay."""
    at = F.struct(time, order)
    w = F.window(time, width)
    return (
        ticks.withWatermark(time, delay)
        .groupBy(F.col(key), w)
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("n"))
        .select(key, F.unix_seconds("window.start").alias("b"), "open", "high", "low", "close", "n")
    )


def stream_highwater(ticks: DataFrame, *, key: str, seq: str, time_ms: str, ident: str) -> DataFrame:
    """``(key, ident, available_ms, late)``: late rows are kept and flagged, which a watermark would drop.

    Rows of a micro-batch are taken in order of ``seq``; the state is one number a key.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([seq, ident], kind="stable")
        avail, late = [], []
        for t in rows[time_ms].tolist():
            known = t is not None and t == t
            late.append(bool(known and top is not None and t < top))
            if known and (top is None or t > top):
                top = int(t)
            avail.append(top)
        if top is not None:
            state.update((top,))
        yield pd.DataFrame({key: k[0], ident: rows[ident].to_numpy(), "available_ms": pd.array(avail, "Int64"), "late": late})

    out = f"{key} bigint, {ident} bigint, available_ms bigint, late boolean"
    return ticks.select(key, seq, time_ms, ident).groupBy(key).applyInPandasWithState(step, out, "top bigint", "append", GroupStateTimeout.NoTimeout)


def stream_opportunities(bars: DataFrame, *, key: str, time: str, close: str, step_s: int, lag: int = 60, windows: tuple[int, ...] = (5, 15, 60, 240)) -> DataFrame:
    """Momentum side and the windows' returns and volatilities of each bar from bars before it, as they come in order.

    ``(key, time, side, ret_w, vol_w)``: the side is null unless the ``lag`` + 1 bars before are contiguous. The
    state is the last ``max(lag, windows) + 1`` bars, a fixed number whatever the stream's length.
    """
    keep = max(lag, *windows) + 2
    names = [f"{k}_{n}" for n in windows for k in ("ret", "vol")]

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old_t, old_c = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        at = np.concatenate((old_t, rows[time].to_numpy(np.int64)))
        c = np.concatenate((old_c, rows[close].astype(float).to_numpy()))
        r = np.diff(np.log(c), prepend=np.log(c[:1]))
        i = np.arange(len(old_t), len(at))
        near, far = c[np.maximum(i - 1, 0)], c[np.maximum(i - lag - 1, 0)]
        whole = (i > lag) & (at[i] - at[np.maximum(i - lag - 1, 0)] == (lag + 1) * step_s)
        out = {key: k[0], time: at[i], "side": pd.array(np.where(whole, np.sign(near - far), 0), "Int32")}
        out["side"][~whole] = pd.NA
        run, sq = np.concatenate(([0.0], np.cumsum(r))), np.concatenate(([0.0], np.cumsum(r * r)))
        for n in windows:
            a = np.maximum(i - n, 0)
            total = run[i] - run[a]
            out[f"ret_{n}"] = np.where(i == 0, np.nan, total)  # nothing is known before a feed's first bar
            out[f"vol_{n}"] = np.sqrt(np.maximum((sq[i] - sq[a]) / n - (total / n) ** 2, 0))
        state.update((at[-keep:].tolist(), c[-keep:].tolist()))
        yield pd.DataFrame(out)

    schema = f"{key} bigint, {time} bigint, side int, " + ", ".join(f"{n} double" for n in names)
    return bars.select(key, time, F.col(close).cast("double").alias(close)).groupBy(key).applyInPandasWithState(
        step, schema, "t array<bigint>, c array<double>", "append", GroupStateTimeout.NoTimeout
    )


def stream_cusum(bars: DataFrame, *, key: str, time: str, close: str, step_s: int, h: float) -> DataFrame:
    """``(key, time, event)`` of bars that come in order; the state is the bar before and the two levels ``cusum_scan`` goes on from."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, low, high = state.get if state.exists else (None, math.inf, -math.inf)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        at = rows[time].to_numpy(np.int64)
        reset = np.diff(at, prepend=at[0] - step_s if before is None else before) != step_s
        reset[0] |= before is None
        event, low, high = cusum_scan(np.log(rows[close].astype(float).to_numpy()), reset, h, low, high)
        state.update((int(at[-1]), low, high))
        yield pd.DataFrame({key: k[0], time: at, "event": event})

    return bars.select(key, time, close).groupBy(key).applyInPandasWithState(
        step, f"{key} bigint, {time} bigint, event boolean", "t bigint, low double, high double", "append", GroupStateTimeout.NoTimeout
    )
