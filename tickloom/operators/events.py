"""Symmetric CUSUM events and the openings that follow them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S
from tickloom.operators.chunks import with_previous, with_running

#: Seconds in a bucket of the two-level passes over a feed.
RUN_WIDTH = 30 * DAY_S


def _crossings(level: np.ndarray, h: float, base: float) -> tuple[list[int], float]:
    """Rows at which ``level`` stands more than ``h`` above its lowest since the last such row, ``base`` included.

    Whole stretches at a time: a running minimum gives the first crossing of each, and the
    stretch after a crossing starts at the level it was made at.
    """
    hits, at, width, n = [], 0, 64, len(level)
    while at < n:
        part = level[at : at + width]
        low = np.minimum(np.minimum.accumulate(part), base)
        over = part - low > h
        k = int(over.argmax())
        if over[k]:
            hits.append(at + k)
            at, base, width = at + k + 1, part[k], 64
        else:
            at, base, width = at + len(part), low[-1], min(2 * width, 65_536)
    return hits, base


def cusum_scan(log_price: np.ndarray, reset: np.ndarray, h: float, low: float = np.inf, high: float = -np.inf) -> tuple[np.ndarray, float, float]:
    """Rows at which a symmetric CUSUM of log changes fires, and the lowest and highest level it goes on from.

    A positive sum that is cut at zero is the rise above the lowest level since it was last
    restarted, a negative one the fall from the highest; each restarts only when it fires itself,
    so the two are found apart. Crossings are strict. A ``reset`` row restarts both at its level.
    """
    fired = np.zeros(len(log_price), bool)
    edges = np.concatenate(([0], np.flatnonzero(reset), [len(log_price)]))
    for a, z in zip(edges[:-1], edges[1:]):
        if a == z:
            continue
        part = log_price[a:z]
        if reset[a]:
            low, high = np.inf, -np.inf
        up, low = _crossings(part, h, low)
        down, high = _crossings(-part, h, -high)
        high = -high
        fired[a + np.array(up + down, np.int64)] = True
    return fired, float(low), float(high)


def cusum_events(bars: DataFrame, h: float, *, broke: str | None = None) -> DataFrame:
    """``(feed_id, b, event, entry)``: bars whose close fires, and bars that open just after one.

    A bar that does not follow the one before without a gap (or, with ``broke``, after a long
    one) restarts both sums and is no entry. Sums do not combine, so a gapless run is the unit
    of work: runs, not feeds, are spread over the tasks.
    """
    x = with_previous(bars, ["feed_id"], ["b"], ["b"], RUN_WIDTH, keep=True)
    first = F.col("prev_b").isNull()
    gap = first | ((F.col("b") - F.col("prev_b") != F.col("step")) if broke is None else F.coalesce(F.col(broke), F.lit(False)))
    rows = x.select("feed_id", "b", "_tb", gap.alias("reset"), F.ln(F.col("close").cast("double")).alias("level"))
    rows = with_running(rows, ["feed_id"], ["b"], F.col("reset").cast("bigint"), "_run", RUN_WIDTH)

    def scan(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("b").to_numpy(), kind="stable")
        get = lambda c: t.column(c).to_numpy(zero_copy_only=False)[order]
        event, _, _ = cusum_scan(get("level"), get("reset"), h)
        entry = np.append(False, event[:-1]) & ~get("reset")
        return pa.table({"feed_id": get("feed_id"), "b": get("b"), "event": event, "entry": entry})

    return rows.groupBy("feed_id", "_run").applyInArrow(scan, "feed_id bigint, b bigint, event boolean, entry boolean")
