"""Path-dependent labels: which price barrier is touched first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.time import floor_div

NEVER = np.iinfo(np.int64).max
LABELS = "feed_id bigint, b bigint, side int, outcome string, end_s bigint, info_s bigint, entry_i bigint, exit_i bigint, post_status string, post_s bigint"


class TouchIndex:
    """Range maxima and minima of powers of two: the first touch of a barrier by binary lifting, for all entries at once."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.n = len(high)
        self.levels = [(high, low)]
        k = 1
        while k < self.n:
            h, lo = self.levels[-1]
            h2, l2 = np.full(self.n, NEVER), np.full(self.n, -NEVER)
            h2[: self.n - k] = np.maximum(h[: self.n - k], h[k:])
            l2[: self.n - k] = np.minimum(lo[: self.n - k], lo[k:])
            self.levels.append((h2, l2))  # blocks over the end never skip
            k *= 2

    def first(self, start: np.ndarray, stop: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """First index in ``[start, stop)`` with high >= upper or low <= lower; ``stop`` if there is none."""
        pos = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            h, lo = self.levels[k]
            at = np.minimum(pos, self.n - 1)
            skip = (pos + (1 << k) <= stop) & (h[at] < upper) & (lo[at] > lower)
            pos = np.where(skip, pos + (1 << k), pos)
        return np.minimum(pos, stop)


def label_arrays(b, o, h, lo, c, step, entry, side, target, stop, deadline, censor, until_tie):
    """Outcome of each entry (index into the bars) by the order of rules on the first touched bar.

    ``deadline`` and ``censor`` are instants; bars that begin before both are scanned. With no
    touch it is a timeout if the deadline comes first (``until_tie``: or at the same time).
    """
    index = TouchIndex(h, lo)
    limit = np.minimum(deadline, censor)
    right = np.maximum(np.searchsorted(b, limit, side="left"), entry)
    up, down = np.maximum(target, stop), np.minimum(target, stop)
    j = index.first(entry, right, up, down)
    hit = j < right
    jj = np.minimum(j, len(b) - 1)
    bo, bh, bl = o[jj], h[jj], lo[jj]
    open_stop = hit & (side * (bo - stop) <= 0)
    open_target = hit & ~open_stop & (side * (bo - target) >= 0)
    in_target = np.where(side > 0, bh >= target, bl <= target)
    in_stop = np.where(side > 0, bl <= stop, bh >= stop)
    inside = hit & ~open_stop & ~open_target
    both, only_stop, only_target = inside & in_target & in_stop, inside & in_stop & ~in_target, inside & in_target & ~in_stop
    bar_end = b[jj] + step
    timeout = ~hit & ((deadline <= censor) if until_tie is True else (deadline < censor) | ((deadline == censor) & until_tie))
    outcome = np.select(
        [open_stop | only_stop, open_target, both, only_target & (bar_end < deadline), only_target, timeout],
        ["stop_loss", "take_profit", "ambiguous", "take_profit", "boundary", "timeout"],
        "censored",
    )
    last = np.maximum(np.searchsorted(b, limit, side="left") - 1, entry)
    end = np.where(open_stop | open_target, b[jj], np.where(hit, bar_end, limit))
    info = np.where(hit, bar_end, limit)
    price = np.select([open_stop, only_stop, open_target | only_target, timeout], [bo, stop, target, c[last]], NEVER)
    # After a stop: does the original target still trade before the deadline, from the stop's bar on?
    stopped = open_stop | only_stop
    post = np.where(stopped, jj, right)
    k = index.first(post, right, np.where(side > 0, target, NEVER), np.where(side > 0, -NEVER, target))
    kk = np.minimum(k, len(b) - 1)
    found = stopped & (k < right)
    at = np.where(side * (o[kk] - target) >= 0, b[kk], b[kk] + step)
    whole = deadline <= censor
    status = np.select(
        [found & (at < deadline), found, stopped & whole, stopped], ["reached", "boundary", "not_reached", "censored"], ""
    )
    return outcome, end, info, price, status, np.where(found, at, NEVER)


def _label(t: pa.Table, until_tie: bool, gapless: bool) -> pa.Table:
    order = np.argsort(t.column("b").to_numpy(), kind="stable")
    get = lambda c: t.column(c).to_numpy()[order]
    b, own = get("b"), get("_own").astype(bool)
    o, h, lo, c = (get(x) for x in ("o_i", "h_i", "l_i", "c_i"))
    entry = np.flatnonzero(own & get("eligible").astype(bool))
    step = int(t.column("step")[0].as_py())
    tp, sl, dl, ce, feed = (get(x)[entry] for x in ("tp_i", "sl_i", "deadline_s", "censor_s", "feed_id"))
    eof = get("eof").astype(bool)[entry]
    if gapless:
        # The chunk holds every bar before the deadline, so the first break is known here: no feed-wide pass.
        ends = np.append(b[1:] != b[:-1] + step, True)
        stop_at = np.where(ends, b + step, NEVER)
        ce = np.minimum.accumulate(stop_at[::-1])[::-1][entry]
    parts = []
    for side in (1, -1):
        s = np.full(len(entry), side)
        outcome, end, info, price, status, at = label_arrays(
            b, o, h, lo, c, step, entry, s, o[entry] + side * tp, o[entry] - side * sl, dl, ce, True if until_tie else eof
        )
        null = lambda x: pa.array(x, pa.int64(), mask=x == NEVER)
        parts.append(
            pa.table(
                {
                    "feed_id": pa.array(feed), "b": pa.array(b[entry]), "side": pa.array(s.astype(np.int32)), "outcome": pa.array(outcome.tolist(), pa.string()),
                    "end_s": pa.array(end), "info_s": pa.array(info), "entry_i": pa.array(o[entry]), "exit_i": null(price),
                    "post_status": pa.array([x or None for x in status.tolist()], pa.string()), "post_s": null(at),
                }
            )
        )
    return pa.concat_tables(parts)


def first_touch(
    bars: DataFrame,
    *,
    tp: Column,
    sl: Column,
    horizon_s: Column,
    deadline: Column,
    censor: Column,
    eligible: Column | None = None,
    eof: Column | None = None,
    until_tie: bool = True,
    gapless: bool = False,
    chunk_steps: int = 8192,
) -> DataFrame:
    """Both sides of each bar taken as an entry at its open; prices as integers of 1e-8.

    ``tp`` and ``sl`` are price distances fixed at entry (DECIMAL), ``deadline`` and ``censor``
    instants in epoch seconds (with ``gapless`` the end of the entry's gapless run censors). Touches are inclusive, prices exact: never doubles. Output: ``LABELS``.

    Distribution: entries by (feed, chunk of time), each chunk with the bars ahead that its
    entries can reach (``horizon_s``, wall time); groups are bounded whatever the feed's length.
    """
    unit = lambda c: (c.cast("decimal(28,8)") * 100_000_000).cast("bigint")
    span = F.col("step") * chunk_steps
    own_chunk = floor_div(F.col("b"), span)
    rows = bars.withColumns(
        {
            "o_i": unit(F.col("open")), "h_i": unit(F.col("high")), "l_i": unit(F.col("low")), "c_i": unit(F.col("close")), "tp_i": unit(tp), "sl_i": unit(sl),
            "deadline_s": F.coalesce(deadline, F.col("b")), "censor_s": F.coalesce(censor, F.col("b")),
            "eligible": F.coalesce(eligible if eligible is not None else F.lit(True), F.lit(False)) & deadline.isNotNull() & censor.isNotNull() & tp.isNotNull() & sl.isNotNull(),
            "eof": F.coalesce(eof if eof is not None else F.lit(False), F.lit(False)),
        }
    )
    rows = rows.withColumns({"tp_i": F.coalesce("tp_i", F.lit(0)), "sl_i": F.coalesce("sl_i", F.lit(0))})
    rows = rows.withColumn("_c", F.explode(F.sequence(floor_div(F.col("b") - horizon_s, span), own_chunk))).withColumn("_own", F.col("_c") == own_chunk)
    slim = rows.select("feed_id", "_c", "b", "step", "o_i", "h_i", "l_i", "c_i", "tp_i", "sl_i", "deadline_s", "censor_s", "eligible", "eof", "_own")
    return slim.groupBy("feed_id", "_c").applyInArrow(lambda t: _label(t, until_tie, gapless), LABELS)


def contiguous_labels(bars: DataFrame, *, tp: Column, sl: Column, hold_s: int = 259_200, horizon_bars: int | None = None) -> DataFrame:
    """Labels on gapless runs: a missing bar censors; the deadline is ``hold_s`` (72 hours) after the entry
    on every scale, or ``horizon_bars`` bars after it if they are given."""
    hold = F.lit(hold_s).cast("bigint") if horizon_bars is None else F.col("step") * horizon_bars
    return first_touch(bars, tp=tp, sl=sl, horizon_s=hold, deadline=F.col("b") + hold, censor=F.col("b"), gapless=True)


def session_labels(bars: DataFrame, *, tp: Column, sl: Column, longest_s: int, eligible: Column | None = None) -> DataFrame:
    """Labels in session time: ``bars`` carry ``deadline_s`` (open minutes) and ``censor_s`` (15 missing ones).

    ``longest_s`` bounds how far a deadline lies ahead in wall time (closures included).
    """
    eof = F.col("deadline_s") == F.col("last_s") + F.col("step")
    return first_touch(
        bars, tp=tp, sl=sl, horizon_s=F.lit(longest_s).cast("bigint"), deadline=F.col("deadline_s"), censor=F.col("censor_s"), eligible=eligible, eof=eof, until_tie=False
    )


def pips(labels: DataFrame, pip: Column) -> DataFrame:
    """Adds ``pnl_pips`` (null without an exit price): signed distance in pips, exact to four digits."""
    d = (F.col("side") * (F.col("exit_i") - F.col("entry_i"))).cast("decimal(20,0)")
    return labels.withColumn("pnl_pips", (d / (pip.cast("decimal(12,8)") * 100_000_000).cast("decimal(20,0)")).cast("decimal(18,4)"))
