"""First-touch labels over ticks: fill, barriers on the liquidation side, defects and time limits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, big, floor_div
from tickloom.operators.touch import NEVER, TouchIndex

DAY_MS = DAY_S * 1000
ENTRY = "row_id bigint, et bigint, fill bigint, entry_bad boolean"
SCAN = "row_id bigint, cross bigint, won boolean, bad_t bigint, tt bigint"


def _split(t: pa.Table):
    """The quotes of a chunk in order of (time, id): times and both prices of sound ones, times of hazards; and the rows asked about."""
    kind = t.column("kind").to_numpy()
    get = lambda c, m: t.column(c).to_numpy(zero_copy_only=False)[m]
    q, e = kind == 0, kind == 1
    order = np.lexsort((get("_id", q), get("t", q)))
    ts, bid, ask, bad = (get(c, q)[order] for c in ("t", "bid_i", "ask_i", "bad"))
    good = ~bad.astype(bool)
    return ts[good], bid[good], ask[good], ts[~good], lambda c: get(c, e)


def _at(values: np.ndarray, i: np.ndarray) -> np.ndarray:
    """``values[i]``, or never where ``i`` is past the end."""
    return np.append(values, NEVER)[np.minimum(i, len(values))]


def _null(x: np.ndarray, ok: np.ndarray, ty=None) -> pa.Array:
    return pa.array(x, ty or pa.int64(), mask=~ok)


def _entries(wait: int):
    def run(t: pa.Table) -> pa.Table:
        gt, gb, ga, hz, row = _split(t)
        at, side = row("t"), row("side")
        i = np.searchsorted(gt, at)
        et = _at(gt, i)
        have = et < at + wait
        bad = _at(hz, np.searchsorted(hz, at)) < np.minimum(et, at + wait)
        fill = np.where(side > 0, _at(ga, i), _at(gb, i))
        return pa.table({"row_id": pa.array(row("_id")), "et": _null(et, have), "fill": _null(fill, have), "entry_bad": pa.array(bad)})

    return run


def _scan(t: pa.Table) -> pa.Table:
    """Within one day: the first crossing and the first hazard after the entry, and the first quote from the deadline on."""
    gt, gb, ga, hz, row = _split(t)
    et, dl, side, target, loss = (row(c) for c in ("t", "deadline", "side", "target", "loss"))
    n = len(et)
    bad, tt = _at(hz, np.searchsorted(hz, et, side="right")), _at(gt, np.searchsorted(gt, dl))
    start = np.searchsorted(gt, et, side="right")  # a quote at the entry's time can't exit
    stop = np.maximum(np.searchsorted(gt, dl), start)
    cross, won = np.full(n, NEVER), np.zeros(n, bool)
    for s, price in ((1, gb), (-1, ga)):
        m = side == s
        if m.any() and len(gt):
            k = TouchIndex(price, price).first(start[m], stop[m], np.maximum(target[m], loss[m]), np.minimum(target[m], loss[m]))
            hit = k < stop[m]
            cross[m] = np.where(hit, _at(gt, k), NEVER)
            won[m] = hit & (s * (_at(price, k) - target[m]) >= 0)
    return pa.table({"row_id": pa.array(row("_id")), "cross": _null(cross, cross < NEVER), "won": pa.array(won), "bad_t": _null(bad, bad < NEVER), "tt": _null(tt, tt < NEVER)})


def tick_labels(decisions: DataFrame, quotes: DataFrame, *, deadline: Column, wait_ms: int = 30_000, cap_ms: int = 60_000, tp: Column, sl: Column) -> DataFrame:
    """``(row_id, reason, entry_ms, terminal_ms, fill_i)`` for decisions ``(row_id, feed_id, at_ms, side)``.

    The fill is the first executable quote within ``wait_ms`` from the decision (ask for long, bid
    for short); barriers are ``tp`` and ``sl`` from it, watched on the side that would be sold to,
    strictly after the entry's instant and before ``deadline`` (milliseconds; rows without one are left
    out). A defect (invalid or ambiguous quote) before the outcome censors. At the deadline the
    first quote within ``cap_ms`` is a timeout.

    However far the deadline, a quote is read for its own day alone: a day's bounds (highest and
    lowest bid and ask, whether there is a defect), one row a feed and day, say which day is the
    first on which a decision can end. It is scanned there, on the day of its entry and
    at its deadline: four days at most. A task holds one feed's day.
    """
    unit = lambda c: F.coalesce((c.cast("decimal(28,8)") * 100_000_000).cast("bigint"), big(0))
    day = lambda c: floor_div(F.col(c), big(DAY_MS))
    none = {c: big(0).alias(c) for c in ("side", "deadline", "target", "loss", "bid_i", "ask_i")}
    bad = ~F.coalesce(F.col("is_valid"), F.lit(False)) | F.coalesce(F.col("ambiguous"), F.lit(False)) | F.col("bid").isNull() | F.col("ask").isNull()
    q = quotes.where("feed_id is not null and source_time is not null").select(
        "feed_id", F.lit(0).alias("kind"), F.col("quote_id").alias("_id"), F.col("source_time").alias("t"),
        unit(F.col("bid")).alias("bid_i"), unit(F.col("ask")).alias("ask_i"), bad.alias("bad"),
    )
    d = decisions.where("feed_id is not null and at_ms is not null and side in (-1, 1)").select(
        "row_id", "feed_id", "at_ms", F.col("side").cast("bigint").alias("side"), unit(tp).alias("_tp"), unit(sl).alias("_sl"), deadline.cast("bigint").alias("deadline")
    ).where("deadline is not null")

    # Entries: the decisions of a day with its quotes and those just after it.
    qx = q.withColumn("_c", F.explode(F.sequence(floor_div(F.col("t") - wait_ms, big(DAY_MS)), day("t"))))
    ask = d.select("feed_id", F.lit(1).alias("kind"), F.col("row_id").alias("_id"), F.col("at_ms").alias("t"), none["bid_i"], none["ask_i"], F.lit(False).alias("bad"), day("at_ms").alias("_c"), "side")
    entry = qx.withColumn("side", big(0)).unionByName(ask).groupBy("feed_id", "_c").applyInArrow(_entries(wait_ms), ENTRY)
    x = d.join(entry, "row_id")
    x = x.withColumns({"target": F.col("fill") + F.col("side") * F.col("_tp"), "loss": F.col("fill") - F.col("side") * F.col("_sl")})
    live = x.where("et is not null and not entry_bad and least(target, loss) > 0")

    # Days on which a live one can end: by the day's bounds the first after the entry's, and those of entry and deadline.
    sound = lambda c: F.when(~F.col("bad"), F.col(c))
    bounds = q.groupBy("feed_id", day("t").alias("_c")).agg(
        F.max(sound("bid_i")).alias("bid_hi"), F.min(sound("bid_i")).alias("bid_lo"), F.max(sound("ask_i")).alias("ask_hi"), F.min(sound("ask_i")).alias("ask_lo"), F.bool_or("bad").alias("hazard")
    )
    last = floor_div(F.col("deadline") + cap_ms, big(DAY_MS))
    later = live.withColumn("_c", F.explode(F.sequence(day("et"), F.greatest(last, day("et"))))).join(bounds, ["feed_id", "_c"])
    reach = F.when(F.col("side") > 0, (F.col("bid_hi") >= F.greatest("target", "loss")) | (F.col("bid_lo") <= F.least("target", "loss"))).otherwise((F.col("ask_hi") >= F.greatest("target", "loss")) | (F.col("ask_lo") <= F.least("target", "loss")))
    first = F.min(F.when((F.coalesce(reach, F.lit(False)) | F.col("hazard")) & (F.col("_c") > day("et")), F.col("_c"))).alias("_first")
    days = later.groupBy("row_id").agg(first, F.array_compact(F.array(F.max(F.when(F.col("_c") == day("et"), F.col("_c"))), F.max(F.when(F.col("_c") == day("deadline"), F.col("_c"))), F.max(F.when(F.col("_c") == last, F.col("_c"))))).alias("_fixed"))
    days = days.select("row_id", F.explode(F.array_distinct(F.array_compact(F.concat("_fixed", F.array("_first"))))).alias("_c"))
    asked = live.join(days, "row_id").select("feed_id", F.lit(1).alias("kind"), F.col("row_id").alias("_id"), F.col("et").alias("t"), none["bid_i"], none["ask_i"], F.lit(False).alias("bad"), "_c", "side", "deadline", "target", "loss")
    zeros = {c: big(0) for c in ("side", "deadline", "target", "loss")}
    seen = q.withColumn("_c", day("t")).withColumns(zeros).unionByName(asked).groupBy("feed_id", "_c").applyInArrow(_scan, SCAN)
    end = seen.groupBy("row_id").agg(F.min_by(F.struct("cross", "won"), "cross").alias("_x"), F.min("bad_t").alias("bad_t"), F.min("tt").alias("tt"))

    j = x.join(end, "row_id", "left").withColumns({"cross": F.col("_x.cross"), "won": F.col("_x.won")})
    never = F.lit(int(NEVER))
    bad_t, tt, dl = F.coalesce("bad_t", never), F.coalesce("tt", never), F.col("deadline")
    crossed = F.col("cross").isNotNull() & (F.col("cross") < bad_t)
    reason = (
        F.when(F.col("entry_bad"), "entry_defect").when(F.col("et").isNull(), "entry_expired").when(F.least("target", "loss") <= 0, "invalid_prices")
        .when(crossed, F.when(F.col("won"), "tp").otherwise("sl")).when(bad_t < dl, "censored")
        .when((tt < dl + cap_ms) & (bad_t > tt), "timeout").when(bad_t < dl + cap_ms, "censored").otherwise("timeout_unobserved")
    )
    j = j.withColumn("reason", reason)
    terminal = F.when(F.col("reason").isin("tp", "sl"), F.col("cross")).when(F.col("reason") == "timeout", F.col("tt"))
    filled = ~F.col("entry_bad")
    return j.select("row_id", "reason", F.when(filled, F.col("et")).alias("entry_ms"), terminal.alias("terminal_ms"), F.when(filled, F.col("fill")).alias("fill_i"))
