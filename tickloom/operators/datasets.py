"""Data sets composed of the other operators: candidates, supports, pairs, offsets and what they are audited by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import big, floor_div
from tickloom.operators.clock import elapsed
from tickloom.operators.intervals import asof_backward
from tickloom.operators.touch import NEVER, TouchIndex


def candidates(labels: DataFrame, features: DataFrame, events: dict[str, DataFrame]) -> DataFrame:
    """Labels of both sides in one row order with the validity of their features and a mask per kind of event.

    ``labels`` have ``feed_id, b, side``; ``features`` and each of ``events`` a row per ``feed_id, b`` (``valid``,
    ``entry``). Rows that lack either are kept with false, so a mask never changes which rows there are.
    """
    out = labels.join(features.select("feed_id", "b", "valid"), ["feed_id", "b"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    for name, e in events.items():
        mask = e.where("entry").select("feed_id", "b", F.lit(True).alias(name))
        out = out.join(mask, ["feed_id", "b"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def stale_minutes(labels: DataFrame, bars: DataFrame, coords: DataFrame, end: str = "end_s", step: int = 60) -> DataFrame:
    """Adds ``stale``: open minutes between the end of the last bar observed by the exit and the exit itself."""
    closed = bars.select("feed_id", (F.col("b") + step).alias("_closed"))
    j = asof_backward(labels, closed, "feed_id", end, "_closed", ["_closed"], 86_400)
    return elapsed(j, coords, "_closed", end, "stale").drop("_closed")


def overlap_guard(parts: DataFrame, by: list[str], start: str, info_end: str) -> DataFrame:
    """Per fold: rows of each role, the latest thing a training row knows and the first test row; ``clean`` if they do not meet."""
    role = lambda r, c: F.when(F.col("role") == r, F.col(c))
    g = parts.groupBy(*by).agg(
        F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"),
        F.max(role("train", info_end)).alias("known_until"), F.min(role("test", start)).alias("test_from"),
    )
    return g.withColumn("clean", F.coalesce(F.col("known_until") < F.col("test_from"), F.lit(True)))


def paired(rows: DataFrame, keys: list[str], side: str, ident: str) -> DataFrame:
    """Keys that have exactly one row of each side, with both rows' ids."""
    of = lambda v: F.count_if(F.col(side) == v)
    pick = lambda v: F.max(F.when(F.col(side) == v, F.col(ident)))
    g = rows.where(f"{side} in (-1, 1)").groupBy(*keys).agg(of(1).alias("_l"), of(-1).alias("_s"), pick(1).alias("long"), pick(-1).alias("short"))
    return g.where("_l = 1 and _s = 1").drop("_l", "_s")


def month_offsets(rows: DataFrame, group: str, month: Column, ident: str) -> DataFrame:
    """Where each month of a group begins in the group's order: ``(group, month, offset, rows, first, last)``; a row a month is ordered."""
    g = rows.groupBy(group, month.alias("month")).agg(F.count("*").alias("rows"), F.min(ident).alias("first"), F.max(ident).alias("last"))
    before = F.sum("rows").over(W.partitionBy(group).orderBy("month").rowsBetween(W.unboundedPreceding, -1))
    return g.select(group, "month", F.coalesce(before, big(0)).alias("offset"), "rows", "first", "last")


def aligned(saved: DataFrame, again: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Saved rows against recomputed ones: ``(status, rows)`` with ``equal``, ``missing``, ``extra`` or the values that differ."""
    s, a = (x.select(*keys, F.struct(*values).alias(n)) for x, n in ((saved, "_s"), (again, "_a")))
    differ = F.concat_ws("+", *[F.when(~F.col(f"_s.{v}").eqNullSafe(F.col(f"_a.{v}")), F.lit(v)) for v in values])
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(differ == "", "equal").otherwise(differ)
    return s.join(a, keys, "full").groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


def earliest_affected(spans: DataFrame, rows: DataFrame, group: str, start: str, end: str, ident: str, width: int) -> DataFrame:
    """Each span ``[a, z)`` with the first row (by start, then id) whose interval meets it, if any does.

    Both sides are cut into buckets of ``width`` and joined by equality, so an interval meets
    spans only in buckets it lies in; the first row of each bucket and span is kept before all are.
    """
    b = big(width)
    cut = lambda x, lo, hi: F.explode(F.sequence(floor_div(F.col(lo), b), floor_div(F.col(hi) - 1, b))).alias("_b")
    s = spans.where("a < z").select(group, "a", "z", cut(spans, "a", "z"))
    r = rows.where(F.col(start) < F.col(end)).select(group, F.col(start).alias("_from"), F.col(end).alias("_to"), F.col(ident).alias("_i"), cut(rows, start, end))
    first = s.join(r, [group, "_b"]).where("_from < z and _to > a").groupBy(group, "a", "z").agg(F.min(F.struct("_from", "_i")).alias("_m"))
    return spans.join(first, [group, "a", "z"], "left").select(group, "a", "z", F.col("_m._i").alias(ident))


RANGES = "_id bigint, low bigint, high bigint, max_drop bigint, max_rise bigint, n bigint"


def _range_kernel(t: pa.Table) -> pa.Table:
    ask, q = t.column("_l").to_numpy(), t.column("_l").to_numpy() < 0
    get = lambda c, m: t.column(c).to_numpy()[m]
    order = np.lexsort((get("_id", q), get("_o", q), get("_t", q)))
    at, v = get("_t", q)[order], get("_v", q)[order]
    ids, start, stop = get("_id", ~q), get("_t", ~q), get("_t", ~q) + ask[~q]
    a, z = np.searchsorted(at, start), np.searchsorted(at, stop)
    # Blocks of twice the length each carry low, high, deepest fall and highest rise; a range is put together of them.
    levels, k = [(v, v, np.zeros_like(v), np.zeros_like(v))], 1
    while 2 * k <= len(v):
        lo, hi, dr, ri = levels[-1]
        m = len(v) - 2 * k + 1
        left, right = slice(0, m), slice(k, k + m)
        levels.append((np.minimum(lo[left], lo[right]), np.maximum(hi[left], hi[right]), np.maximum.reduce([dr[left], dr[right], hi[left] - lo[right]]), np.maximum.reduce([ri[left], ri[right], hi[right] - lo[left]])))
        k *= 2
    low, high = np.full(len(ids), NEVER), np.full(len(ids), -NEVER)
    drop, rise, pos = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), a.copy()
    for j in range(len(levels) - 1, -1, -1):
        take = np.flatnonzero(pos + (1 << j) <= z)
        if len(take):
            lo, hi, dr, ri = (x[pos[take]] for x in levels[j])
            seen = pos[take] > a[take]
            drop[take] = np.maximum.reduce([drop[take], dr, np.where(seen, high[take] - lo, 0)])
            rise[take] = np.maximum.reduce([rise[take], ri, np.where(seen, hi - low[take], 0)])
            low[take], high[take] = np.minimum(low[take], lo), np.maximum(high[take], hi)
            pos[take] += 1 << j
    none = a >= z
    put = lambda x: pa.array(x, pa.int64(), mask=none)
    return pa.table({"_id": pa.array(ids), "low": put(low), "high": put(high), "max_drop": put(drop), "max_rise": put(rise), "n": pa.array(z - a)})


def range_summaries(ranges: DataFrame, points: DataFrame, group: str, ident: str, start: str, length: int, at: str, order: str, tie: str, value: Column, chunk: int = 86_400_000) -> DataFrame:
    """``(ident, low, high, max_drop, max_rise, n)`` of the points in ``[start, start + length)`` in order of (time, order, tie).

    ``value`` is an integer. Chunks of time hold the ranges that begin in them and the points those
    reach, so a task is bounded by the chunk; within it all ranges are put together at once of
    blocks of powers of two.
    """
    p = points.where(F.col(group).isNotNull() & F.col(at).isNotNull() & value.isNotNull())
    none = big(-1)
    reach = F.sequence(floor_div(F.col(at) - length, big(chunk)), floor_div(F.col(at), big(chunk)))
    p = p.select(F.col(group).alias("_g"), F.explode(reach).alias("_c"), F.col(tie).alias("_id"), F.col(at).alias("_t"), F.col(order).cast("bigint").alias("_o"), value.cast("bigint").alias("_v"), none.alias("_l"))
    r = ranges.where(F.col(group).isNotNull() & F.col(start).isNotNull())
    r = r.select(F.col(group).alias("_g"), floor_div(F.col(start), big(chunk)).alias("_c"), F.col(ident).alias("_id"), F.col(start).alias("_t"), big(0).alias("_o"), big(0).alias("_v"), F.lit(length).cast("bigint").alias("_l"))
    out = p.unionByName(r).groupBy("_g", "_c").applyInArrow(_range_kernel, RANGES)
    return out.withColumnRenamed("_id", ident)


CROSSING = "_id bigint, hit_ms bigint"


def _crossing_kernel(t: pa.Table) -> pa.Table:
    q = t.column("_l").to_numpy() < 0
    get = lambda c, m: t.column(c).to_numpy()[m]
    order = np.lexsort((get("_id", q), get("_t", q)))
    at, v = get("_t", q)[order], get("_v", q)[order]
    ids, start, length, level = get("_id", ~q), get("_t", ~q), get("_l", ~q), get("_v", ~q)
    a, z = np.searchsorted(at, start), np.searchsorted(at, start + length)
    if len(v):
        k = TouchIndex(v, v).first(a, z, level, np.full(len(ids), -NEVER))
    else:
        k = z
    hit = k < z
    when = np.where(hit, at[np.minimum(k, max(len(at) - 1, 0))] if len(at) else 0, 0)
    return pa.table({"_id": pa.array(ids), "hit_ms": pa.array(when, pa.int64(), mask=~hit)})


def first_at_or_above(asked: DataFrame, points: DataFrame, group: str, ident: str, start: str, level: str, length: int, at: str, tie: str, value: Column, chunk: int = 86_400_000) -> DataFrame:
    """``(ident, hit_ms)``: the first point from ``start`` on, within ``length``, that stands at ``level`` or above; whole blocks below it are skipped."""
    p = points.where(F.col(group).isNotNull() & F.col(at).isNotNull() & value.isNotNull())
    reach = F.sequence(floor_div(F.col(at) - length, big(chunk)), floor_div(F.col(at), big(chunk)))
    p = p.select(F.col(group).alias("_g"), F.explode(reach).alias("_c"), F.col(tie).alias("_id"), F.col(at).alias("_t"), value.cast("bigint").alias("_v"), big(-1).alias("_l"))
    r = asked.where(F.col(group).isNotNull() & F.col(start).isNotNull() & F.col(level).isNotNull())
    r = r.select(F.col(group).alias("_g"), floor_div(F.col(start), big(chunk)).alias("_c"), F.col(ident).alias("_id"), F.col(start).alias("_t"), F.col(level).cast("bigint").alias("_v"), F.lit(length).cast("bigint").alias("_l"))
    return p.unionByName(r).groupBy("_g", "_c").applyInArrow(_crossing_kernel, CROSSING).withColumnRenamed("_id", ident)
