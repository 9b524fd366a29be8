"""Overlap algebra: concurrency, uniqueness, probes, as-of lookups, marks and scheduling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, big, floor_div
from tickloom.operators.periods import merged_periods
from tickloom.session import written


def sweep(intervals: DataFrame, group: str, start: str, end: str, width: int = 7 * DAY_S) -> DataFrame:
    """Elementary spans of each group with how many intervals cover them: ``(group, a, z, n, area0)``.

    ``area0`` is the integral of 1/n over everything before the span. Deltas collapse by instant
    before they are shuffled. Sums run within buckets of ``width`` and over one summary row a
    bucket, so a group with a third of all intervals is spread over its buckets.
    """
    plus = intervals.select(group, F.col(start).alias("a"), F.lit(1).alias("d"))
    minus = intervals.select(group, F.col(end).alias("a"), F.lit(-1).alias("d"))
    ev = plus.unionByName(minus).groupBy(group, "a").agg(F.sum("d").alias("d"))
    ev = ev.withColumn("_tb", floor_div(F.col("a"), big(width))).repartition(group, "_tb")
    far = W.partitionBy(group).orderBy("_tb")
    before = far.rowsBetween(W.unboundedPreceding, -1)
    part = ev.groupBy(group, "_tb").agg(F.sum("d").alias("_d"), F.min("a").alias("_f"))
    part = part.select(group, "_tb", F.coalesce(F.sum("_d").over(before), big(0)).alias("_n0"), F.lead("_f").over(far).alias("_nx"))
    w = W.partitionBy(group, "_tb").orderBy("a")
    x = ev.join(part, [group, "_tb"])
    x = x.withColumn("n", F.col("_n0") + F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("z", F.coalesce(F.lead("a").over(w), F.col("_nx")))
    piece = F.coalesce((F.col("z") - F.col("a")) / F.greatest(F.col("n"), F.lit(1)), F.lit(0.0))
    x = x.withColumn("_piece", piece).withColumn("_in", F.coalesce(F.sum("_piece").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = written(x.select(group, "_tb", "a", "z", "n", "_piece", "_in"), "sweep")  # read for the buckets' sums and for the rows
    total = x.groupBy(group, "_tb").agg(F.sum("_piece").alias("_p"))
    total = total.select(group, "_tb", F.coalesce(F.sum("_p").over(before), F.lit(0.0)).alias("_a0"))
    return x.join(total, [group, "_tb"]).select(group, "a", "z", "n", (F.col("_a0") + F.col("_in")).alias("area0"))


def uniqueness(intervals: DataFrame, key: str, group: str, start: str, end: str, width: int = 7 * DAY_S) -> DataFrame:
    """``(key, group, raw, weight)``: the mean of 1/concurrency over each interval, and the same with mean one per group."""
    iv = intervals.where(F.col(end) > F.col(start))
    area = sweep(iv, group, start, end, width).select(group, "a", "area0")
    at = lambda t, name: area.select(group, F.col("a").alias(t), F.col("area0").alias(name))
    j = iv.select(key, group, start, end).join(at(start, "_f"), [group, start]).join(at(end, "_t"), [group, end])
    raw = j.select(key, group, ((F.col("_t") - F.col("_f")) / (F.col(end) - F.col(start))).alias("raw"))
    mean = raw.groupBy(group).agg(F.avg("raw").alias("_m"))
    return raw.join(mean, group).select(key, group, "raw", (F.col("raw") / F.col("_m")).alias("weight"))


def concurrency(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Per group: most intervals at once, and the mean over the time that has any."""
    spans = sweep(intervals.where(F.col(end) > F.col(start)), group, start, end).where("n > 0 and z is not null")
    d = F.col("z") - F.col("a")
    return spans.groupBy(group).agg(F.max("n").alias("most"), (F.sum(d * F.col("n")) / F.sum(d)).alias("active_mean"))


def overlapping(rows: DataFrame, spans: DataFrame, group: str, start: str, end: str, width: int) -> DataFrame:
    """Rows with ``hit``: whether ``[start, end)`` meets a span ``[a, z)`` of the group.

    ``spans`` are disjoint (merged), so the only span that can reach a row is the last that begins
    before its end: an as-of lookup on merged spans, bucketed by ``width``, not a range join.
    """
    marks = spans.select(group, F.col("a").alias("_t"), F.col("z").alias("_z"))
    probe = rows.withColumn("_t", F.col(end) - 1)
    found = asof_backward(probe, marks, group, "_t", "_t", ["_z"], width)
    return found.withColumn("hit", F.coalesce(F.col("_z") > F.col(start), F.lit(False))).drop("_t", "_z")


def _asof(left: DataFrame, right: DataFrame, group: str, lt: str, rt: str, take: list[str], width: int, back: bool, strict: bool) -> DataFrame:
    """As-of merge without a range join or one task per group.

    Both sides get buckets of ``width``. Within (group, bucket) they are merged in order of
    time; what a bucket cannot answer comes from the nearest bucket that has right rows, known
    from one row per (group, bucket).
    """
    b = big(width)
    r = right.select(F.col(group).alias("_g"), F.col(rt).cast("bigint").alias("_rt"), F.struct(F.col(rt).cast("bigint").alias("_at"), *take).alias("_v")).where("_g is not null and _rt is not null")
    r = r.groupBy("_g", "_rt").agg(F.max("_v").alias("_v")).withColumn("_b", floor_div(F.col("_rt"), b))
    cols = [c for c in left.columns]
    lrow = left.withColumn("_l", F.struct(*cols)).select(F.col(group).alias("_g"), F.col(lt).cast("bigint").alias("_rt"), "_l").withColumn("_b", floor_div(F.col("_rt"), b))
    both = r.select("_g", "_b", "_rt", "_v", F.lit(None).cast(lrow.schema["_l"].dataType).alias("_l")).unionByName(
        lrow.select("_g", "_b", "_rt", F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), "_l")
    )
    q = F.col("_l").isNotNull()
    tie = q.cast("int") if not strict else -q.cast("int")  # at one instant right rows first, or last if it has to be strict
    order = [F.col("_rt") if back else F.desc("_rt"), tie.alias("_tie")]
    w = W.partitionBy("_g", "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where(q)
    edge = r.groupBy("_g", "_b").agg((F.max("_v") if back else F.min("_v")).alias("_e"))
    asked = lrow.select("_g", "_b").distinct().withColumn("_e", F.lit(None).cast(edge.schema["_e"].dataType))
    edges = edge.unionByName(asked).groupBy("_g", "_b").agg(F.max("_e").alias("_e"))
    we = W.partitionBy("_g").orderBy("_b" if back else F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select("_g", "_b", F.last("_e", ignorenulls=True).over(we).alias("_out"))
    j = inner.join(edges, ["_g", "_b"], "left").withColumn("_hit", F.coalesce("_in", "_out"))
    return j.select(*[F.col(f"_l.{c}").alias(c) for c in cols], *[F.col(f"_hit.{c}").alias(c) for c in take], F.col("_hit._at").alias("_at")).drop("_at")


def asof_backward(left: DataFrame, right: DataFrame, group: str, lt: str, rt: str, take: list[str], width: int, strict: bool = False) -> DataFrame:
    """Each left row with ``take`` of the last right row at or (``strict``) before its time."""
    return _asof(left, right, group, lt, rt, take, width, True, strict)


def asof_forward(left: DataFrame, right: DataFrame, group: str, lt: str, rt: str, take: list[str], width: int, strict: bool = False) -> DataFrame:
    """Each left row with ``take`` of the first right row at or (``strict``) after its time."""
    return _asof(left, right, group, lt, rt, take, width, False, strict)


def ordered_marks(rows: DataFrame, group: str, order: list[str], value: Column, chunk: Column) -> DataFrame:
    """Per group: ``(low, high, drop, rise)`` of a sequence, as a monoid.

    Chunks are summarised first (running extremes within each), then the summaries are combined
    in order: a drop over several chunks is a high so far less a later low.
    """
    v = rows.select(group, chunk.alias("_c"), value.alias("v"), *order).where("v is not null")
    w = W.partitionBy(group, "_c").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    v = v.withColumns({"_hi": F.max("v").over(w), "_lo": F.min("v").over(w)})
    part = v.groupBy(group, "_c").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("_hi") - F.col("v")).alias("drop"), F.max(F.col("v") - F.col("_lo")).alias("rise"), F.count("*").alias("n")
    )
    before = W.partitionBy(group).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumns({"_ph": F.max("high").over(before), "_pl": F.min("low").over(before)})
    return part.groupBy(group).agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max(F.greatest("drop", F.col("_ph") - F.col("low"))).alias("max_drop"),
        F.max(F.greatest("rise", F.col("high") - F.col("_pl"))).alias("max_rise"),
        F.sum("n").alias("n"),
    )


def best_disjoint(start: np.ndarray, end: np.ndarray, value: np.ndarray) -> list[int]:
    """Rows of most total value, then least total duration, that do not overlap.

    Backwards over the instants at which intervals begin or end: what is to be had from an instant
    on is either what is to be had from the next one, or an interval that begins there and what
    is to be had from its end on. Both goals are two integer columns. The choice is then read off
    forwards; of equally good ones the interval that ends first, with the smallest row, is taken.
    """
    instants = np.unique(np.concatenate((start, end)))
    at, to = np.searchsorted(instants, start), np.searchsorted(instants, end)
    order = np.lexsort((np.arange(len(start)), to, at))
    opens = np.searchsorted(at[order], np.arange(len(instants) + 1)).tolist()
    rows, until, worth, lasts = order.tolist(), to[order].tolist(), value[order].tolist(), (end - start)[order].tolist()
    n = len(instants)
    gain, spent, pick = [0] * n, [0] * n, [-1] * n
    for p in range(n - 2, -1, -1):
        most, least, took = gain[p + 1], spent[p + 1], -1
        for k in range(opens[p], opens[p + 1]):
            total, length = worth[k] + gain[until[k]], lasts[k] + spent[until[k]]
            if total > most or (total == most and length < least):
                most, least, took = total, length, k
        gain[p], spent[p], pick[p] = most, least, took
    chosen, p = [], 0
    while p < n:
        if pick[p] < 0:
            p += 1
        else:
            chosen.append(rows[pick[p]])
            p = until[pick[p]]
    return chosen


def _schedule(t: pa.Table) -> pa.Table:
    t = t.sort_by("id")
    rows = pa.array(best_disjoint(*(t.column(c).to_numpy() for c in ("s", "e", "v"))), pa.int64())
    return t.select(["g", "id"]).take(rows)


def independent_blocks(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Adds ``block``: intervals of one block overlap in a chain, those of different blocks never do.

    Blocks are the merged periods (those that only touch kept apart), found by the reduction
    tree; an interval belongs to the last one that begins at or before it.
    """
    blocks = merged_periods(intervals, entity=group, start=start, end=end, touching=False).where("kind = 'period'")
    return asof_backward(intervals, blocks.select(group, F.col("from_s").alias("block")), group, start, "block", ["block"], 32 * DAY_S)


def weighted_schedule(intervals: DataFrame, key: str, group: str, start: str, end: str, value: str) -> DataFrame:
    """``(group, key)`` of the best set of intervals that do not overlap, ``[start, end)``, values as integers.

    The optimum splits at instants that no interval crosses, so each independent block is a
    small dynamic program of its own and a group's whole list never meets in one task's kernel.
    """
    rows = independent_blocks(intervals.where((F.col(end) > F.col(start)) & (F.col(value) > 0)), group, start, end)
    slim = rows.select(F.col(group).alias("g"), "block", F.col(key).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(value).cast("bigint").alias("v"))
    out = slim.groupBy("g", "block").applyInArrow(_schedule, "g bigint, id bigint")
    return out.select(F.col("g").alias(group), F.col("id").alias(key))


def _greedy(t: pa.Table) -> pa.Table:
    start, end, ident = (t.column(c).to_numpy() for c in ("s", "e", "id"))
    free, chosen = None, []
    for i in np.lexsort((ident, start, end)):
        if free is None or start[i] >= free:
            chosen.append(i)
            free = end[i]
    at = pa.array(np.array(chosen, np.int64))
    return pa.table({"g": t.column("g").take(at), "id": pa.array(ident[np.array(chosen, np.int64)])})


def greedy_schedule(intervals: DataFrame, key: str, group: str, start: str, end: str) -> DataFrame:
    """The largest number of intervals that do not overlap, by earliest end; block by block."""
    rows = independent_blocks(intervals.where(F.col(end) > F.col(start)), group, start, end)
    slim = rows.select(F.col(group).alias("g"), "block", F.col(key).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"))
    return slim.groupBy("g", "block").applyInArrow(_greedy, "g bigint, id bigint").select(F.col("g").alias(group), F.col("id").alias(key))


def longest_run(bars: DataFrame) -> DataFrame:
    """Per feed the longest gapless run of bars (the earliest of equally long ones)."""
    w = W.partitionBy("feed_id").orderBy("b")
    new = F.when(F.col("b") - F.lag("b").over(w) == F.col("step"), 0).otherwise(1)
    runs = bars.withColumn("_n", new).withColumn("_r", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("feed_id", "_r").agg(F.count("*").alias("length"), F.min("b").alias("from_s"))
    best = F.max(F.struct("length", (-F.col("from_s")).alias("f"))).alias("m")
    return runs.groupBy("feed_id").agg(best).select("feed_id", F.col("m.length").alias("length"), (-F.col("m.f")).alias("from_s"))
