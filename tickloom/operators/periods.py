"""Overlapping and gapped intervals: merged periods and the gaps between them (problem 5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import big, floor_div
from tickloom.session import written

Batches = Iterator[pa.RecordBatch]


def _changes(*keys: pa.Array) -> np.ndarray:
    """True where a row's key differs from the row before; the first row is a change."""
    n = len(keys[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for k in keys:
            out[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
    return out


def disjoint(new: np.ndarray, s: np.ndarray, e: np.ndarray, touching: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Linear merge of intervals sorted by start within each key (``new`` marks a key's first row).

    Returns the index of each merged interval's first row, and its end. Touching ones merge if ``touching``.
    """
    n = len(s)
    # A running maximum that restarts with each key: over ranks of the ends, lifted by key.
    by_end = np.argsort(e, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_end] = np.arange(n)
    group = np.cumsum(new) - 1
    reach = e[by_end[np.maximum.accumulate(rank + group * n) - group * n]]
    begins = new.copy()
    begins[1:] |= s[1:] > reach[:-1] if touching else s[1:] >= reach[:-1]
    first = np.flatnonzero(begins)
    last = np.append(first[1:], n) - 1
    return first, reach[last]


def _emit(k: pa.Array, node: pa.Array, s: np.ndarray, e: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([k, node, pa.array(s), pa.array(e)], names=names)


def _partial(names: list[str], touching: bool) -> Callable[[Batches], Batches]:
    """Before any shuffle: each batch becomes one sorted disjoint list per (entity, slot)."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            k, node = b.column(0), b.column(1)
            s, e = b.column(2).to_numpy(), b.column(3).to_numpy()
            code = k.dictionary_encode().indices.to_numpy()
            order = np.lexsort((s, node.to_numpy(), code))
            k, node, s, e = k.take(pa.array(order)), node.take(pa.array(order)), s[order], e[order]
            first, end = disjoint(_changes(k, node), s, e, touching)
            at = pa.array(first)
            yield _emit(k.take(at), node.take(at), s[first], end, names)

    return run


def _combine(names: list[str], touching: bool) -> Callable[[Batches], Batches]:
    """Lists that arrive sorted by (entity, node, start) are merged in one pass; only the last period is held."""

    def run(batches: Batches) -> Batches:
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i) for i in range(4)]
            if held is not None:
                cols = [pa.concat_arrays([held.column(i), cols[i]]) for i in range(4)]
            k, node, s, e = cols[0], cols[1], cols[2].to_numpy(), cols[3].to_numpy()
            first, end = disjoint(_changes(k, node), s, e, touching)
            at = pa.array(first)
            out = _emit(k.take(at), node.take(at), s[first], end, names)
            held = out.slice(len(first) - 1)
            if len(first) > 1:
                yield out.slice(0, len(first) - 1)
        if held is not None:
            yield held

    return run


def merged_periods(
    intervals: DataFrame,
    *,
    entity: str,
    start: str,
    end: str,
    slot: int = 86_400,
    fanout: int = 32,
    levels: int = 2,
    touching: bool = True,
) -> DataFrame:
    """Per entity its continuous periods and the gaps between them: ``(entity, kind, from_s, to_s)``.

    ``start`` and ``end`` are integer columns of one unit (seconds for the default ``slot``).
    Intervals that overlap, nest or touch form one period; ``kind`` is ``period`` or ``gap``.
    Without ``touching`` those that only touch stay apart (with an empty gap between them).
    Rows with a null entity or bound, or not longer than zero, are ignored; repeated rows merge
    into themselves; an empty table gives no rows; other columns are not read.

    The aggregate is a sorted list of disjoint intervals. Partial lists per (entity, slot of the
    start) are made inside each input partition before any shuffle. A reduction tree combines
    the lists of equal slots, then of ``fanout`` neighbouring slots a level, each time by one
    linear pass over sorted lists that holds a single period. The tree stops at nodes of
    ``slot * fanout ** (levels - 1)``: an entity's nodes are then stitched by their summaries
    (how far everything before reaches), so no task ever holds an entity's whole list, however
    hot it is. The combined lists are written to the shared folder once, as they are read for
    the summaries and again for the rows.
    """
    names = ["_k", "_node", "_s", "_e"]
    rows = (
        intervals.select(F.col(entity).alias("_k"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
        .where("_k is not null and _s is not null and _e > _s")
        .select("_k", floor_div(F.col("_s"), big(slot)).alias("_node"), "_s", "_e")
    )
    lists = rows.mapInArrow(_partial(names, touching), rows.schema)
    for level in range(levels):
        if level:
            lists = lists.withColumn("_node", floor_div(F.col("_node"), big(fanout)))
        lists = lists.repartition("_k", "_node").sortWithinPartitions("_k", "_node", "_s").mapInArrow(_combine(names, touching), rows.schema)
    lists = written(lists, "periods")

    # How far all earlier nodes of the entity reach; what begins no later belongs to a period from before.
    earlier = W.partitionBy("_k").orderBy("_node").rowsBetween(W.unboundedPreceding, -1)
    reach = lists.groupBy("_k", "_node").agg(F.max("_e").alias("_top")).withColumn("_reach", F.max("_top").over(earlier))
    placed = lists.join(reach, ["_k", "_node"]).withColumn("_own", F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") if touching else F.col("_s") >= F.col("_reach")))
    node = placed.groupBy("_k", "_node").agg(
        F.min(F.when(F.col("_own"), F.col("_s"))).alias("_first"),
        F.greatest(F.max("_reach"), F.max(F.when(~F.col("_own"), F.col("_e")))).alias("_closed"),
        F.max("_top").alias("_top"),
    )
    later = W.partitionBy("_k").orderBy(F.desc("_node")).rowsBetween(W.unboundedPreceding, -1)
    step = F.when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("s"), F.col("_closed").alias("e")))
    node = (
        node.withColumn("_next", F.last(step, ignorenulls=True).over(later))
        .withColumn("_last", F.max("_top").over(W.partitionBy("_k")))
        .where("_first is not null")
        .select("_k", "_node", F.coalesce("_next.e", "_last").alias("_open_e"), F.col("_next.s").alias("_open_s"))
    )
    # Within a node only the last period can be lengthened from later nodes.
    own = placed.where("_own").select("_k", "_node", "_s", "_e").join(node, ["_k", "_node"])
    following = F.lead("_s").over(W.partitionBy("_k", "_node").orderBy("_s"))
    own = own.withColumn("_f", following).select(
        "_k",
        "_s",
        F.when(F.col("_f").isNull(), F.col("_open_e")).otherwise(F.col("_e")).alias("_e"),
        F.coalesce("_f", "_open_s").alias("_f"),
    )
    pieces = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("a"), F.col("_e").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("_e").alias("a"), F.col("_f").alias("b")),
    )
    return (
        own.select("_k", F.explode(pieces).alias("_x"))
        .select(F.col("_k").alias(entity), F.col("_x.kind").alias("kind"), F.col("_x.a").alias("from_s"), F.col("_x.b").alias("to_s"))
        .where("to_s is not null")
    )
