"""Sequences cut into chunks of bounded length with a halo, for kernels that need neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import big, floor_div


def stamp_chunks(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    *,
    width: int,
    chunk: int,
    halo: int,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Rows with ``_rank`` (number of their time stamp within the key), ``_chunk`` and ``_own``.

    A chunk holds ``chunk`` consecutive distinct stamps and ``halo`` more on both sides (rows
    with ``_own`` false). Ranks are exact without any task seeing a key's whole sequence:
    stamps are numbered within buckets of ``width`` time units, and the buckets' sizes (one
    row a bucket) are summed up over the key. ``carry`` (columns: keys and more) is joined to
    the buckets, not to the rows.
    """
    keys = list(keys)
    bucket = rows.withColumn("_tb", floor_div(F.col(time), big(width))).repartition(*keys, "_tb")
    ranked = bucket.withColumn("_rn", F.dense_rank().over(W.partitionBy(*keys, "_tb").orderBy(time)))
    sizes = ranked.groupBy(*keys, "_tb").agg(F.max("_rn").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(before), big(0))).drop("_size")
    if carry is not None:
        sizes = sizes.join(carry, keys)
    placed = ranked.join(sizes, [*keys, "_tb"]).withColumn("_rank", F.col("_off") + F.col("_rn") - 1)
    c0, c1 = (floor_div(F.col("_rank") + d, big(chunk)) for d in (-halo, halo))
    return (
        placed.withColumn("_chunk", F.explode(F.sequence(c0, c1)))
        .withColumn("_own", floor_div(F.col("_rank"), big(chunk)) == F.col("_chunk"))
        .drop("_tb", "_rn", "_off")
    )


def _bucketed(rows: DataFrame, keys: Sequence[str], by: str, width: int) -> DataFrame:
    if "_tb" in rows.columns:
        return rows
    return rows.withColumn("_tb", floor_div(F.col(by), big(width))).repartition(*keys, "_tb")


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str], width: int, ahead: bool = False, keep: bool = False) -> DataFrame:
    """Adds ``prev_<c>`` (``next_<c>`` with ``ahead``): values of the row before in order of its key.

    ``order[0]`` is an integer that is cut into buckets of ``width``; a row looks into its own
    bucket, and the first one of a bucket at the nearest bucket before that has rows, of which
    there is one summary row. So a lag never needs a task that holds a whole key.
    """
    keys, order = list(keys), list(order)
    x = _bucketed(rows, keys, order[0], width)
    up = [F.desc(c) if ahead else F.asc(c) for c in order]
    value = F.struct(*[F.col(c).alias(c) for c in take])
    inner = F.lag(value).over(W.partitionBy(*keys, "_tb").orderBy(*up))
    edge = (F.min_by if ahead else F.max_by)(value, F.struct(*order))
    edges = x.groupBy(*keys, "_tb").agg(edge.alias("_e"))
    w = W.partitionBy(*keys).orderBy(F.desc("_tb") if ahead else F.asc("_tb"))
    edges = edges.select(*keys, "_tb", F.lag("_e").over(w).alias("_c"))
    name = "next" if ahead else "prev"
    out = x.withColumn("_v", inner).join(edges, [*keys, "_tb"]).withColumn("_v", F.coalesce("_v", "_c"))
    out = out.select(*x.columns, *[F.col(f"_v.{c}").alias(f"{name}_{c}") for c in take])
    return out if keep else out.drop("_tb")


def with_running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value, out, width: int, how: str = "sum", keep: bool = False) -> DataFrame:
    """Adds the running ``sum``, ``max`` or ``min`` of a column up to and with each row, by the same two levels.

    Several columns at once: ``value`` and ``out`` as lists of equal length.
    """
    keys, order = list(keys), list(order)
    values, outs = (value, out) if isinstance(out, list) else ([value], [out])
    ids = range(len(outs))
    f = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    x = _bucketed(rows, keys, order[0], width).withColumns({f"_v{i}": v for i, v in enumerate(values)})
    w = W.partitionBy(*keys, "_tb").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    tops = x.groupBy(*keys, "_tb").agg(*[f(f"_v{i}").alias(f"_t{i}") for i in ids])
    before = W.partitionBy(*keys).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*keys, "_tb", *[f(f"_t{i}").over(before).alias(f"_b{i}") for i in ids])
    j = x.withColumns({f"_i{i}": f(f"_v{i}").over(w) for i in ids}).join(tops, [*keys, "_tb"])

    def total(i: int):
        a, b = F.col(f"_i{i}"), F.col(f"_b{i}")
        if how == "sum":
            return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        return (F.greatest if how == "max" else F.least)(a, b)

    res = j.withColumns({o: total(i) for i, o in enumerate(outs)}).drop(*[f"_{k}{i}" for i in ids for k in "vib"])
    return res if keep else res.drop("_tb")
