"""Composite operators: projections of one side, range counts, zone maps, top-k, samples, contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import big, floor_div
from tickloom.operators.chunks import with_running
from tickloom.operators.intervals import asof_backward, ordered_marks


def unbroken(segmented: DataFrame, lookback: int = 241) -> DataFrame:
    """``(feed_id, b, valid)``: whether the last ``lookback`` bars up to this one come without a break."""
    w = W.partitionBy("feed_id").orderBy("b")
    breaks = F.col("seg") - F.lag("seg", lookback).over(w)  # ``seg`` counts breaks: a difference of running sums
    return segmented.select("feed_id", "b", F.coalesce(breaks == 0, F.lit(False)).alias("valid"))


def one_sided(rows: DataFrame, labels: DataFrame, keys: list[str], side: str, outcome: str, none: str = "no_primary_signal") -> DataFrame:
    """Every row kept, with the outcome of the side it selects; ``none`` where it selects no side or there is no label."""
    l_ = labels.select(*keys, side, outcome)
    j = rows.join(l_, [*keys, side], "left")
    return j.select(*keys, side, F.coalesce(outcome, F.lit(none)).alias(outcome))


def range_count(ranges: DataFrame, points: DataFrame, group: str, start: str, stop: str, at: str, width: int, out: str = "n") -> DataFrame:
    """Adds how many points of the group lie in ``[start, stop)``: a running count looked up as-of at both ends."""
    p = points.groupBy(group, at).agg(F.count("*").alias("_k"))
    p = with_running(p, [group], [at], F.col("_k"), "_cum", width)
    x = ranges
    for t, name in ((start, "_c0"), (stop, "_c1")):
        x = asof_backward(x, p.select(group, at, F.col("_cum").alias(name)), group, t, at, [name], width, strict=True)
    return x.withColumn(out, F.coalesce("_c1", big(0)) - F.coalesce("_c0", big(0))).drop("_c0", "_c1")


def zone_map(rows: DataFrame, group: str, order: str, tie: str, value: Column, block: int = 1024) -> DataFrame:
    """Per block of consecutive order numbers: bounds, count and ordered extremes, for pruned searches."""
    x = rows.withColumn("_blk", floor_div(F.col(order), big(block)))
    key = F.struct(group, "_blk")
    x = x.withColumn("_key", key)
    marks = ordered_marks(x, "_key", [order, tie], value, F.lit(0))
    return marks.select(F.col(f"_key.{group}").alias(group), F.col("_key._blk").alias("block"), "low", "high", "max_drop", "max_rise", "n")


def top_k(rows: DataFrame, group: str, score: Column, tie: str, k: int, salts: int = 16) -> DataFrame:
    """The ``k`` best rows of each group with ``place``; equal scores by the smaller ``tie``.

    First within salted parts of the group, then among their winners: a hot group is no bottleneck.
    """
    x = rows.withColumn("_score", score).where("_score is not null").withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    best = [F.desc("_score"), F.asc(tie)]
    part = x.withColumn("_r", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*best))).where(F.col("_r") <= k)
    out = part.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*best))).where(F.col("place") <= k)
    return out.drop("_salt", "_r").withColumnRenamed("_score", "score")


def hashed_sample(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """The ``n`` rows whose seeded key hashes lowest: the same rows whatever the order and partitioning (a sampling operator)."""
    h = F.sha2(F.concat_ws("/", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def contrasts(rows: DataFrame, by: list[str], losses: dict[str, Column]) -> DataFrame:
    """Mean difference of the losses of every ordered pair of members, in one pass: ``(by, left, right, delta)``."""
    names = list(losses)
    wide = rows.select(*by, *[losses[n].alias(f"_l_{n}") for n in names])
    pairs = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.col(f"_l_{a}") - F.col(f"_l_{b}")).alias("d")) for a in names for b in names if a != b])
    long = wide.select(*by, F.explode(pairs).alias("_p"))
    return long.groupBy(*by, F.col("_p.left").alias("left"), F.col("_p.right").alias("right")).agg(F.avg("_p.d").alias("delta"))


def sequence_faults(singles: DataFrame, ranges: DataFrame, group: str, seq: str, first: str, last: str) -> DataFrame:
    """Sequence numbers of single rows against those that ranges claim: in both, on one side only, claimed twice."""
    claimed = ranges.where(F.col(first) <= F.col(last)).select(group, F.explode(F.sequence(first, last)).alias(seq)).groupBy(group, seq).agg(F.count("*").alias("_c"))
    have = singles.groupBy(group, seq).agg(F.count("*").alias("_h"))
    j = have.join(claimed, [group, seq], "full")
    return j.groupBy(group).agg(
        F.count_if(F.col("_h").isNotNull() & F.col("_c").isNotNull()).alias("both"),
        F.count_if(F.col("_c").isNull()).alias("unclaimed"),
        F.count_if(F.col("_h").isNull()).alias("missing"),
        F.count_if(F.col("_c") > 1).alias("claimed_twice"),
    )
