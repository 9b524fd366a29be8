"""Matching records by nearest time (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import big, floor_div


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    right_id: str,
    entity: str,
    left_time: str,
    right_time: str,
    tolerance: int,
) -> DataFrame:
    """Every left row with the right row of its entity that is nearest in time: ``(left_id, right_id, gap)``.

    Times are integers of one unit; at most ``tolerance`` apart, before or after, the bound
    included. Of equally near rows the earlier time wins, then the smaller ``right_id``. Left
    rows without a match, with a null entity or a null time come out with nulls, so the result
    has as many rows as ``left``; ``gap`` is right minus left time. Right rows with a null
    entity, time or id never match. Repeated rows on either side are each taken as they are.
    Empty tables and other columns, clashing ones too, do no harm.

    Method: both sides get time buckets as wide as the tolerance, so that a match is in the
    same or an adjacent bucket. Distinct left times go to their three buckets, right ones to
    their own, and within (entity, bucket) the two are merged in order of time: the last right
    row at or before a left one and the first at or after it are all that can be nearest, so
    no pairs are made and a bucket however full costs one sort. Of the (up to six) candidates
    a left time keeps the minimum of (distance, time, id).

    Distribution: buckets split an entity that holds a third of all rows by time. Right rows of
    one instant collapse to the smallest id and left rows of one instant to that instant before
    they are shuffled to the merge; the last join puts the rows back (AQE splits a hot instant).
    """
    b = big(tolerance) if tolerance > 0 else big(1)
    rows = left.select(F.col(left_id).alias("_l"), F.col(entity).alias("_s"), F.col(left_time).cast("bigint").alias("_t"))
    at = rows.where("_s is not null and _t is not null").select("_s", "_t").distinct()
    spread = F.explode(F.sequence(floor_div(F.col("_t"), b) - 1, floor_div(F.col("_t"), b) + 1))
    asked = at.select("_s", spread.alias("_b"), "_t", F.lit(None).cast("bigint").alias("_r"))
    have = (
        right.select(F.col(entity).alias("_s"), F.col(right_time).cast("bigint").alias("_t"), F.col(right_id).cast("bigint").alias("_r"))
        .where("_s is not null and _t is not null and _r is not null")
        .groupBy("_s", "_t")
        .agg(F.min("_r").alias("_r"))
        .select("_s", floor_div(F.col("_t"), b).alias("_b"), "_t", "_r")
    )
    both = have.unionByName(asked).withColumn("_x", F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).withColumn("_q", F.col("_r").isNull())
    # At one instant right rows come first in both directions, so that distance 0 is seen.
    up = W.partitionBy("_s", "_b").orderBy("_t", "_q").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("_s", "_b").orderBy(F.desc("_t"), F.asc("_q")).rowsBetween(W.unboundedPreceding, 0)
    merged = both.repartition("_s", "_b").withColumns({"_p": F.last("_x", ignorenulls=True).over(up), "_n": F.last("_x", ignorenulls=True).over(down)}).where("_q")

    def ranked(c: str):
        d = F.abs(F.col(f"{c}._t") - F.col("_t"))
        return F.when(d <= tolerance, F.struct(d.alias("d"), F.col(f"{c}._t").alias("t"), F.col(f"{c}._r").alias("r")))

    best = merged.select("_s", "_t", F.least(ranked("_p"), ranked("_n")).alias("_m")).where("_m is not null").groupBy("_s", "_t").agg(F.min("_m").alias("_m"))
    return rows.join(best, ["_s", "_t"], "left").select(
        F.col("_l").alias(left_id),
        F.col("_m.r").alias(right_id),
        (F.col("_m.t") - F.col("_t")).alias("gap"),
    )
