"""Rolling totals over trailing periods (problem 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, US, big, col, floor_div, micros


def daily_totals(readings: DataFrame, *, entity: str, ts: str, value: str) -> DataFrame:
    """``(_s, day, n, total)`` per entity and UTC day with readings; null times and values do not count."""
    return (
        readings.select(col(entity).alias("_s"), floor_div(micros(ts), big(DAY_S * US)).alias("day"), col(value).alias("_v"))
        .where("_s is not null and day is not null and _v is not null")
        .groupBy("_s", "day")
        .agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    )


def trailing_totals(
    readings: DataFrame,
    entities: DataFrame,
    *,
    entity: str = "feed_id",
    ts: str = "ts",
    value: str = "close_px",
    first: str = "first_ts",
    last: str = "last_ts",
    periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """Per entity and UTC day of its life: count, sum and mean over each trailing period of days.

    Columns: ``entity, day_s, n_1d`` and for each period ``k``: ``n_kd, sum_kd, mean_kd``. The
    day itself is the last of a period. Days without readings are there too, with count 0; sum
    and mean of a period without any reading are null (unknown is not zero). Readings outside
    the life never make a day, but the periods of the first days do reach back to them.

    An entity's days run from the UTC day of ``first`` to that of the last instant before
    ``last``; one with a null bound or an empty life has no rows. Repeated rows of an entity
    merge (earliest first, latest last); repeated readings count each. Empty inputs give no
    rows or zero counts. Only named columns are read.

    Distribution: readings collapse to one row per entity and day before they are shuffled, so
    a hot entity is no larger than a calendar. The calendar product is made by a sequence per
    entity (no cross join) and the frames are fixed numbers of rows, because the days are dense.
    """
    longest = max(periods)
    daily = daily_totals(readings, entity=entity, ts=ts, value=value)
    life = (
        entities.select(col(entity).alias("_s"), micros(first).alias("_from"), micros(last).alias("_to"))
        .where("_s is not null and _from is not null and _to is not null")
        .groupBy("_s")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
        .where("_from < _to")
        .select("_s", floor_div(F.col("_from"), big(DAY_S * US)).alias("_d0"), floor_div(F.col("_to") - 1, big(DAY_S * US)).alias("_d1"))
    )
    dense = life.select("_s", "_d0", F.explode(F.sequence(F.col("_d0") - (longest - 1), F.col("_d1"))).alias("day"))
    rows = dense.join(daily, ["_s", "day"], "left")
    w = W.partitionBy("_s").orderBy("day")
    out = [F.col("_s").alias(entity), (F.col("day") * DAY_S).alias("day_s"), F.coalesce("n", big(0)).alias("n_1d"), F.col("_d0"), F.col("day")]
    for k in periods:
        frame = w.rowsBetween(-(k - 1), 0)
        n, total = F.coalesce(F.sum("n").over(frame), big(0)), F.sum("total").over(frame)
        out += [n.alias(f"n_{k}d"), total.alias(f"sum_{k}d"), (total.cast("double") / F.when(n > 0, n)).alias(f"mean_{k}d")]
    return rows.select(*out).where("day >= _d0").drop("day", "_d0")


def idle_days(totals: DataFrame, *, entity: str = "feed_id", week: int = 7) -> DataFrame:
    """``(entity, day_s)`` of days without a reading in a period of ``week`` days that has one."""
    return totals.where((F.col("n_1d") == 0) & (F.col(f"n_{week}d") > 0)).select(entity, "day_s")
