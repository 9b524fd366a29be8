"""Candles to clean bars: validation, quarantine, gaps, coverage and side reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, US, big, floor_div, micros

PRICES = ("open_px", "high_px", "low_px", "close_px")


def violation(prices: tuple[str, str, str, str] = PRICES) -> Column:
    """First reason why a candle's prices can't be used, or null: ``missing``, ``not_positive``, ``range``."""
    o, h, lo, c = (F.col(x) for x in prices)
    return (
        F.when(o.isNull() | h.isNull() | lo.isNull() | c.isNull(), "missing")
        .when(F.least(o, h, lo, c) <= 0, "not_positive")
        .when((lo > F.least(o, c)) | (F.greatest(o, c) > h), "range")
    )


def stamped(candles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Candles with a known feed and time, and the start ``b`` (epoch s) of the bar they lie in."""
    f = feeds.select("feed_id", F.col("bar_seconds").cast("bigint").alias("step"))
    t = micros("ts")
    return (
        candles.select("candle_id", "feed_id", t.alias("t_us"), *PRICES, "volume", micros("ingested_at").alias("in_us"))
        .where("feed_id is not null and t_us is not null")
        .join(f, "feed_id")
        .withColumn("b", floor_div(F.col("t_us"), F.col("step") * US) * F.col("step"))
    )


def clean_bars(candles: DataFrame, feeds: DataFrame) -> DataFrame:
    """One valid bar per feed and bar start: ``(feed_id, step, b, open, high, low, close)``.

    Invalid candles are left out; of several in one bar the one that came in last counts
    (nulls first, then the larger id), so revisions win and repeats do not matter.
    """
    rows = stamped(candles, feeds).where(violation().isNull())
    best = F.max(F.struct("in_us", "candle_id", *[F.col(p) for p in PRICES])).alias("_m")
    named = [F.col(f"_m.{p}").alias(p.split("_")[0]) for p in PRICES]
    return rows.groupBy("feed_id", "step", "b").agg(best).select("feed_id", "step", "b", *named)


def candle_violations(candles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Candles that fail validation with the first reason in order: prices, then alignment to the bar."""
    rows = stamped(candles, feeds)
    reason = F.coalesce(violation(), F.when(F.col("t_us") != F.col("b") * US, "misaligned"))
    return rows.select("candle_id", "feed_id", reason.alias("reason")).where("reason is not null")


def quarantine(candles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every copy of a time stamp that a feed has more than once; none of them is trusted."""
    keys = stamped(candles, feeds).select("candle_id", "feed_id", "t_us")
    n = F.count("*").over(W.partitionBy("feed_id", "t_us"))
    return keys.withColumn("copies", n).where("copies > 1")


def gaps(bars: DataFrame) -> DataFrame:
    """Missing bars between consecutive ones: ``(feed_id, gap_from, gap_to, missing)``, half open."""
    prev = F.lag("b").over(W.partitionBy("feed_id").orderBy("b"))
    return (
        bars.select("feed_id", "step", "b", (prev + F.col("step")).alias("gap_from"))
        .where("gap_from < b")
        .select("feed_id", "gap_from", F.col("b").alias("gap_to"), F.call_function("div", F.col("b") - F.col("gap_from"), F.col("step")).alias("missing"))
    )


def gap_triage(bars: DataFrame, candles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Missing bars by month and likely cause: ``quarantined`` (there were candles, none valid), ``weekend``, ``unresolved``."""
    g = gaps(bars).join(feeds.select("feed_id", F.col("bar_seconds").cast("bigint").alias("step")), "feed_id")
    missing = g.select("feed_id", F.explode(F.sequence(F.col("gap_from"), F.col("gap_to") - 1, F.col("step"))).alias("b"))
    had = stamped(candles, feeds).select("feed_id", "b").distinct().withColumn("had", F.lit(True))
    dow = F.pmod(floor_div(F.col("b"), big(DAY_S)) + 3, F.lit(7))  # Monday = 0
    hour = floor_div(F.pmod(F.col("b"), F.lit(DAY_S)), big(3600))
    weekend = (dow == 5) | ((dow == 4) & (hour >= 21)) | ((dow == 6) & (hour < 23))
    cause = F.when(F.col("had"), "quarantined").when(weekend, "weekend").otherwise("unresolved")
    month = F.date_format(F.timestamp_seconds("b"), "yyyy-MM")
    return missing.join(had, ["feed_id", "b"], "left").groupBy("feed_id", month.alias("month"), cause.alias("cause")).agg(F.count("*").alias("missing"))


def month_coverage(bars: DataFrame) -> DataFrame:
    month = F.date_format(F.timestamp_seconds("b"), "yyyy-MM").alias("month")
    return bars.groupBy("feed_id", month).agg(
        F.count("*").alias("bars"), F.min("b").alias("first_s"), F.max("b").alias("last_s"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Full reconciliation of two sides by key, per day: rows in both, on either side only, and whether the day is accepted."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, keys, "full")
    n = lambda c: F.count_if(c)
    out = j.groupBy(keys[0], day).agg(
        n(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        n(F.col("_r").isNull()).alias("left_only"),
        n(F.col("_l").isNull()).alias("right_only"),
    )
    return out.withColumn("accepted", (F.col("left_only") == 0) & (F.col("right_only") == 0))
