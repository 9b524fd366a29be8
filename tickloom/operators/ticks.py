"""Event-time operators over ticks: highwater, ties, tumbling bars, silences, defects, merged order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import big, floor_div
from tickloom.operators.chunks import with_previous, with_running

#: Sequence numbers in a bucket of the two-level operators.
SEQ_WIDTH = 65_536


def highwater(ticks: DataFrame, feed: str = "feed_id", seq: str = "seq", time: str = "source_time", tie: tuple[str, ...] = ("quote_id",), width: int = 4096) -> DataFrame:
    """Adds ``available_ms`` (latest time so far in order of arrival, equal numbers by ``tie``) and ``late`` (before what was already seen).

    Late rows are kept and flagged, never dropped. Two levels: the running maximum within
    blocks of ``width`` sequence numbers, and over the blocks' maxima before.
    """
    t = ticks.withColumn("_k", floor_div(F.col(seq), big(width)))
    w = W.partitionBy(feed, "_k").orderBy(seq, *tie)
    t = t.withColumn("_in", F.max(time).over(w.rowsBetween(W.unboundedPreceding, -1)))
    tops = ticks.groupBy(feed, floor_div(F.col(seq), big(width)).alias("_k")).agg(F.max(time).alias("_top"))
    before = W.partitionBy(feed).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(feed, "_k", F.max("_top").over(before).alias("_was"))
    j = t.join(tops, [feed, "_k"], "left").withColumn("_seen", F.greatest("_in", "_was"))
    out = j.withColumn("available_ms", F.greatest("_seen", time)).withColumn("late", F.coalesce(F.col(time) < F.col("_seen"), F.lit(False)))
    return out.drop("_k", "_in", "_was", "_seen")


def tick_audit(ticks: DataFrame) -> DataFrame:
    """Per feed: rows, late ones, ties, exact repeats of the row before, invalid prices, spread and the longest silence.

    Times are admitted before prices are looked at; rows without a time are counted apart.
    """
    h = with_previous(highwater(ticks), ["feed_id"], ["seq", "quote_id"], ["quote_id", "source_time", "bid", "ask", "available_ms"], SEQ_WIDTH)
    same = lambda c: F.col(f"prev_{c}").eqNullSafe(F.col(c))
    first = F.col("prev_quote_id").isNull()
    bad = F.col("source_time").isNotNull() & (F.col("bid").isNull() | F.col("ask").isNull() | (F.col("bid") <= 0) | (F.col("ask") < F.col("bid")))
    r = h.withColumns(
        {
            "tie": ~first & (F.col("prev_source_time") == F.col("source_time")),
            "again": ~first & same("source_time") & same("bid") & same("ask"),
            "bad": F.coalesce(bad, F.lit(False)),
            "wait": F.col("available_ms") - F.col("prev_available_ms"),
        }
    )
    good = F.col("source_time").isNotNull() & ~F.col("late") & ~F.col("bad")
    spread = F.when(good, F.col("ask") - F.col("bid"))
    return r.groupBy("feed_id").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("source_time").isNull()).alias("no_time"),
        F.count_if("late").alias("late"),
        F.count_if(F.coalesce("tie", F.lit(False))).alias("ties"),
        F.count_if("again").alias("repeats"),
        F.count_if("bad").alias("bad_prices"),
        F.min(spread).alias("spread_min"),
        F.max(spread).alias("spread_max"),
        F.max("wait").alias("longest_wait_ms"),
    )


def day_counts(ticks: DataFrame) -> DataFrame:
    day = F.to_date(F.timestamp_millis("source_time")).cast("string").alias("day")
    return ticks.where("source_time is not null").groupBy("feed_id", day).agg(F.count("*").alias("rows"), F.count_if("is_valid").alias("valid"))


def tie_groups(ticks: DataFrame) -> DataFrame:
    """Runs of rows with one time in order of arrival; invalid rows stand alone; ``ambiguous`` where prices differ."""
    ok = F.coalesce(F.col("is_valid"), F.lit(False)) & F.col("source_time").isNotNull()
    order = ["seq", "quote_id"]
    t = ticks.select("feed_id", "seq", "quote_id", "source_time", "bid", "ask", ok.alias("_ok"))
    t = with_previous(t, ["feed_id"], order, ["_ok", "source_time"], SEQ_WIDTH, keep=True)
    joins = F.coalesce(F.col("_ok") & F.col("prev__ok") & (F.col("prev_source_time") == F.col("source_time")), F.lit(False))
    t = with_running(t, ["feed_id"], order, F.when(joins, 0).otherwise(1), "_g", SEQ_WIDTH)
    pair = F.struct("bid", "ask")
    return (
        t.groupBy("feed_id", "_g")
        .agg(
            F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.max("source_time").alias("ts_ms"),
            *[f(c).alias(f"{c}_{n}") for c in ("bid", "ask") for n, f in (("min", F.min), ("max", F.max))],
            (F.min(pair) != F.max(pair)).alias("ambiguous"), F.min("_ok").alias("eligible"),
        )
        .drop("_g")
    )


def tick_bars(ticks: DataFrame, width_ms: int = 60_000, price: str = "bid") -> DataFrame:
    """Tumbling bars of the bid (or the ask) with spread statistics: no empty bars are made up.

    Open and close go by (time, sequence); a bar is ``valid`` unless one of its rows is not.
    """
    t = ticks.where("source_time is not null").withColumn("bar_ms", floor_div(F.col("source_time"), big(width_ms)) * width_ms)
    ok = F.coalesce(F.col("is_valid"), F.lit(False)) & F.col("bid").isNotNull() & F.col("ask").isNotNull()
    at = F.when(ok, F.struct("source_time", "seq", "quote_id"))
    v = lambda c: F.when(ok, F.col(c))
    spread = F.when(ok, F.col("ask") - F.col("bid"))
    return t.groupBy("feed_id", "bar_ms").agg(
        F.min_by(price, at).alias("open"), F.max(v(price)).alias("high"), F.min(v(price)).alias("low"), F.max_by(price, at).alias("close"),
        F.count_if(ok).alias("n"), F.min(spread).alias("spread_min"), F.max(spread).alias("spread_max"), F.bool_and(ok).alias("valid"),
    )


def silences(ticks: DataFrame, limit_ms: int = 60_000) -> DataFrame:
    """Times at which a feed has been silent for ``limit_ms``: ``(feed_id, last_ms, silent_at_ms, back_ms)``."""
    h = highwater(ticks).where("available_ms is not null").select("feed_id", "seq", "quote_id", "available_ms")
    nxt = with_previous(h, ["feed_id"], ["seq", "quote_id"], ["available_ms"], SEQ_WIDTH, ahead=True)
    nxt = nxt.select("feed_id", F.col("available_ms").alias("last_ms"), F.col("next_available_ms").alias("back_ms"))
    return nxt.where(F.col("back_ms") - F.col("last_ms") > limit_ms).withColumn("silent_at_ms", F.col("last_ms") + limit_ms)


def defect_spans(ticks: DataFrame, minute_ms: int = 60_000) -> DataFrame:
    """Half-open minutes touched by late or invalid rows: ``(feed_id, a, z)``, for merging; unknown times have none."""
    h = highwater(ticks)
    bad = F.col("late") | ~F.coalesce(F.col("is_valid"), F.lit(False))
    a = floor_div(F.col("source_time"), big(minute_ms)) * minute_ms
    # A late row spoils everything from its own minute to the minute in which it was seen.
    z = floor_div(F.coalesce("available_ms", "source_time"), big(minute_ms)) * minute_ms + minute_ms
    return h.where(bad & F.col("source_time").isNotNull()).select("feed_id", a.alias("a"), z.alias("z"))


def merged_order(streams: list[tuple[DataFrame, str, int, Column]], feed: str = "feed_id", width: int = 3_600_000) -> DataFrame:
    """Typed events in one total order: ``(feed, time, phase, ordinal, kind)``, unknown times first.

    Two levels: rows are numbered within buckets of ``width``, and the buckets' counts, one row
    each, are summed up over the feed.
    """
    parts = [df.select(feed, t_.alias("time"), F.lit(phase).alias("phase"), F.col("ordinal"), F.lit(kind).alias("kind")) for df, kind, phase, t_ in streams]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("_tb", F.coalesce(floor_div(F.col("time"), big(width)), F.lit(-(1 << 62)).cast("bigint"))).repartition(feed, "_tb")
    before = F.sum("_n").over(W.partitionBy(feed).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1))
    counts = out.groupBy(feed, "_tb").agg(F.count("*").alias("_n")).select(feed, "_tb", F.coalesce(before, big(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(feed, "_tb").orderBy(F.asc_nulls_first("time"), "phase", "ordinal"))
    return out.withColumn("_in", inside).join(counts, [feed, "_tb"]).withColumn("place", F.col("_before") + F.col("_in")).drop("_tb", "_in", "_before")
