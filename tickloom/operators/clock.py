"""The trading calendar: open coordinate, elapsed time, deadlines, gaps and censoring.

Windows over a feed's clean bars are as long as its calendar at most (one bar a step), however
many candles were delivered; ticks, which have no such bound, are bucketed (see ``ticks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, US, big, floor_div, micros

NEW_YORK = "America/New_York"


def weekly_rule(local: Column) -> Column:
    """Sunday 17:00 to Friday 17:00, on local time (Monday = 0)."""
    dow, hour = F.weekday(local), F.hour(local)
    return (dow < 4) | ((dow == 4) & (hour < 17)) | ((dow == 6) & (hour >= 17))


def weekly_clock(spark: SparkSession, first_s: int, stop_s: int, rule=weekly_rule, zone: str = NEW_YORK) -> DataFrame:
    """``(minute_ts, active)`` for each UTC minute of ``[first_s, stop_s)`` by a rule of local time, daylight saving included."""
    minute = F.timestamp_seconds(F.col("id") * 60)
    ids = spark.range(-(-first_s // 60), -(-stop_s // 60))
    return ids.select(minute.alias("minute_ts"), rule(F.from_utc_timestamp(minute, zone)).alias("active"))


def coordinates(clock: DataFrame) -> DataFrame:
    """``(m, active, coord)``: for each minute (epoch s) the number of open minutes before it.

    Two levels: minutes are counted within their day, days are summed up; one task sees a day.
    The minute after the last one is kept as an endpoint that is closed.
    """
    rows = clock.select(floor_div(micros("minute_ts"), big(US)).alias("m"), F.coalesce("active", F.lit(False)).alias("active")).where("m is not null")
    rows = rows.groupBy("m").agg(F.max("active").alias("active"))
    end = rows.agg((F.max("m") + 60).alias("m")).where("m is not null").withColumn("active", F.lit(False))
    rows = rows.unionByName(end).withColumn("day", floor_div(F.col("m"), big(DAY_S)))
    per_day = rows.groupBy("day").agg(F.count_if("active").alias("n"))
    base = per_day.select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), big(0)).alias("base"))
    inner = F.coalesce(F.sum(F.col("active").cast("bigint")).over(W.partitionBy("day").orderBy("m").rowsBetween(W.unboundedPreceding, -1)), big(0))
    return rows.join(base, "day").select("m", "active", (F.col("base") + inner).alias("coord"))


def open_minutes(coords: DataFrame) -> DataFrame:
    """The inverse: ``(rank, m)`` of the open minutes, ``rank`` counted from 0."""
    return coords.where("active").select(F.col("coord").alias("rank"), "m")


def with_coordinate(rows: DataFrame, coords: DataFrame, time: str, out: str) -> DataFrame:
    """Adds the open coordinate of a whole-minute epoch second; null off the calendar."""
    return rows.join(coords.select(F.col("m").alias(time), F.col("coord").alias(out)), time, "left")


def elapsed(rows: DataFrame, coords: DataFrame, start: str, end: str, out: str = "open_min") -> DataFrame:
    """Open minutes between two instants, by two equi-joins with the coordinates."""
    j = with_coordinate(with_coordinate(rows, coords, start, "_c0"), coords, end, "_c1")
    return j.withColumn(out, F.col("_c1") - F.col("_c0")).drop("_c0", "_c1")


def deadlines(rows: DataFrame, coords: DataFrame, start: str, horizon: int | Column, out: str = "deadline_s") -> DataFrame:
    """Earliest instant at which ``horizon`` open minutes have gone by since ``start``.

    On a closure that is its beginning (Friday's close), not the next opening.
    """
    j = with_coordinate(rows, coords, start, "_c")
    j = j.withColumn("_rank", F.col("_c") + horizon - 1)
    inverse = open_minutes(coords).select(F.col("rank").alias("_rank"), (F.col("m") + 60).alias(out))
    return j.join(inverse, "_rank", "left").drop("_rank", "_c")


def gap_breaks(bars: DataFrame, coords: DataFrame, threshold: int = 15) -> DataFrame:
    """M1 bars inside the session with ``missing`` open minutes since the bar before, and ``broke`` from ``threshold`` of them."""
    inside = coords.where("active").select(F.col("m").alias("b"), "coord")
    j = bars.join(inside, "b")
    w = W.partitionBy("feed_id").orderBy("b")
    missing = F.col("coord") - F.lag("coord").over(w) - 1
    return j.withColumn("missing", missing).withColumn("broke", F.coalesce(F.col("missing") >= threshold, F.lit(False)))


def segments(broken: DataFrame) -> DataFrame:
    """Adds ``seg``, the number of breaks of the feed so far."""
    w = W.partitionBy("feed_id").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    return broken.withColumn("seg", F.sum(F.col("broke").cast("bigint")).over(w))


def censor_times(broken: DataFrame, coords: DataFrame, threshold: int = 15) -> DataFrame:
    """Per bar the instant at which a long gap after it is known: ``threshold + 1`` open minutes after the
    last bar before the gap. The end of the feed censors at once."""
    w = W.partitionBy("feed_id").orderBy("b")
    nxt = broken.withColumn("_gap", F.lead("broke").over(w)).withColumn("_end", F.lead("b").over(w).isNull())
    d = deadlines(nxt, coords, "b", threshold + 1, "_dl")
    barrier = F.when(F.col("_end"), F.col("b") + 60).when(F.col("_gap"), F.col("_dl"))
    ahead = W.partitionBy("feed_id").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("censor_s", F.min(barrier).over(ahead)).drop("_gap", "_end", "_dl")


def rollovers(spark: SparkSession, first_day: str, stop_day: str, zone: str = NEW_YORK) -> DataFrame:
    """17:00 local on weekdays, as epoch s, with the factor of days of funding: 3 on Wednesday, else 1."""
    days = spark.sql(f"select explode(sequence(date'{first_day}', date_sub(date'{stop_day}', 1))) as day")
    at = F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit("17:00:00"))), zone)
    dow = F.weekday("day")
    return days.where(dow < 5).select(floor_div(micros(at), big(US)).alias("at_s"), F.when(dow == 2, 3).otherwise(1).alias("factor"))


def month_windows(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Adds ``month_from`` and ``month_to`` (epoch s): one row for each UTC month that ``[first, last)`` touches."""
    start = F.trunc(F.timestamp_seconds(first).cast("date"), "month")
    stop = F.trunc(F.timestamp_seconds(F.col(last) - 1).cast("date"), "month")
    months = F.explode(F.sequence(start, stop, F.expr("interval 1 month"))).alias("_m")
    sec = lambda d: F.unix_seconds(d.cast("timestamp"))
    return rows.select("*", months).select("*", sec(F.col("_m")).alias("month_from"), sec(F.add_months("_m", 1)).alias("month_to")).drop("_m")


def period_windows(rows: DataFrame, first: str, last: str, unit: str) -> DataFrame:
    """The same for weeks (from Monday) or quarters: ``period_from`` and ``period_to``."""
    step = {"week": F.expr("interval 7 days"), "quarter": F.expr("interval 3 months")}[unit]
    begin = lambda c: F.date_trunc(unit, F.timestamp_seconds(c)).cast("date")
    x = rows.select("*", F.explode(F.sequence(begin(F.col(first)), begin(F.col(last) - 1), step)).alias("_p"))
    until = F.date_add("_p", 7) if unit == "week" else F.add_months("_p", 3)
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    return x.select("*", sec(F.col("_p")).alias("period_from"), sec(until).alias("period_to")).drop("_p")


# --- instants in milliseconds against a calendar of disjoint intervals ---------------------------


def intervals_ms(clock: DataFrame) -> DataFrame:
    """Disjoint half-open open intervals ``(start_ms, end_ms, prefix_ms)``; about fifty rows a year."""
    on = clock.where("active and minute_ts is not null").select(floor_div(micros("minute_ts"), big(60 * US)).alias("m")).distinct()
    on = on.withColumn("day", floor_div(F.col("m"), big(1440)))
    isl = on.withColumn("k", F.col("m") - F.row_number().over(W.partitionBy("day").orderBy("m")))
    runs = isl.groupBy("day", "k").agg(F.min("m").alias("a"), (F.max("m") + 1).alias("z"))
    w = W.orderBy("a")  # a run a day or so: the calendar's own length
    runs = runs.withColumn("new", F.coalesce((F.col("a") != F.lag("z").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    iv = runs.groupBy("g").agg((F.min("a") * 60_000).alias("start_ms"), (F.max("z") * 60_000).alias("end_ms"))
    before = W.orderBy("start_ms").rowsBetween(W.unboundedPreceding, -1)
    return iv.select("start_ms", "end_ms", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(before), big(0)).alias("prefix_ms"))


def coordinate_ms(rows: DataFrame, clock: DataFrame, time: str) -> DataFrame:
    """Adds ``open_ms`` (open milliseconds before ``time``), ``is_open`` and ``next_open_ms``.

    An equi-join on the minute gives everything but the milliseconds: no range join is needed.
    """
    coords = coordinates(clock)
    later = W.orderBy("day").rowsBetween(1, W.unboundedFollowing)
    by_day = coords.withColumn("day", floor_div(F.col("m"), big(DAY_S)))
    day_first = by_day.groupBy("day").agg(F.min(F.when(F.col("active"), F.col("m"))).alias("_f"))
    day_first = day_first.withColumn("_next_day", F.min("_f").over(later)).select("day", "_next_day")
    in_day = F.min(F.when(F.col("active"), F.col("m"))).over(W.partitionBy("day").orderBy("m").rowsBetween(0, W.unboundedFollowing))
    table = by_day.withColumn("_in", in_day).join(day_first, "day").select("m", "active", "coord", F.coalesce("_in", "_next_day").alias("_open"))
    j = rows.withColumn("m", floor_div(F.col(time), big(60_000)) * 60).join(table, "m", "left")
    inside = F.col(time) - F.col("m") * 1000
    return j.select(
        *rows.columns,
        (F.col("coord") * 60_000 + F.when(F.col("active"), inside).otherwise(0)).alias("open_ms"),
        F.coalesce("active", F.lit(False)).alias("is_open"),
        F.when(F.col("active"), F.col(time)).otherwise(F.col("_open") * 1000).alias("next_open_ms"),
    )


def advance_ms(rows: DataFrame, clock: DataFrame, time: str, duration: int, out: str = "deadline_ms") -> DataFrame:
    """Earliest instant with ``duration`` open milliseconds after ``time``: the inverse of ``coordinate_ms``."""
    inverse = open_minutes(coordinates(clock)).select(F.col("rank").alias("_rank"), F.col("m").alias("_m"))
    j = coordinate_ms(rows, clock, time).withColumn("_target", F.col("open_ms") + duration)
    j = j.withColumn("_rank", floor_div(F.col("_target") - 1, big(60_000)))
    return j.join(inverse, "_rank", "left").select(*rows.columns, (F.col("_m") * 1000 + F.col("_target") - F.col("_rank") * 60_000).alias(out))
