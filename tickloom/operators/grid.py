"""Irregular readings onto a regular grid (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, US, big, ceil_seconds, ceil_to, col, floor_div, micros
from tickloom.session import written

OBSERVED, INTERPOLATED, MISSING = "observed", "interpolated", "missing"


def active_runs(clock: DataFrame, minute: str = "minute_ts", active: str = "active") -> DataFrame:
    """Runs of active minutes, cut at UTC midnight: ``(day, run_from, run_to)`` in epoch seconds, half open.

    One short window per day, so no task ever sees the whole calendar. Null minutes and rows
    whose flag is null or false are outside the session; repeated minutes count once.
    """
    m = floor_div(micros(minute), big(60 * US))
    on = clock.where(col(active) & col(minute).isNotNull()).select(m.alias("_m")).distinct()
    on = on.select("_m", floor_div(F.col("_m"), big(1440)).alias("day"))
    island = F.col("_m") - F.row_number().over(W.partitionBy("day").orderBy("_m"))
    return (
        on.withColumn("_k", island)
        .groupBy("day", "_k")
        .agg((F.min("_m") * 60).alias("run_from"), (F.max("_m") * 60 + 60).alias("run_to"))
        .drop("_k")
    )


#: A calendar of more runs is not sent to the sources' days but joined by a shuffle: 200,000 are 5 MB.
CALENDAR_RUNS = 200_000


def sized_calendar(runs: DataFrame) -> DataFrame:
    """The session's runs, about one a day, written once and counted: the side that is sent out in the join, while it is small.

    Left to itself the planner would send the sources' days, of which it only knows how large the
    sources' file is, and they grow with both.
    """
    runs = written(runs, "calendar")
    return F.broadcast(runs) if runs.count() <= CALENDAR_RUNS else runs.hint("merge")


def source_spans(sources: DataFrame, source: str, step: str, first: str, last: str) -> DataFrame:
    """``(_s, _step, _from, _to)``: whole seconds ``b`` of ``first <= b < last`` are ``_from <= b < _to``.

    Repeated rows of a source merge (earliest start, latest end, shortest step); rows with a
    null or a step below one are left out.
    """
    return (
        sources.select(col(source).alias("_s"), col(step).cast("bigint").alias("_step"), ceil_seconds(micros(first)).alias("_from"), ceil_seconds(micros(last)).alias("_to"))
        .where("_s is not null and _step > 0 and _from is not null and _to is not null")
        .groupBy("_s")
        .agg(F.min("_step").alias("_step"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    )


def expected_bars(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """``(_s, _step, _b)``: the instants each source is expected to have a reading for.

    Sources are cut into their days first, so that the join with the calendar has an equality
    on the day; the instants are generated after it, straight from each run's bounds.
    """
    day = F.explode(F.sequence(floor_div(F.col("_from"), big(DAY_S)), floor_div(F.col("_to") - 1, big(DAY_S)))).alias("day")
    days = spans.where("_from < _to").select("_s", "_step", "_from", "_to", day)
    lo = ceil_to(F.greatest("_from", "run_from"), F.col("_step"))
    hi = F.least("_to", "run_to") - 1
    return (
        days.join(runs, "day")
        .select("_s", "_step", lo.alias("_lo"), hi.alias("_hi"))
        .where("_lo <= _hi")
        .select("_s", "_step", F.explode(F.sequence("_lo", "_hi", "_step")).alias("_b"))
        .where("_b % 60 = 0")  # the session is known by minutes: a bar has to begin with one
    )


def regular_grid(
    readings: DataFrame,
    sources: DataFrame,
    clock: DataFrame,
    *,
    source: str = "feed_id",
    ts: str = "ts",
    value: str = "close_px",
    step: str = "bar_seconds",
    first: str = "first_ts",
    last: str = "last_ts",
    prefer: Sequence[str] = ("ingested_at", "candle_id"),
    minute: str = "minute_ts",
    active: str = "active",
    max_gap_steps: int = 6,
    chunk_steps: int = 4096,
) -> DataFrame:
    """One row per source and expected instant: ``(source, bar_s, mark, value)``.

    ``mark`` is ``observed`` where a reading with a known time and value lies in
    ``[bar_s, bar_s + step)``; its value is the one of the reading that is last by ``prefer``
    (then by time), so a revised bar wins over the first delivery. Elsewhere the grid is merged
    as-of with the readings on both sides, and where these two are at most ``max_gap_steps``
    steps apart the value is interpolated by time (``interpolated``); else it is null
    (``missing``). ``value`` is a DOUBLE. Readings off the grid (outside the session or the
    source's span) never make a row but do serve as neighbours.

    Readings without a source, time or value, and those of unknown sources, are ignored. Empty
    readings give a grid that is all ``missing``; empty sources or an empty session give no
    rows. Ties are broken by the value itself at last, so repeated rows do not matter.
    Only the named columns are read: extra columns and clashing names do no harm.

    Distribution: one shuffle by (source, chunk of ``chunk_steps`` steps). A reading goes to
    its own chunk and, if it lies within the gap limit of the border, to the neighbour's as
    well; beyond the limit it can't matter, so the split is exact, and a source with a third
    of all rows is spread over as many tasks as it has chunks.
    """
    spans = source_spans(sources, source, step, first, last)
    grid = expected_bars(spans, sized_calendar(active_runs(clock, minute, active)))
    halo = max_gap_steps + 1

    def chunk(b: Column) -> Column:
        return floor_div(b, F.col("_step") * chunk_steps)

    order = [F.col(f"_r{i}") for i in range(len(prefer))]
    seen = (
        readings.select(
            col(source).alias("_s"),
            micros(ts).alias("_t"),
            col(value).alias("_v"),
            *[col(c).alias(f"_r{i}") for i, c in enumerate(prefer)],
        )
        .where("_s is not null and _t is not null and _v is not null")
        .join(spans.select("_s", "_step"), "_s")
        .withColumn("_b", floor_div(F.col("_t"), F.col("_step") * US) * F.col("_step"))
        .withColumn("_c", F.explode(F.sequence(chunk(F.col("_b") - F.col("_step") * halo), chunk(F.col("_b") + F.col("_step") * halo))))
        .select("_s", "_step", "_b", "_c", F.struct(*order, "_t", "_v").alias("_r"))
    )
    wanted = grid.select("_s", "_step", "_b", chunk(F.col("_b")).alias("_c"), F.lit(None).cast(seen.schema["_r"].dataType).alias("_r"))
    both = seen.withColumn("_g", F.lit(0)).unionByName(wanted.withColumn("_g", F.lit(1)))
    bars = both.repartition("_s", "_c").groupBy("_s", "_c", "_b", "_step").agg(F.max("_g").alias("_g"), F.max("_r").alias("_r"))
    reading = F.struct(F.col("_r._t").alias("t"), F.col("_r._v").cast("double").alias("v"))
    bars = bars.withColumn("_o", F.when(F.col("_r").isNotNull(), reading))
    part = W.partitionBy("_s", "_c")
    before = F.last("_o", ignorenulls=True).over(part.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    after = F.last("_o", ignorenulls=True).over(part.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1))
    at = F.col("_b") * US
    near = (F.col("_q.t") - F.col("_p.t")) <= F.col("_step") * (max_gap_steps * US)
    share = (at - F.col("_p.t")).cast("double") / (F.col("_q.t") - F.col("_p.t")).cast("double")
    between = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * share
    mark = F.when(F.col("_o").isNotNull(), OBSERVED).when(near, INTERPOLATED).otherwise(MISSING)
    return (
        bars.withColumn("_p", before)
        .withColumn("_q", after)
        .where("_g = 1")
        .select(
            F.col("_s").alias(source),
            F.col("_b").alias("bar_s"),
            mark.alias("mark"),
            F.when(F.col("_o").isNotNull(), F.col("_o.v")).when(near, between).alias("value"),
        )
    )
