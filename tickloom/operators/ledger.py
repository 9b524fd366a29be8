"""Exact cash flows, funding by interval, equity marks, drawdown and period reports.

Money stays DECIMAL; the one division (funding per 365 days) is done on the summed numerator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, big, floor_div
from tickloom.operators.clock import month_windows
from tickloom.operators.intervals import ordered_marks

MONEY = "decimal(28,8)"


def interval_sum(rows: DataFrame, points: DataFrame, start: str, end: str, at: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over points with ``start < at <= end``: a difference of two running sums.

    ``points`` is a calendar, a row a day or so. It becomes one row for each UTC day of its span: the
    sum before the day, and the day's own few points. Rows are joined to it by equality of the
    day (a day outside the span counts as the nearest one inside), so nothing but the calendar
    is ordered, and Catalyst sends it to the rows if its size allows.
    """
    p = points.where(F.col(at).isNotNull()).select(floor_div(F.col(at), big(DAY_S)).alias("_day"), F.col(at).cast("bigint").alias("at"), F.col(value).alias("v"))
    per = p.groupBy("_day").agg(F.sum("v").alias("_sum"), F.collect_list(F.struct("at", "v")).alias("_own"))
    span = p.agg(F.min("_day").alias("a"), F.max("_day").alias("z"))
    days = span.where("a is not null").select(F.explode(F.sequence("a", "z")).alias("_day")).join(per, "_day", "left")
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_day", before.alias("_before"), F.coalesce("_own", F.array().cast(per.schema["_own"].dataType)).alias("_own"))
    first, last = (span.select(c).scalar() for c in "az")
    x = rows
    for c, name in ((start, "_s0"), (end, "_s1")):
        day = F.greatest(first, F.least(last, floor_div(F.col(c), big(DAY_S))))
        x = x.withColumn("_day", F.when(F.col(c).isNotNull(), day)).join(days, "_day", "left")
        own = F.aggregate(F.filter("_own", lambda q: q["at"] <= F.col(c)), F.lit(0).cast(days.schema["_before"].dataType), lambda acc, q: (acc + q["v"]).cast(days.schema["_before"].dataType))
        x = x.withColumn(name, F.col("_before") + own).drop("_day", "_before", "_own")
    return x.withColumn(out, F.coalesce("_s1", F.lit(0)) - F.coalesce("_s0", F.lit(0))).drop("_s0", "_s1")


def scenarios(rows: DataFrame, bundles: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Each row once a scenario, with its ``commission`` per fill, ``slip`` and ``rate``: an array literal, no join."""
    lit = F.array(
        *[
            F.struct(F.lit(k).alias("name"), *[F.lit(v).cast("decimal(18,8)").alias(n) for n, v in zip(("commission", "slip", "rate"), vs)])
            for k, vs in bundles.items()
        ]
    )
    x = rows.withColumn("_b", F.explode(lit))
    return x.select(*rows.columns, F.col("_b.name").alias("scenario"), *[F.col(f"_b.{n}").alias(n) for n in ("commission", "slip", "rate")])


def cashflows(trades: DataFrame, gross: Column, units: int) -> DataFrame:
    """Signed flows of closed trades: ``(scenario, book_id, trade_id, at_s, kind, amount, nights_value)``.

    ``trades`` carry ``a`` and ``z`` (entry and end), ``nights`` (factors of funding) and a scenario's
    costs. Funding keeps its numerator ``units * entry * rate * nights``, to be divided by 365 at last.
    """
    m = lambda c: c.cast(MONEY)
    u = F.lit(units).cast("decimal(10,0)")
    pieces = F.array(
        F.struct(F.lit("entry_commission").alias("kind"), F.col("a").alias("at_s"), m(-F.col("commission")).alias("amount"), F.lit(0).cast(MONEY).alias("numerator")),
        F.struct(F.lit("realized").alias("kind"), F.col("z").alias("at_s"), m(gross - 2 * F.col("slip") * u).alias("amount"), F.lit(0).cast(MONEY).alias("numerator")),
        F.struct(F.lit("exit_commission").alias("kind"), F.col("z").alias("at_s"), m(-F.col("commission")).alias("amount"), F.lit(0).cast(MONEY).alias("numerator")),
        F.struct(F.lit("funding").alias("kind"), F.col("z").alias("at_s"), F.lit(0).cast(MONEY).alias("amount"), m(u * F.col("rate") * F.col("entry_price").cast("decimal(18,8)") * F.col("nights")).alias("numerator")),
    )
    x = trades.select("scenario", "book_id", "trade_id", F.explode(pieces).alias("_p"))
    return x.select("scenario", "book_id", "trade_id", *[F.col(f"_p.{c}").alias(c) for c in ("at_s", "kind", "amount", "numerator")])


def period_report(flows: DataFrame) -> DataFrame:
    """Per scenario, book and month: flows by kind, exact; funding divided once, at the end."""
    month = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM").alias("month")
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0).cast(MONEY)).alias(k)
    g = flows.groupBy("scenario", "book_id", month).agg(part("realized"), part("entry_commission"), part("exit_commission"), F.sum("numerator").alias("numerator"))
    funding = (F.col("numerator").cast("double") / 365).alias("funding")
    return g.select("scenario", "book_id", "month", "realized", (F.col("entry_commission") + F.col("exit_commission")).alias("commission"), funding)


def equity_marks(flows: DataFrame, capital: int) -> DataFrame:
    """Per scenario and book: lowest, highest, deepest drawdown of the balance after each flow.

    Balances are prefix sums by two levels: within a day, and of the days before.
    """
    key = F.concat_ws("/", "scenario", "book_id").alias("account")
    x = flows.select(key, "trade_id", "kind", "at_s", "amount", floor_div(F.col("at_s"), big(DAY_S)).alias("day"))
    days = x.groupBy("account", "day").agg(F.sum("amount").alias("_d"))
    before = W.partitionBy("account").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("account", "day", F.coalesce(F.sum("_d").over(before), F.lit(0).cast(MONEY)).alias("_base"))
    w = W.partitionBy("account", "day").orderBy("at_s", "trade_id", "kind").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum("amount").over(w)).join(days, ["account", "day"])
    x = x.withColumn("balance", (F.lit(capital) + F.col("_base") + F.col("_in")).cast(MONEY))
    marks = ordered_marks(x, "account", ["at_s", "trade_id", "kind"], F.col("balance"), F.col("day"))
    return marks.select("account", "low", "high", F.greatest("max_drop", F.lit(capital).cast(MONEY) - F.col("low")).alias("drawdown"), (F.col("low") < 0).alias("breach"))


def exposure(trades: DataFrame) -> DataFrame:
    """Seconds held per book and month: intervals clipped to each month they touch."""
    m = month_windows(trades.select("book_id", "trade_id", "a", "z"), "a", "z")
    held = F.least("z", "month_to") - F.greatest("a", "month_from")
    return m.groupBy("book_id", F.col("month_from").alias("month_s")).agg(F.sum(held).alias("held_s"), F.count("*").alias("trades"))
