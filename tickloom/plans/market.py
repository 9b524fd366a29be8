"""Queries of the engine's own operators over candles, calendar and ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.time import US, big, floor_div, micros
from tickloom.operators import bars as B
from tickloom.operators import clock as C
from tickloom.operators import events as E
from tickloom.operators import features as X
from tickloom.operators import intervals as V
from tickloom.operators import ticks as K
from tickloom.operators import touch as L
from tickloom.operators.periods import merged_periods
from tickloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def bars(s: SparkSession, d: str) -> DataFrame:
    return B.clean_bars(table(s, d, "candles"), table(s, d, "feeds"))


def m1(s: SparkSession, d: str) -> DataFrame:
    """Bars of one minute: the session operators count missing open minutes, which only feeds of that step can miss one by one."""
    return bars(s, d).where("step = 60")


def pip_of(symbol: str = "symbol"):
    return F.when(F.col(symbol).endswith("JPY"), F.lit("0.01")).otherwise(F.lit("0.0001")).cast("decimal(12,8)")


def with_pip(df: DataFrame, s: SparkSession, d: str) -> DataFrame:
    return df.join(table(s, d, "feeds").select("feed_id", pip_of().alias("pip")), "feed_id")


def rounded(c, digits: int):
    """Round half up by the same floating operations in every engine."""
    k = float(10**digits)
    return (F.floor(F.col(c) * k + 0.5) / k).alias(c)


# --- bars ------------------------------------------------------------------------------------------


@query
def clean_bars(s, d):
    return bars(s, d)


@query
def candle_violations(s, d):
    return B.candle_violations(table(s, d, "candles"), table(s, d, "feeds"))


@query
def dup_quarantine(s, d):
    return B.quarantine(table(s, d, "candles"), table(s, d, "feeds")).withColumnRenamed("t_us", "ts_us")


@query
def gap_list(s, d):
    return B.gaps(bars(s, d))


@query
def gap_triage(s, d):
    return B.gap_triage(bars(s, d), table(s, d, "candles"), table(s, d, "feeds"))


@query
def month_coverage(s, d):
    return B.month_coverage(bars(s, d))


@query
def side_reconciliation(s, d):
    minute = floor_div(F.col("source_time"), big(60_000)) * 60
    q = table(s, d, "quotes").where("source_time is not null").select("feed_id", minute.alias("minute_s"))
    g = table(s, d, "quote_groups").where("ts_ms is not null").select("feed_id", (floor_div(F.col("ts_ms"), big(60_000)) * 60).alias("minute_s"))
    day = lambda x: x.withColumn("day_s", floor_div(F.col("minute_s"), big(86_400)) * 86_400)
    return B.reconcile(day(q), day(g), ["feed_id", "day_s", "minute_s"], "day_s")


# --- calendar --------------------------------------------------------------------------------------


@query
def session_coordinates(s, d):
    return C.coordinates(table(s, d, "session_clock"))


@query
def weekly_clock(s, d):
    """The weekly rule against the table: minutes on which they differ are holidays."""
    t = table(s, d, "session_clock")
    have = t.select(floor_div(micros("minute_ts"), big(US)).alias("m"), "active")
    # The rule is applied to the table's own minutes, so that its span needs no driver round trip.
    rule = t.select(floor_div(micros("minute_ts"), big(US)).alias("m"), C.weekly_rule(F.from_utc_timestamp("minute_ts", C.NEW_YORK)).alias("by_rule"))
    return have.join(rule, "m").groupBy("active", "by_rule").agg(F.count("*").alias("minutes"))


@query
def open_elapsed(s, d):
    t = table(s, d, "trades").where("entry_time is not null and end_time is not null")
    sec = lambda c: floor_div(micros(c), big(60 * US)) * 60
    rows = t.select("trade_id", sec("entry_time").alias("a"), sec("end_time").alias("z"))
    return C.elapsed(rows, C.coordinates(table(s, d, "session_clock")), "a", "z").select("trade_id", "open_min")


@query
def session_deadline(s, d):
    t = table(s, d, "trades").where("entry_time is not null")
    rows = t.select("trade_id", (floor_div(micros("entry_time"), big(60 * US)) * 60).alias("a"))
    return C.deadlines(rows, C.coordinates(table(s, d, "session_clock")), "a", 4320).select("trade_id", "deadline_s")


@query
def missing_open_minutes(s, d):
    return C.gap_breaks(m1(s, d), C.coordinates(table(s, d, "session_clock"))).select("feed_id", "b", "missing", "broke")


@query
def censor_times(s, d):
    c = C.coordinates(table(s, d, "session_clock"))
    return C.censor_times(C.gap_breaks(m1(s, d), c), c).select("feed_id", "b", "censor_s")


@query
def clock_ms(s, d):
    rows = table(s, d, "economic_matrix").select("row_id", "decision_ms")
    return C.coordinate_ms(rows, table(s, d, "session_clock"), "decision_ms").select("row_id", "open_ms", "is_open", "next_open_ms")


@query
def clock_advance(s, d):
    rows = table(s, d, "economic_matrix").select("row_id", "decision_ms").where("decision_ms is not null")
    return C.advance_ms(rows, table(s, d, "session_clock"), "decision_ms", 259_200_000).select("row_id", "deadline_ms")


@query
def open_intervals(s, d):
    return C.intervals_ms(table(s, d, "session_clock"))


@query
def rollovers(s, d):
    return C.rollovers(s, "2025-01-05", "2025-08-03")


@query
def month_windows(s, d):
    f = table(s, d, "feeds").select("feed_id", floor_div(micros("first_ts"), big(US)).alias("a"), floor_div(micros("last_ts"), big(US)).alias("z"))
    return C.month_windows(f, "a", "z")


# --- features --------------------------------------------------------------------------------------


@query
def features_past(s, d):
    f = X.past_features(bars(s, d))
    digits = {c: 2 if c.startswith("z_") else 6 for c in f.columns if c not in ("feed_id", "b", "direction", "valid")}
    return f.select("feed_id", "b", *[rounded(c, n) for c, n in digits.items()], "valid")


@query
def features_oriented(s, d):
    """Means of all 28 features of both sides."""
    f = X.oriented(X.past_features(bars(s, d)).where("valid"))
    names = [c for c in f.columns if c not in ("feed_id", "b", "valid", "side")]
    return f.groupBy("feed_id", "side").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).select("feed_id", "side", "n", *[rounded(c, 2 if c.startswith("z_") else 6) for c in names])


@query
def fractional_difference(s, d):
    return X.fractional_difference(bars(s, d)).select("feed_id", "b", rounded("frac", 6), "valid")


@query
def momentum_side(s, d):
    return X.momentum_side(bars(s, d))


def _segmented(s, d):
    return C.segments(C.gap_breaks(m1(s, d), C.coordinates(table(s, d, "session_clock"))))


@query
def ew_volatility(s, d):
    v = X.ew_volatility(_segmented(s, d))
    return v.select("feed_id", "b", rounded("sigma", 7), "returns", "reason", "valid")


@query
def ew_volatility_hour(s, d):
    """The same of returns over an hour with a short memory, which has values even where feeds have many gaps."""
    v = X.ew_volatility(_segmented(s, d), lag=60, window=120, span=40, minimum=30)
    return v.select("feed_id", "b", rounded("sigma", 7), "returns", "reason", "valid")


@query
def cusum_events(s, d):
    return E.cusum_events(bars(s, d), 0.002).where("event or entry")


@query
def session_cusum(s, d):
    return E.cusum_events(_segmented(s, d), 0.002, broke="broke").where("event or entry")


# --- labels ----------------------------------------------------------------------------------------


def labels(s, d):
    b = with_pip(bars(s, d), s, d)
    return L.contiguous_labels(b, tp=F.col("pip") * 50, sl=F.col("pip") * 20)


@query
def first_touch_labels(s, d):
    return L.pips(with_pip(labels(s, d), s, d), F.col("pip")).select("feed_id", "b", "side", "outcome", "end_s", "exit_i", "pnl_pips")


@query
def hard_negatives(s, d):
    return labels(s, d).where("outcome = 'stop_loss'").select("feed_id", "b", "side", "post_status", "post_s")


@query
def label_audit(s, d):
    month = F.date_format(F.timestamp_seconds("b"), "yyyy-MM").alias("month")
    kinds = ("take_profit", "stop_loss", "timeout", "ambiguous", "boundary", "censored")
    out = labels(s, d).groupBy("feed_id", month).agg(F.count("*").alias("candidates"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    return out.withColumn("retained", F.col("take_profit") + F.col("stop_loss") + F.col("timeout"))


def _session_rows(s, d, horizon: int = 4320):
    c = C.coordinates(table(s, d, "session_clock"))
    b = C.deadlines(C.censor_times(C.gap_breaks(m1(s, d), c), c), c, "b", horizon)
    last = b.groupBy("feed_id").agg(F.max("b").alias("last_s"))
    return with_pip(b.join(last, "feed_id"), s, d)


@query
def session_labels(s, d):
    rows = _session_rows(s, d)
    out = L.session_labels(rows, tp=F.col("pip") * 50, sl=F.col("pip") * 20, longest_s=10 * 86_400)
    return out.select("feed_id", "b", "side", "outcome", "end_s", "info_s", "exit_i")


@query
def volatility_labels(s, d):
    """Barriers of 2.5 and 1 times the price volatility known at the entry; others are causally ineligible."""
    return _by_volatility(s, d, X.ew_volatility(_segmented(s, d)))


@query
def volatility_labels_hour(s, d):
    """The same with the volatility of ``ew_volatility_hour``."""
    return _by_volatility(s, d, X.ew_volatility(_segmented(s, d), lag=60, window=120, span=40, minimum=30))


def _by_volatility(s, d, vol):
    vol = vol.select("feed_id", "b", "price_volatility", "valid")
    rows = _session_rows(s, d).join(vol, ["feed_id", "b"])
    pv = F.col("price_volatility").cast("string").cast("decimal(38,20)")
    tp, sl = (pv * F.lit("2.5").cast("decimal(2,1)")).cast("decimal(18,8)"), pv.cast("decimal(18,8)")
    ok = F.col("valid") & (F.col("open") > tp) & (sl > 0)
    out = L.session_labels(rows, tp=tp, sl=sl, longest_s=10 * 86_400, eligible=ok)
    return out.groupBy("feed_id", "side", "outcome").agg(F.count("*").alias("n"))


# --- ticks -----------------------------------------------------------------------------------------


def quotes(s, d):
    return table(s, d, "quotes").where("feed_id is not null and seq is not null")


@query
def late_flags(s, d):
    return K.highwater(quotes(s, d)).select("quote_id", "available_ms", "late")


@query
def tick_audit(s, d):
    return K.tick_audit(quotes(s, d))


@query
def tick_days(s, d):
    return K.day_counts(quotes(s, d))


@query
def tie_groups(s, d):
    return K.tie_groups(quotes(s, d))


@query
def tick_bars(s, d):
    return K.tick_bars(quotes(s, d))


@query
def silences(s, d):
    return K.silences(quotes(s, d))


@query
def integrity_union(s, d):
    out = merged_periods(K.defect_spans(quotes(s, d)), entity="feed_id", start="a", end="z", slot=86_400_000)
    return out.where("kind = 'period'").select("feed_id", F.col("from_s").alias("a"), F.col("to_s").alias("z"))


@query
def integrity_hits(s, d):
    """Decisions whose span of inputs meets a defect of their feed."""
    spans = integrity_union(s, d)
    rows = table(s, d, "economic_matrix").where("earliest_input_ms < information_cap_ms and feed_id is not null").select("row_id", "feed_id", "earliest_input_ms", "information_cap_ms")
    return V.overlapping(rows, spans, "feed_id", "earliest_input_ms", "information_cap_ms", 86_400_000).select("row_id", "hit")


@query
def asof_forward(s, d):
    left = table(s, d, "economic_matrix").where("decision_ms is not null and feed_id is not null").select("row_id", "feed_id", "decision_ms")
    right = quotes(s, d).where("is_valid and source_time is not null").select("feed_id", "source_time", F.col("source_time").alias("quote_ms"))
    return V.asof_forward(left, right, "feed_id", "decision_ms", "source_time", ["quote_ms"], 3_600_000).select("row_id", "quote_ms")


@query
def asof_backward(s, d):
    left = table(s, d, "economic_matrix").where("decision_ms is not null and feed_id is not null").select("row_id", "feed_id", "decision_ms")
    right = quotes(s, d).where("is_valid and source_time is not null").select("feed_id", "source_time", F.col("source_time").alias("quote_ms"))
    return V.asof_backward(left, right, "feed_id", "decision_ms", "source_time", ["quote_ms"], 3_600_000, strict=True).select("row_id", "quote_ms")


@query
def range_marks(s, d):
    q = quotes(s, d).where("is_valid and source_time is not null and bid is not null")
    return V.ordered_marks(q, "feed_id", ["source_time", "seq", "quote_id"], F.col("bid"), floor_div(F.col("source_time"), big(86_400_000)))


@query
def event_order(s, d):
    q = quotes(s, d).where("source_time is not null").withColumn("ordinal", F.col("quote_id"))
    m = table(s, d, "economic_matrix").where("feed_id is not null and decision_ms is not null").withColumn("ordinal", F.col("row_id"))
    out = K.merged_order([(q, "source", 4, F.col("source_time")), (m, "decision", 3, F.col("decision_ms"))])
    return out.select("feed_id", "ordinal", "kind", "place")
