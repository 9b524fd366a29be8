"""Queries of composed data sets, their audits, and lookups around defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.time import US, big, floor_div, micros
from tickloom.operators import clock as C
from tickloom.operators import datasets as D
from tickloom.operators import events as E
from tickloom.operators import features as X
from tickloom.operators import folds as P
from tickloom.operators import intervals as V
from tickloom.operators import ledger as A
from tickloom.operators import models as M
from tickloom.operators import stats as S
from tickloom.operators import ticks as K
from tickloom.operators import touch as L
from tickloom.plans import account, market, research
from tickloom.plans.market import Query, bars, m1, quotes, rounded
from tickloom.session import table

QUERIES: dict[str, Query] = {}
DAY_MS = 86_400_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def decisions(s, d):
    return table(s, d, "economic_matrix").where("feed_id is not null and decision_ms is not null")


def month_of(ms: str):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


# --- both sides of the market ----------------------------------------------------------------------


@query
def tick_bars_ask(s, d):
    return K.tick_bars(quotes(s, d), price="ask")


@query
def side_prices(s, d):
    """Bid and ask bars of one minute side by side, per feed and day: minutes on which a price of the ask is below the bid's."""
    pair = ["open", "high", "low", "close"]
    bid = K.tick_bars(quotes(s, d)).where("n > 0").select("feed_id", "bar_ms", *[F.col(c).alias(f"bid_{c}") for c in pair])
    ask = K.tick_bars(quotes(s, d), price="ask").where("n > 0").select("feed_id", "bar_ms", *[F.col(c).alias(f"ask_{c}") for c in pair])
    j = bid.join(ask, ["feed_id", "bar_ms"], "full")
    crossed = F.lit(False)
    for c in pair:
        crossed = crossed | (F.col(f"ask_{c}") < F.col(f"bid_{c}"))
    day = (floor_div(F.col("bar_ms"), big(DAY_MS)) * 86_400).alias("day_s")
    g = j.groupBy("feed_id", day).agg(F.count("*").alias("minutes"), F.count_if(F.coalesce(crossed, F.lit(True))).alias("crossed"), F.max(F.col("ask_close") - F.col("bid_close")).alias("widest_close"))
    return g.withColumn("accepted", F.col("crossed") == 0)


# --- calendar --------------------------------------------------------------------------------------


@query
def quarter_windows(s, d):
    f = table(s, d, "feeds").select("feed_id", floor_div(micros("first_ts"), big(US)).alias("a"), floor_div(micros("last_ts"), big(US)).alias("z"))
    return C.period_windows(f, "a", "z", "quarter")


@query
def week_windows(s, d):
    f = table(s, d, "feeds").select("feed_id", floor_div(micros("first_ts"), big(US)).alias("a"), floor_div(micros("last_ts"), big(US)).alias("z"))
    return C.period_windows(f, "a", "z", "week")


@query
def calendar_denominators(s, d):
    """Per feed: decisions, those inside the session, and those whose flag says otherwise than the calendar."""
    j = C.coordinate_ms(decisions(s, d).select("row_id", "feed_id", "decision_ms", "calendar_eligible"), table(s, d, "session_clock"), "decision_ms")
    flag = F.coalesce("calendar_eligible", F.lit(False))
    return j.groupBy("feed_id").agg(
        F.count("*").alias("decisions"), F.count_if("is_open").alias("inside"), F.count_if(flag & ~F.col("is_open")).alias("flagged_outside"), F.count_if(~flag & F.col("is_open")).alias("unflagged_inside")
    )


# --- events ----------------------------------------------------------------------------------------


@query
def silences_open(s, d):
    """Silences of 60 open seconds: closures do not count; from 15 open minutes on the history starts anew."""
    q, clock = quotes(s, d), table(s, d, "session_clock")
    x = K.silences(q, 60_000).drop("silent_at_ms")
    for c, name in (("last_ms", "_c0"), ("back_ms", "_c1")):
        x = C.coordinate_ms(x, clock, c).withColumnRenamed("open_ms", name).drop("is_open", "next_open_ms")
    x = C.advance_ms(x.where(F.col("_c1") - F.col("_c0") > 60_000), clock, "last_ms", 60_000, "silent_at_ms")
    quiet = F.col("_c1") - F.col("_c0")
    return x.select("feed_id", "last_ms", "back_ms", "silent_at_ms", quiet.alias("open_ms"), (quiet >= 900_000).alias("resets"))


@query
def causal_events(s, d):
    """Five kinds of events of each feed in one order: funding, timers, decisions, quotes and the feed's end."""
    q = quotes(s, d).where("source_time is not null").withColumn("ordinal", F.col("quote_id"))
    m = decisions(s, d).withColumn("ordinal", F.col("row_id"))
    f = table(s, d, "feeds").select("feed_id", floor_div(micros("first_ts"), big(1000)).alias("a_ms"), floor_div(micros("last_ts"), big(1000)).alias("z_ms"))
    days = f.withColumn("day", F.explode(F.sequence(floor_div(F.col("a_ms"), big(DAY_MS)), floor_div(F.col("z_ms"), big(DAY_MS)))))
    nights = C.rollovers(s, "2025-01-01", "2026-01-01").select((F.col("at_s") * 1000).alias("at_ms"), floor_div(F.col("at_s"), big(86_400)).alias("day"))
    funding = days.join(nights, "day").where("at_ms >= a_ms and at_ms < z_ms").withColumn("ordinal", F.col("day"))
    timers = K.silences(quotes(s, d)).groupBy("feed_id", "silent_at_ms").agg(F.max("last_ms").alias("ordinal"))
    out = K.merged_order(
        [
            (funding, "funding", 1, F.col("at_ms")), (timers, "timer", 2, F.col("silent_at_ms")), (m, "decision", 3, F.col("decision_ms")),
            (q, "source", 4, F.col("source_time")), (f.withColumn("ordinal", big(0)), "end", 5, F.col("z_ms")),
        ]
    )
    return out.select("feed_id", "time", "kind", "ordinal", "place")


@query
def asof_expiring(s, d):
    """The first valid quote within 30 seconds from each decision, or none."""
    right = quotes(s, d).where("is_valid and source_time is not null").select("feed_id", "source_time", F.col("source_time").alias("quote_ms"))
    j = V.asof_forward(decisions(s, d).select("row_id", "feed_id", "decision_ms"), right, "feed_id", "decision_ms", "source_time", ["quote_ms"], 3_600_000)
    return j.select("row_id", F.when(F.col("quote_ms") < F.col("decision_ms") + 30_000, F.col("quote_ms")).alias("quote_ms"))


def hazards(s, d):
    return quotes(s, d).where("source_time is not null and not coalesce(is_valid and not coalesce(ambiguous, false), false)").select("feed_id", "source_time", F.col("source_time").alias("hazard_ms"))


@query
def next_hazard(s, d):
    return V.asof_forward(decisions(s, d).select("row_id", "feed_id", "decision_ms"), hazards(s, d), "feed_id", "decision_ms", "source_time", ["hazard_ms"], 3_600_000, strict=True).select("row_id", "hazard_ms")


@query
def hazard_return(s, d):
    """Each instant of a hazard with the first valid quote strictly after it."""
    left = hazards(s, d).select("feed_id", "hazard_ms").distinct()
    right = quotes(s, d).where("is_valid and not coalesce(ambiguous, false) and source_time is not null").select("feed_id", "source_time", F.col("source_time").alias("return_ms"))
    return V.asof_forward(left, right, "feed_id", "hazard_ms", "source_time", ["return_ms"], 3_600_000, strict=True).select("feed_id", "hazard_ms", "return_ms")


def _units(c: str):
    return (F.col(c).cast("decimal(28,8)") * 100_000_000).cast("bigint")


@query
def range_summaries(s, d):
    q = quotes(s, d).where("is_valid")
    return D.range_summaries(decisions(s, d), q, "feed_id", "row_id", "decision_ms", 900_000, "source_time", "seq", "quote_id", _units("bid"))


@query
def first_crossing(s, d):
    """The first valid quote within an hour of each decision whose bid is 5 pips above the last one at the decision."""
    q = quotes(s, d).where("is_valid")
    have = q.where("source_time is not null and bid is not null").select("feed_id", "source_time", _units("bid").alias("bid_i"))
    at = V.asof_backward(decisions(s, d).select("row_id", "feed_id", "decision_ms"), have, "feed_id", "decision_ms", "source_time", ["bid_i"], 3_600_000)
    at = market.with_pip(at, s, d).withColumn("level", F.col("bid_i") + (F.col("pip") * 500_000_000).cast("bigint"))
    return D.first_at_or_above(at, q, "feed_id", "row_id", "decision_ms", "level", 3_600_000, "source_time", "quote_id", _units("bid"))


@query
def earliest_affected(s, d):
    """Each defect of a feed with the first decision whose inputs meet it."""
    rows = decisions(s, d).select("row_id", "feed_id", "earliest_input_ms", "information_cap_ms")
    return D.earliest_affected(market.integrity_union(s, d), rows, "feed_id", "earliest_input_ms", "information_cap_ms", "row_id", DAY_MS)


# --- data sets -------------------------------------------------------------------------------------


@query
def cusum_candidates(s, d):
    b = bars(s, d)
    out = D.candidates(market.labels(s, d), X.past_features(b), {"fine": E.cusum_events(b, 0.002), "coarse": E.cusum_events(b, 0.005)})
    out = out.withColumn("common", F.col("fine") & F.col("coarse"))
    return out.select("feed_id", "b", "side", "outcome", "valid", "fine", "coarse", "common")


@query
def population_support(s, d):
    """Labels of each population of events (all, fine, coarse, both) that have valid features, by side and outcome."""
    c = cusum_candidates(s, d).where("valid").withColumn("all", F.lit(True))
    kinds = F.array(*[F.when(F.col(k), F.lit(k)) for k in ("all", "fine", "coarse", "common")])
    return c.withColumn("population", F.explode(F.array_compact(kinds))).groupBy("population", "side", "outcome").agg(F.count("*").alias("n"))


@query
def session_stale(s, d):
    """Labels in session time that touch nothing, with the open minutes between the last bar seen and their end."""
    coords = C.coordinates(table(s, d, "session_clock"))
    inside = C.gap_breaks(m1(s, d), coords).select("feed_id", "b")
    lab = market.session_labels(s, d).where("outcome in ('timeout', 'censored')").select("feed_id", "b", "side", "end_s")
    return D.stale_minutes(lab, inside, coords)


@query
def fold_guard(s, d):
    x = P.partitioned(research.labeled(s, d).select("label_id", "starts", "info_ends"), research.FOLDS, "starts", "info_ends")
    return D.overlap_guard(x.withColumn("part", F.split("partition", "_")[0]), ["fold", "part"], "starts", "info_ends")


@query
def fold_months(s, d):
    """Support by fold, partition and month."""
    x = P.partitioned(research.labeled(s, d).select("label_id", "starts", "info_ends", "y"), research.FOLDS, "starts", "info_ends")
    return P.class_support(x.withColumn("month", F.date_format(F.timestamp_seconds("starts"), "yyyy-MM")), ["fold", "partition", "month"]).drop("reason")


@query
def fold_regimes(s, d):
    """Fold, partition, side and band of the label's length, with all their totals."""
    rows = research.labeled(s, d).where("side in (-1, 1)").select("label_id", "side", "starts", "info_ends", "y", (F.col("info_ends") - F.col("starts")).alias("length"))
    x = S.banded(rows, S.tertiles(rows, ["side"], "length"), ["side"], "length")
    x = P.partitioned(x, research.FOLDS, "starts", "info_ends")
    g = x.groupingSets([["fold", "partition", "side", "band"], ["fold", "partition", "band"], ["fold", "partition"]], "fold", "partition", "side", "band")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("positives"), F.grouping_id().cast("int").alias("level"))


@query
def observed_boundary_long(s, d):
    return P.observed_boundary(bars(s, d), 1_745_000_000, 1941)


@query
def horizon_mask(s, d):
    """Labels that would be known within four hours of their start."""
    x = research.labeled(s, d)
    return x.groupBy("side").agg(F.count("*").alias("rows"), F.count_if(F.col("info_ends") - F.col("starts") <= 14_400).alias("within"))


@query
def warm_start(s, d):
    """Momentum sides of bars from a boundary on, computed from the last 62 bars before it and no others."""
    b = bars(s, d)
    history = X.export_history(b.where("b < 1745000000"), 62)
    return X.from_history(history, b.where("b >= 1745000000"), X.momentum_side)


@query
def common_support(s, d):
    """Bars on which differences of the orders 1/4, 1/2 and 3/4 are all known, by feed and month, against each alone."""
    keys, x = ["feed_id", "b"], None
    for name, k in (("quarter", 0.25), ("half", 0.5), ("three_quarters", 0.75)):
        one = X.fractional_difference(bars(s, d), k, 1e-3).select(*keys, F.col("valid").alias(name))
        x = one if x is None else x.join(one, keys)
    names = ["quarter", "half", "three_quarters"]
    month = F.date_format(F.timestamp_seconds("b"), "yyyy-MM").alias("month")
    return x.groupBy("feed_id", month).agg(F.count("*").alias("bars"), *[F.count_if(n).alias(n) for n in names], F.count_if(F.col("quarter") & F.col("half") & F.col("three_quarters")).alias("common"))


@query
def paired_rows(s, d):
    return D.paired(decisions(s, d), ["feed_id", "decision_ms"], "side", "row_id")


@query
def month_offsets(s, d):
    return D.month_offsets(decisions(s, d), "feed_id", month_of("decision_ms"), "row_id")


@query
def control_alignment(s, d):
    """Delivered labels against those recomputed from the trades they name."""
    saved = table(s, d, "label_dataset").where("trade_id is not null").select("trade_id", F.col("y").cast("int").alias("y"), F.col("starts"))
    saved = saved.groupBy("trade_id").agg(F.max("y").alias("y"), F.max("starts").alias("starts"))
    t = table(s, d, "trades")
    again = t.select("trade_id", F.when(F.col("outcome") == "take_profit", 1).when(F.col("outcome").isin("stop_loss", "timeout"), 0).alias("y"), floor_div(micros("entry_time"), big(US)).alias("starts"))
    return D.aligned(saved, again, ["trade_id"], ["y", "starts"])


@query
def uniqueness_ms(s, d):
    m = decisions(s, d).where("information_end_ms > decision_ms").select("row_id", "feed_id", F.col("decision_ms").alias("a"), F.col("information_end_ms").alias("z"))
    return V.uniqueness(m, "row_id", "feed_id", "a", "z", 7 * DAY_MS).select("row_id", rounded("raw", 8), rounded("weight", 6))


@query
def concurrency_diagnostics(s, d):
    x = research.spans(s, d)
    u = V.uniqueness(x, "trade_id", "book_id", "a", "z").groupBy("book_id").agg(F.count("*").alias("n"), F.avg("raw").alias("raw_mean"), F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"))
    j = u.join(V.concurrency(x, "book_id", "a", "z"), "book_id")
    return j.select("book_id", "n", "most", *[rounded(c, 6) for c in ("raw_mean", "raw_min", "raw_max", "active_mean")])


@query
def portfolio_report(s, d):
    """Per scenario one JSON text of allowed fields, read back into columns."""
    f = account.flows(s, d)
    g = f.groupBy("scenario").agg(F.count_distinct("book_id").alias("books"), F.count_distinct("trade_id").alias("trades"), F.sum("amount").cast("decimal(28,8)").alias("net"))
    text = g.select("scenario", F.to_json(F.struct("books", "trades", "net", F.lit("internal").alias("note"))).alias("j"))
    back = F.from_json("j", "books bigint, trades bigint, net decimal(28,8)")
    return text.select("scenario", back.alias("r")).select("scenario", "r.books", "r.trades", F.col("r.net").cast("double").alias("net"))


@query
def seed_ensemble(s, d):
    """Networks of three seeds per month, epochs chosen by the loss on the month's last fifth, and the loss of their mean."""
    return M.fit_ensembles(account.matrix(s, d), "month", "row_id", account.COLUMNS, "y", "w", seeds=[1, 2, 3])
