"""Queries of the composite operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.time import US, big, floor_div, micros
from tickloom.operators import clock as C
from tickloom.operators import composites as O
from tickloom.operators import features as X
from tickloom.operators import intervals as V
from tickloom.operators import models as M
from tickloom.operators import stats as S
from tickloom.plans import account, market, research
from tickloom.plans.market import Query, bars, quotes, rounded
from tickloom.session import table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def session_features(s, d):
    return O.unbroken(market._segmented(s, d))


@query
def decision_bars(s, d):
    """The last bar that has closed by each decision, by an as-of lookup of closing times."""
    m = table(s, d, "economic_matrix").where("feed_id is not null and decision_ms is not null").select("row_id", "feed_id", "decision_ms")
    b = bars(s, d).select("feed_id", ((F.col("b") + F.col("step")) * 1000).alias("closed_ms"), F.col("b").alias("bar_s"), "close")
    return V.asof_backward(m, b, "feed_id", "decision_ms", "closed_ms", ["bar_s", "close"], 86_400_000).select("row_id", "bar_s", "close")


@query
def uniqueness_open(s, d):
    """Uniqueness in open minutes: closures neither lengthen nor share an interval."""
    c = C.coordinates(table(s, d, "session_clock"))
    t = research.spans(s, d).select("trade_id", "book_id", (floor_div(F.col("a"), big(60)) * 60).alias("a"), (floor_div(F.col("z"), big(60)) * 60).alias("z"))
    x = C.with_coordinate(C.with_coordinate(t, c, "a", "ca"), c, "z", "cz").where("ca < cz")
    return V.uniqueness(x, "trade_id", "book_id", "ca", "cz", 7 * 1440).select("trade_id", rounded("raw", 8))


@query
def one_sided_projection(s, d):
    sides = X.momentum_side(bars(s, d))
    return O.one_sided(sides, market.labels(s, d), ["feed_id", "b"], "side", "outcome")


@query
def candidate_summary(s, d):
    x = market.labels(s, d)
    g = x.groupingSets([["side", "outcome"], ["outcome"], ["side"], []], "side", "outcome").agg(
        F.count("*").alias("n"), F.sum(F.col("end_s") - F.col("b")).alias("seconds"), F.grouping_id().cast("int").alias("level")
    )
    return g.select("side", "outcome", "level", "n", "seconds")


@query
def censor_diagnostics(s, d):
    """Past volatility of entries whose label is conclusive and of those that were censored, by quarter."""
    conclusive = F.col("outcome").isin("take_profit", "stop_loss", "timeout")
    lab = market.labels(s, d).select("feed_id", "b", conclusive.alias("conclusive"))
    f = X.past_features(bars(s, d)).where("valid").select("feed_id", "b", "vol_60", "eff_60")
    t = F.timestamp_seconds("b")
    j = lab.join(f, ["feed_id", "b"]).withColumn("quarter", F.concat_ws("-Q", F.year(t), F.quarter(t)))
    return j.groupBy("quarter", "conclusive").agg(F.count("*").alias("n"), F.avg("vol_60").alias("vol_60"), F.avg("eff_60").alias("eff_60")).select(
        "quarter", "conclusive", "n", rounded("vol_60", 8), rounded("eff_60", 6)
    )


@query
def coverage(s, d):
    m = table(s, d, "economic_matrix")
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(c)
    g = m.groupBy("feed_id").agg(F.count("*").alias("rows"), *[share(c) for c in ("feature_valid", "volatility_valid", "calendar_eligible", "eligible")])
    return g.select("feed_id", "rows", *[rounded(c, 8) for c in ("feature_valid", "volatility_valid", "calendar_eligible", "eligible")])


@query
def range_count(s, d):
    m = table(s, d, "economic_matrix").where("feed_id is not null and decision_ms is not null").select("row_id", "feed_id", "decision_ms", (F.col("decision_ms") + 900_000).alias("until_ms"))
    q = quotes(s, d).where("is_valid and source_time is not null").select("feed_id", "source_time")
    return O.range_count(m, q, "feed_id", "decision_ms", "until_ms", "source_time", 3_600_000).select("row_id", "n")


@query
def zone_map(s, d):
    q = quotes(s, d).where("is_valid and bid is not null")
    return O.zone_map(q, "feed_id", "seq", "quote_id", F.col("bid"))


@query
def widest_spreads(s, d):
    q = quotes(s, d).where("is_valid")
    return O.top_k(q.select("feed_id", "quote_id", "bid", "ask"), "feed_id", F.col("ask") - F.col("bid"), "quote_id", 5).select("feed_id", "quote_id", "score", F.col("place").cast("int").alias("place"))


@query
def hashed_sample(s, d):
    return O.hashed_sample(table(s, d, "trades").select("trade_id"), "trade_id", 500)


@query
def model_contrasts(s, d):
    y = F.col("y").cast("double")
    losses = {"first": S.clipped_loss(y, F.col("p")), "second": S.clipped_loss(y, F.col("q")), "even": S.clipped_loss(y, F.lit(0.5))}
    return O.contrasts(research.scored(s, d), ["side"], losses).select("side", "left", "right", rounded("delta", 7))


@query
def member_diversity(s, d):
    return research.scored(s, d).groupBy("side").agg(F.corr("p", "q").alias("r")).select("side", rounded("r", 8))


@query
def sequence_faults(s, d):
    g = table(s, d, "quote_groups").where("feed_id is not null and first_seq is not null and last_seq is not null")
    return O.sequence_faults(quotes(s, d).select("feed_id", "seq"), g, "feed_id", "seq", "first_seq", "last_seq")


@query
def single_features(s, d):
    """Gain over the weighted prior of a fit on each of the 28 columns alone, over purged folds, and the folds with a gain."""
    x = M.single_importance(account.weighted_spans(s, d), account.WALK, account.COLUMNS, start="a", info_end="z")
    return x.groupBy("feature").agg(F.count("gain").alias("folds"), F.avg("gain").alias("mean_gain"), F.count_if(F.col("gain") > 0).alias("positive_folds"))


@query
def distinct_openings(s, d):
    t = table(s, d, "trades").where("entry_time is not null")
    return t.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_distinct(floor_div(micros("entry_time"), big(US))).alias("openings"))
