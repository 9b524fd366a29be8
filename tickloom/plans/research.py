"""Queries of overlap, folds, statistics and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.time import US, big, floor_div, micros
from tickloom.operators import folds as P
from tickloom.operators import intervals as V
from tickloom.operators import provenance as H
from tickloom.operators import stats as S
from tickloom.plans.market import Query, bars, rounded
from tickloom.session import table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def spans(s, d) -> DataFrame:
    """Trades as intervals of whole seconds with their value in tenths of a thousandth of a pip."""
    keyed = table(s, d, "trades").select("trade_id", "book_id", (F.col("pnl_pips") * 10_000).cast("bigint").alias("value"), "outcome", floor_div(micros("entry_time"), big(US)).alias("a"), floor_div(micros("end_time"), big(US)).alias("z"))
    return keyed.where("book_id is not null and a < z")


# --- overlap ---------------------------------------------------------------------------------------


@query
def uniqueness_weights(s, d):
    return V.uniqueness(spans(s, d), "trade_id", "book_id", "a", "z").select("trade_id", rounded("raw", 8), rounded("weight", 6))


@query
def concurrency(s, d):
    return V.concurrency(spans(s, d), "book_id", "a", "z").select("book_id", "most", rounded("active_mean", 6))


@query
def schedule_greedy(s, d):
    return V.greedy_schedule(spans(s, d), "trade_id", "book_id", "a", "z")


@query
def schedule_weighted(s, d):
    winners = spans(s, d).where("outcome = 'take_profit'")
    chosen = V.weighted_schedule(winners, "trade_id", "book_id", "a", "z", "value").select("trade_id")
    picked = winners.join(chosen, "trade_id")
    return picked.groupBy("book_id").agg(F.count("*").alias("trades"), F.sum("value").alias("value"), F.sum(F.col("z") - F.col("a")).alias("seconds"))


@query
def longest_run(s, d):
    return V.longest_run(bars(s, d))


# --- folds -----------------------------------------------------------------------------------------

#: (fold, part, boundary, stop) in epoch seconds, within the span of the data.
FOLDS = [(k, part, b, b + n * 86_400) for k, b in ((1, 1_741_000_000), (2, 1_745_000_000), (3, 1_749_000_000)) for part, n in (("inner", 14), ("outer", 40))]


def labeled(s, d) -> DataFrame:
    return table(s, d, "label_dataset").where("starts is not null and info_ends >= starts")


@query
def purged_split(s, d):
    side = P.purged(F.col("starts"), F.col("info_ends"), F.lit(1_745_000_000), F.lit(1_750_000_000))
    return labeled(s, d).select("label_id", side.alias("side"))


@query
def fold_partitions(s, d):
    x = P.partitioned(labeled(s, d).select("label_id", "starts", "info_ends", "y"), FOLDS, "starts", "info_ends")
    return x.groupBy("fold", "partition").agg(F.count("*").alias("rows"), F.min("starts").alias("first_s"), F.max("info_ends").alias("last_s"))


@query
def class_support(s, d):
    x = P.partitioned(labeled(s, d).select("label_id", "starts", "info_ends", "y"), FOLDS, "starts", "info_ends")
    return P.class_support(x, ["fold", "partition"])


@query
def observed_boundary(s, d):
    return P.observed_boundary(bars(s, d), 1_745_000_000)


@query
def admission(s, d):
    m = table(s, d, "economic_matrix")
    gone = lambda c: F.col(c).isNull() | (F.col(c) == -9223372036854775808)
    reasons = [
        ("not_eligible", ~F.col("eligible")),
        ("no_entry", gone("entry_ms")),
        ("no_information_end", gone("information_end_ms")),
        ("beyond_cap", F.col("information_end_ms") > F.col("information_cap_ms")),
        ("unknown_label", F.col("y") < 0),
    ]
    return m.select("row_id", P.admission(m, reasons).alias("reason"))


# --- statistics ------------------------------------------------------------------------------------


@query
def describe(s, d):
    out = S.describe(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "n", *[rounded(c, 4) for c in ("mean", "std", "low", "q05", "q50", "q95", "high")])


@query
def regime_tertiles(s, d):
    return S.tertiles(table(s, d, "events"), ["event_type"], "value")


@query
def regime_report(s, d):
    e = table(s, d, "events")
    x = S.banded(e, S.tertiles(e, ["event_type"], "value"), ["event_type"], "value")
    x = x.withColumn("month", F.date_format("ts", "yyyy-MM"))
    g = x.groupingSets([["event_type", "band"], ["event_type"], ["month", "band"], []], "event_type", "band", "month").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.grouping_id().cast("int").alias("level")
    )
    return g.select("event_type", "band", "month", "level", "n", rounded("total", 3))


def scored(s, d) -> DataFrame:
    """Known labels with two deterministic scores that have many ties."""
    x = table(s, d, "label_dataset").where("y in (0, 1) and starts is not null")
    p = (F.pmod(F.col("label_id") * 37, F.lit(101)) + 0.5) / 102
    q = (F.pmod(F.col("label_id") * 53 + F.col("y") * 20, F.lit(97)) + 0.5) / 98
    return x.select("label_id", "side", "starts", F.col("y").cast("int").alias("y"), p.alias("p"), q.alias("q"))


@query
def ap_auc(s, d):
    out = S.scores(scored(s, d), ["side"])
    return out.select("side", "rows", "positives", *[rounded(c, 8) for c in ("log_loss", "brier", "average_precision", "roc_auc")])


@query
def thresholds(s, d):
    return S.threshold_grid(scored(s, d), ["side"])


@query
def chosen_threshold(s, d):
    return S.choose_threshold(S.threshold_grid(scored(s, d), ["side"], (0.1, 0.2, 0.3, 0.4, 0.5), p="q"), ["side"])


@query
def reliability(s, d):
    return S.reliability(scored(s, d), ["side"]).select("side", "decile", "rows", rounded("mean_p", 8), rounded("share", 8))


@query
def week_sensitivity(s, d):
    out = S.week_sensitivity(scored(s, d), ["side"], y="y", a="p", b="q", start="starts")
    return out.select("side", "weeks", *[rounded(f"{k}_{x}", 7) for k in ("log_loss", "brier") for x in ("delta", "min", "max")])


@query
def weighted_quantiles(s, d):
    out = S.weighted_summary(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", "n", "weight", rounded("mean", 6), rounded("std", 6), "q05", "q50", "q95")


@query
def drift(s, d):
    x = table(s, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    out = S.drift(x, F.col("year") <= 1995, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["year"])
    return out.select("feature", "year", "n", rounded("shift", 6), rounded("ratio", 6), rounded("outside", 8))


@query
def tri_all(s, d):
    e = table(s, d, "events").withColumn("ok", F.when(F.pmod("event_id", F.lit(11)) == 0, F.lit(None)).otherwise(F.col("value") >= 0) & (F.pmod("user_id", F.lit(7)) != 3))
    return e.groupBy("user_id").agg(S.tri_all(F.col("ok")).alias("all_ok"))


@query
def correlations(s, d):
    out = S.correlations(table(s, d, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_discount", "l_tax"], "l_quantity")
    return out.select("l_returnflag", "feature", "n", rounded("r", 8))


@query
def unit_root(s, d):
    b = bars(s, d).select("feed_id", "b", F.ln(F.col("close").cast("double")).alias("x"))
    return S.adf_statistic(b, ["feed_id"], ["b"], "x").select("feed_id", "n", rounded("t", 3))


@query
def family_removal(s, d):
    x = scored(s, d).select("side", F.col("y").cast("double").alias("y"), (F.ln(F.col("p") / (1 - F.col("p")))).alias("a"), (F.col("q") - 0.5).alias("b"))
    x = x.withColumn("logit", F.col("a") + F.col("b") + 0.1)
    return S.removal(x, ["side"], "y", "logit", ["a", "b"]).select("side", "family", rounded("log_loss_delta", 7), rounded("brier_delta", 7))


@query
def consistent_gain(s, d):
    x = P.partitioned(scored(s, d).withColumn("info", F.col("starts") + 60), [f for f in FOLDS if f[1] == "outer"], "starts", "info").where("role = 'test'")
    a, b = (S.scores(x.withColumn("p", F.col(c)), ["fold"]).select("fold", F.col("log_loss").alias(f"ll_{c}"), F.col("brier").alias(f"br_{c}")) for c in ("p", "q"))
    j = a.join(b, "fold")
    return j.agg(F.bool_and(F.col("ll_q") < F.col("ll_p")).alias("every_fold"), (F.avg(F.col("br_q") - F.col("br_p")) <= 0).alias("mean_brier"), F.count("*").alias("folds"))


# --- provenance ------------------------------------------------------------------------------------


def hashed_events(s, d):
    """All columns in forms that have one text in every engine: stamps in microseconds, values in millionths."""
    e = table(s, d, "events")
    return e.select("event_id", micros("ts").alias("ts_us"), "user_id", "event_type", F.floor(F.col("value") * 1e6 + 0.5).cast("bigint").alias("value_u"), "props", F.date_format("ts", "yyyy-MM-dd").alias("day"))


HASHED = ["event_id", "ts_us", "user_id", "event_type", "value_u", "props"]


@query
def row_hashes(s, d):
    return hashed_events(s, d).select("event_id", H.row_hash(HASHED).alias("sha"))


@query
def hash_chain(s, d):
    return H.bucket_chain(hashed_events(s, d), ["event_type"], "day", HASHED)


@query
def broken_links(s, d):
    """Links found broken in a chain of which every seventh body was altered."""
    chain = hash_chain(s, d).withColumn("body", F.when(F.substring("day", 9, 2).cast("int") % 7 == 0, F.sha2("body", 256)).otherwise(F.col("body")))
    return H.broken_links(chain, ["event_type"], "day").select("event_type", "day")


@query
def table_fingerprint(s, d):
    """The order-free content hash of each type's rows."""
    out = H.table_fingerprint(hashed_events(s, d), HASHED, ["event_type"])
    return out.select("event_type", "rows", F.col("sum_a").cast("string").alias("sum_a"), F.col("sum_b").cast("string").alias("sum_b"))


@query
def key_faults(s, d):
    """Trades without a label row or with several, and label rows of unknown trades."""
    return H.key_faults(table(s, d, "trades").select("trade_id"), table(s, d, "label_dataset").where("trade_id is not null").select("trade_id"), ["trade_id"])


@query
def replay_difference(s, d):
    """Groups recomputed from the quotes against the delivered ones, compared by key and prices."""
    cols = ["feed_id", "first_seq", "last_seq", "ts_ms", "bid_min", "ask_max"]
    from tickloom.plans.market import tie_groups

    mine = tie_groups(s, d).where("eligible").select(*cols).distinct()
    given = table(s, d, "quote_groups").where("eligible").select(*cols).distinct()
    return H.differences(mine, given).groupBy("side").agg(F.count("*").alias("rows"))
