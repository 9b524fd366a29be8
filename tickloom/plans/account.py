"""Queries of cash flows, models and tick labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.time import US, big, floor_div, micros
from tickloom.operators import clock as C
from tickloom.operators import intervals as V
from tickloom.operators import ledger as A
from tickloom.operators import models as M
from tickloom.operators import stats as S
from tickloom.operators.tick_labels import tick_labels as label_ticks
from tickloom.plans.market import Query, pip_of, quotes, rounded
from tickloom.plans.research import spans
from tickloom.session import table

QUERIES: dict[str, Query] = {}
UNITS, CAPITAL = 1000, 10_000
#: Commission per fill, slip per unit, annual rate of each cost bundle (fixed values).
BUNDLES = {"S0": ("0", "0", "0"), "S1": ("0.035", "0.00001", "0.05"), "S2": ("0.07", "0.00005", "0.1")}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def closed(s, d):
    t = table(s, d, "trades").where("book_id is not null and entry_time < end_time and entry_price is not null and exit_price is not null")
    sec = lambda c: floor_div(micros(c), big(US))
    side = F.when(F.col("side") == "long", 1).otherwise(-1)
    return t.select("trade_id", "book_id", sec("entry_time").alias("a"), sec("end_time").alias("z"), "entry_price", (side * (F.col("exit_price") - F.col("entry_price"))).cast("decimal(18,8)").alias("move"))


def flows(s, d):
    held = A.interval_sum(closed(s, d), C.rollovers(s, "2025-01-01", "2026-01-01"), "a", "z", "at_s", "factor", "nights")
    return A.cashflows(A.scenarios(held, BUNDLES), F.col("move") * F.lit(UNITS).cast("decimal(10,0)"), UNITS)


@query
def funding_nights(s, d):
    held = A.interval_sum(closed(s, d), C.rollovers(s, "2025-01-01", "2026-01-01"), "a", "z", "at_s", "factor", "nights")
    return held.select("trade_id", F.col("nights").cast("bigint").alias("nights"))


@query
def cashflow_ledger(s, d):
    return flows(s, d).groupBy("scenario", "kind").agg(F.count("*").alias("flows"), F.sum("amount").cast("double").alias("amount"), F.sum("numerator").cast("double").alias("numerator"))


@query
def period_pnl(s, d):
    out = A.period_report(flows(s, d))
    return out.select("scenario", "book_id", "month", F.col("realized").cast("double").alias("realized"), F.col("commission").cast("double").alias("commission"), rounded("funding", 4))


@query
def drawdown(s, d):
    x = A.equity_marks(flows(s, d), CAPITAL)
    return x.select("account", *[F.col(c).cast("double").alias(c) for c in ("low", "high", "drawdown")], "breach")


@query
def exposure_months(s, d):
    return A.exposure(closed(s, d))


@query
def promotion(s, d):
    """Per book, three-valued: gain in every month of S1, and drawdown within a twentieth of the capital in S2."""
    r = A.period_report(flows(s, d)).where("scenario = 'S1'").withColumn("gain", (F.col("realized") + F.col("commission")) > 0)
    gain = r.groupBy("book_id").agg(S.tri_all(F.col("gain")).alias("every_month"))
    dd = A.equity_marks(flows(s, d).where("scenario = 'S2'"), CAPITAL)
    dd = dd.select(F.split("account", "/")[1].cast("bigint").alias("book_id"), ((F.col("drawdown") <= CAPITAL / 20) & ~F.col("breach")).alias("contained"))
    return gain.join(dd, "book_id")


def _tick_rows(s, d):
    m = table(s, d, "economic_matrix").join(table(s, d, "feeds").select("feed_id", pip_of().alias("pip")), "feed_id")
    return m.select("row_id", "feed_id", F.col("decision_ms").alias("at_ms"), "side", "pip")


@query
def tick_first_touch(s, d):
    """Deadlines after 4,320 open minutes, however many closures lie between; decisions whose deadline is beyond the calendar have no label."""
    rows = C.advance_ms(_tick_rows(s, d).where("at_ms is not null"), table(s, d, "session_clock"), "at_ms", 259_200_000)
    return label_ticks(rows, quotes(s, d), deadline=F.col("deadline_ms"), tp=F.col("pip") * 50, sl=F.col("pip") * 20)


@query
def tick_first_touch_short(s, d):
    return label_ticks(_tick_rows(s, d), quotes(s, d), deadline=F.col("at_ms") + 900_000, tp=F.col("pip") * 5, sl=F.col("pip") * 2)


# --- models ----------------------------------------------------------------------------------------

COLUMNS = [f"x{i}" for i in range(28)]
#: The matrix has the 28 features in the order of ``past_features``: ret, vol, range, z, eff of each of four windows, then the rest.
FAMILIES = {
    "movement": COLUMNS[0:20:5], "volatility": COLUMNS[1:20:5] + COLUMNS[2:20:5], "position": COLUMNS[3:20:5], "path": COLUMNS[4:20:5] + COLUMNS[20:23], "context": COLUMNS[23:],
}


def matrix(s, d):
    m = table(s, d, "economic_matrix").where("y in (0, 1) and side in (-1, 1) and features is not null and size(features) = 28")
    month = F.date_format(F.timestamp_millis("decision_ms"), "yyyy-MM").alias("month")
    w = (F.lit(1.0) + F.pmod("row_id", F.lit(5)) / 4).alias("w")
    return m.select("row_id", "feed_id", month, F.col("y").cast("int").alias("y"), w, *[F.col("features")[i].alias(c) for i, c in enumerate(COLUMNS)])


@query
def weighted_prior(s, d):
    return M.weighted_prior(matrix(s, d), ["month"], "y", "w").select("month", "n", "weight", rounded("prior", 9))


@query
def logistic_weighted(s, d):
    """Fitted on all known rows, scored by the expression; per month the mean probability and the loss."""
    x = matrix(s, d)
    state = M.fit_logistic(x, COLUMNS)
    p = x.select("month", "y", state.probability().alias("p"))
    return p.groupBy("month").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(S.clipped_loss(F.col("y").cast("double"), F.col("p"))).alias("log_loss"))


WALK = [(k, b, b + 40 * 86_400) for k, b in ((1, 1_741_000_000), (2, 1_745_000_000), (3, 1_749_000_000))]


def weighted_spans(s, d):
    """Labelled decisions with their columns and the uniqueness of their information spans within the feed."""
    m = table(s, d, "economic_matrix").where("y in (0, 1) and features is not null and size(features) = 28 and information_end_ms > decision_ms")
    x = m.select("row_id", "feed_id", "y", floor_div(F.col("decision_ms"), big(1000)).alias("a"), floor_div(F.col("information_end_ms"), big(1000)).alias("z"), *[F.col("features")[i].alias(c) for i, c in enumerate(COLUMNS)])
    w = V.uniqueness(x.where("a < z"), "row_id", "feed_id", "a", "z").select("row_id", F.col("weight").alias("w"))
    return x.join(w, "row_id")


@query
def walk_forward(s, d):
    """Weights by uniqueness of the information spans of each feed, purged folds, a fit a fold, scores."""
    return M.walk_forward(weighted_spans(s, d), WALK, COLUMNS, start="a", info_end="z")


@query
def family_importance(s, d):
    x = matrix(s, d)
    return M.block_importance(x, "row_id", FAMILIES, M.fit_logistic(x, COLUMNS), "y")


@query
def networks(s, d):
    return M.fit_networks(matrix(s, d), "month", COLUMNS, "y", "w", seeds=[1, 2], updates=9580).select("population", "seed", "n", "loss")


@query
def bagged_bootstrap(s, d):
    """How often each trade is drawn by sequential interval bootstrap within its book's month, and its mean probability."""
    x = spans(s, d).withColumn("month", F.date_format(F.timestamp_seconds("a"), "yyyy-MM"))
    b = M.interval_bootstrap(x, ["book_id", "month"], "trade_id", "a", "z", members=3, draws=512)
    return b.groupBy("population", "id").agg(F.count("*").alias("draws"), F.avg("p").alias("mean_p"))
