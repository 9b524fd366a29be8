"""Streaming queries: each is drained over the files there are and equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans import market
from tickloom.plans.market import Query
from tickloom.plans.market_sql import SQL as _BATCH
from tickloom.streaming.run import drained, file_stream
from tickloom.session import scratch, written
from tickloom.streaming.twins import stream_bars as bars_of
from tickloom.streaming.twins import stream_cusum as cusum_of
from tickloom.streaming.twins import stream_highwater
from tickloom.streaming.twins import stream_opportunities as opportunities_of

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def stream_bars(s, d):
    """Hourly bars of each event type; those the watermark has passed (two hours behind the latest event)."""
    e = file_stream(s, f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return drained(bars_of(e, time="ts", key="event_type", price="value", order="event_id"), "bars")


@query
def stream_late_flags(s, d):
    """Late quotes by keyed state; the batch twin is ``late_flags``."""
    q = file_stream(s, f"{d}/quotes.parquet").where("feed_id is not null and seq is not null")
    out = drained(stream_highwater(q, key="feed_id", seq="seq", time_ms="source_time", ident="quote_id"), "late")
    return out.select("quote_id", "available_ms", "late")


def arriving(s, d) -> str:
    """Clean bars in three files, one after the other in order of time."""
    at, b = scratch(s, "arriving"), market.bars(s, d).select("feed_id", "step", "b", F.col("close").cast("double").alias("close"))
    b = written(b, "bars")
    for lo, hi in ((None, 1_740_000_000), (1_740_000_000, 1_747_000_000), (1_747_000_000, None)):
        part = b.where((F.lit(True) if lo is None else F.col("b") >= lo) & (F.lit(True) if hi is None else F.col("b") < hi))
        part.coalesce(1).write.mode("append").parquet(at)
    return at


@query
def stream_cusum(s, d):
    """CUSUM events of clean bars that arrive file after file, in order of time: sums go on from one batch to the next."""
    at, out = arriving(s, d), None
    for step in (60, 300, 900, 3600, 14_400):
        x = file_stream(s, at, 1).where(F.col("step") == step)
        one = drained(cusum_of(x, key="feed_id", time="b", close="close", step_s=step, h=0.002), "cusum")
        out = one if out is None else out.unionByName(one)
    return out.where("event").select("feed_id", "b")


@query
def stream_opportunities(s, d):
    """Sides and window features of one-minute bars with a state of 242 bars a feed; the batch twins are ``momentum_side`` and ``features_past``."""
    x = file_stream(s, arriving(s, d), 1).where("step = 60")
    out = drained(opportunities_of(x, key="feed_id", time="b", close="close", step_s=60), "opportunities")
    return out.select("feed_id", "b", "side", *[market.rounded(c, 6) for c in out.columns if c[:4] in ("ret_", "vol_")])


_WINDOWS = ", ".join(f"{k}_{n}" for n in (5, 15, 60, 240) for k in ("ret", "vol"))
SQL: dict[str, str] = {
    "stream_opportunities": f"""WITH f AS ({_BATCH["features_past"]}), m AS ({_BATCH["momentum_side"]})
SELECT feed_id, b, side, {_WINDOWS} FROM f JOIN m USING (feed_id, b) WHERE feed_id IN (SELECT feed_id FROM feeds WHERE bar_seconds = 60)""",
    "stream_bars": """
WITH e AS (SELECT event_id, ts, event_type, value, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS b FROM events)
SELECT event_type, b, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n
FROM e GROUP BY 1, 2 HAVING b + 3600 <= (SELECT max(epoch(ts)) FROM events) - 7200""",
    "stream_late_flags": _BATCH["late_flags"],
    "stream_cusum": f"SELECT feed_id, b FROM ({_BATCH['cusum_events']}) WHERE event",
}
