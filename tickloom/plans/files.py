"""Queries that go through files: delivered formats, verified sinks and reports, written to the shared folder and read again."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions.time import big, floor_div
from tickloom.plans import market
from tickloom.plans.market import Query, quotes
from tickloom.plans.market_sql import SQL as MARKET
from tickloom.plans.problems_sql import SQL as PROBLEMS
from tickloom.session import scratch, table
from tickloom.sources import feeds as S
from tickloom.sources import sinks as O
from tickloom.sources.records import read_candle_lines

QUERIES: dict[str, Query] = {}
HOUR_MS = 3_600_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def csv_candles(s, d):
    """Clean bars as a CSV feed, read back by schema."""
    at = scratch(s, "csv")
    b = market.bars(s, d).select(F.date_format(F.timestamp_seconds("b"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "open", "high", "low", "close", F.col("feed_id").cast("double").alias("volume"))
    b.write.option("header", True).csv(at)
    x = S.read_candles(s, at)
    return x.select(F.col("volume").cast("bigint").alias("feed_id"), F.unix_seconds("timestamp").alias("b"), "open", "high", "low", "close")


@query
def line_files(s, d):
    """The delivered lines as files, read back as records: the same are rejected as in the table."""
    at = scratch(s, "lines")
    raw = table(s, d, "raw_lines").where("file_name is not null")
    # One file a name: a name's lines are a delivered file and lie in order in it.
    raw.select("file_name", "line_no", "raw").repartition("file_name").sortWithinPartitions("file_name", "line_no").select("file_name", F.coalesce("raw", F.lit("")).alias("raw")).write.partitionBy("file_name").text(at)
    got = read_candle_lines(S.read_lines(s, at + "/*/*.txt"))
    name = F.regexp_extract("file_name", "file_name=([^/]+)/", 1).alias("file_name")
    return got.where("kind = 'candle'").groupBy(name).agg(F.count("*").alias("candles"))


@query
def est_stamps(s, d):
    """Quote times as stamps in fixed UTC-5 and back, to the second and to the millisecond."""
    q = quotes(s, d).where("source_time is not null")
    local = F.timestamp_millis(F.col("source_time") - 5 * HOUR_MS)
    x = q.select("quote_id", F.date_format(local, "yyyyMMdd HHmmss").alias("a"), F.date_format(local, "yyyyMMdd HHmmssSSS").alias("b"))
    return x.select("quote_id", F.unix_seconds(S.est_to_utc(F.col("a"))).alias("at_s"), S.est_millis(F.col("b")).alias("at_ms"))


@query
def binary_ticks(s, d):
    """Valid quotes as compressed binary records of an hour each, decoded: every record with the reason why it is refused, if it is."""
    q = quotes(s, d).where("is_valid and source_time is not null and bid > 0 and ask >= bid and bid < 10000")
    hour = floor_div(F.col("source_time"), big(HOUR_MS))
    u = lambda c: F.floor(F.col(c) * S.SCALE + F.lit("0.5").cast("decimal(2,1)")).cast("bigint")
    x = q.select(F.struct("feed_id", hour.alias("h")).alias("k"), (F.col("source_time") - hour * HOUR_MS).alias("ms"), u("bid").alias("bid"), u("ask").alias("ask"), "seq", "quote_id")

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["ms", "seq", "quote_id"])
        r = np.zeros(len(t), S.TICK_RECORD)
        for c in ("ms", "bid", "ask"):
            r[c] = t[c].to_numpy()
        r["ask_volume"], r["bid_volume"] = 1, 1
        k = t["k"].iloc[0]
        return pd.DataFrame({"feed_id": [k["feed_id"]], "h": [k["h"]], "payload": [lzma.compress(r.tobytes())]})

    packed = x.groupBy("k").applyInPandas(pack, "feed_id bigint, h bigint, payload binary")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, h, p in zip(b["feed_id"], b["h"], b["payload"]):
                r = S.decode_ticks(p)
                why = S.tick_faults(r)
                yield pd.DataFrame({"feed_id": f, "ts_ms": r["ms"].astype(np.int64) + h * HOUR_MS, "bid_i": r["bid"].astype(np.int64), "ask_i": r["ask"].astype(np.int64), "reason": why})

    out = packed.mapInPandas(unpack, "feed_id bigint, ts_ms bigint, bid_i bigint, ask_i bigint, reason string")
    return out.groupBy("feed_id").agg(F.count("*").alias("n"), F.sum("ts_ms").alias("ts_sum"), F.sum("bid_i").alias("bid_sum"), F.sum("ask_i").alias("ask_sum"), F.count_if(F.col("reason") != "").alias("refused"))


@query
def verified_sink(s, d):
    """Trades through a sink that fingerprints what it writes and what it reads."""
    back = O.write_verified(table(s, d, "trades"), scratch(s, "verified"), partition_by=["side"])
    return back.groupBy("side").agg(F.count("*").alias("n"), F.sum("pnl_pips").cast("double").alias("pips"))


@query
def label_files(s, d):
    """Label exports read back from their files: rows, targets and total of each."""
    at = scratch(s, "labels")
    lab = market.first_touch_labels(s, d).join(market.hard_negatives(s, d).select("feed_id", "b", "side", "post_status"), ["feed_id", "b", "side"], "left")
    O.write_labels(lab, at)
    out = None
    for name in ("all", "selected", "hard_negatives"):
        x = s.read.schema("feed_id bigint, b bigint, side int, outcome string, end_s bigint, exit_i bigint, pnl_pips decimal(18,4), post_status string, label int").csv(f"{at}/{name}", header=True)
        one = x.groupBy("feed_id").agg(F.count("*").alias("rows"), F.sum("label").alias("targets"), F.sum("pnl_pips").cast("double").alias("pips")).withColumn("export", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def report_table(s, d):
    """A report as Markdown and back."""
    t = table(s, d, "trades").groupBy("outcome").agg(F.count("*").alias("n"), F.sum("pnl_pips").alias("pips")).orderBy("outcome")
    lines = O.markdown(t).splitlines()
    back = O.parse_markdown(s.createDataFrame([(x,) for x in lines], "line string"), "line", ["outcome", "n", "pips"])
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    return back.select(known("outcome").alias("outcome"), F.col("n").cast("bigint").alias("n"), known("pips").cast("double").alias("pips"))


_Q = "q AS (SELECT * FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND source_time IS NOT NULL)"
SQL: dict[str, str] = {
    "csv_candles": MARKET["clean_bars"].replace("SELECT feed_id, step, b, open", "SELECT feed_id, b, open"),
    "est_stamps": f"WITH {_Q} SELECT quote_id, source_time // 1000 AS at_s, source_time AS at_ms FROM q",
    "binary_ticks": f"""WITH {_Q}, x AS (SELECT feed_id, source_time AS t, CAST(floor(bid * 100000 + 0.5) AS BIGINT) AS b, CAST(floor(ask * 100000 + 0.5) AS BIGINT) AS a FROM q WHERE is_valid AND bid > 0 AND ask >= bid AND bid < 10000)
SELECT feed_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS ts_sum, CAST(sum(b) AS BIGINT) AS bid_sum, CAST(sum(a) AS BIGINT) AS ask_sum, count(*) FILTER (b <= 0) AS refused FROM x GROUP BY 1""",
    "verified_sink": "SELECT side, count(*) AS n, CAST(sum(pnl_pips) AS DOUBLE) AS pips FROM trades GROUP BY 1",
    "report_table": "SELECT outcome, count(*) AS n, CAST(sum(pnl_pips) AS DOUBLE) AS pips FROM trades GROUP BY 1",
}
SQL["line_files"] = f"""WITH bad AS ({PROBLEMS["p2_found"]}), h AS (SELECT file_name, replace(regexp_replace(raw, '\\r$', ''), '"', '') AS heading FROM raw_lines WHERE line_no = 1)
SELECT file_name, count(*) AS candles FROM raw_lines JOIN h USING (file_name) WHERE line_no > 1 AND replace(regexp_replace(coalesce(raw, ''), '\\r$', ''), '"', '') <> heading AND line_id NOT IN (SELECT line_id FROM bad) GROUP BY 1"""
