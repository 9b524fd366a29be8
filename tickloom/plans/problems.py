"""Queries of the data-preparation problems in the core (1, 2, 3, 5, 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.time import US, floor_div, big, micros
from tickloom.operators.faults import candle_readings, group_readings, implausible
from tickloom.operators.grid import OBSERVED, regular_grid
from tickloom.operators.periods import merged_periods
from tickloom.operators.rolling import idle_days, trailing_totals
from tickloom.session import table
from tickloom.sources.records import read_candle_lines


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "candles"), table(spark, d, "feeds"), table(spark, d, "session_clock"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where(F.col("mark") != OBSERVED).select("feed_id", "bar_s")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return read_candle_lines(table(spark, d, "raw_lines")).where("kind = 'reject'").select("line_id")


def p2_candles(spark: SparkSession, d: str) -> DataFrame:
    good = read_candle_lines(table(spark, d, "raw_lines")).where("kind = 'candle'")
    prices = [F.col(c).cast("decimal(18,8)").alias(c) for c in ("open", "high", "low", "close")]
    return good.select("line_id", floor_div(micros("ts"), big(US)).alias("ts_s"), *prices, F.col("volume").cast("double").alias("volume"))


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    bad = read_candle_lines(table(spark, d, "raw_lines")).where("kind = 'reject'")
    return bad.select("line_id", F.concat_ws("|", "reasons").alias("reason"), "raw")


def faults(spark: SparkSession, d: str) -> DataFrame:
    return implausible(candle_readings(table(spark, d, "candles")).unionByName(group_readings(table(spark, d, "quote_groups"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return faults(spark, d).select("tab", "rec_id")


def trade_intervals(trades: DataFrame, labels: DataFrame) -> DataFrame:
    """``(book_id, from_s, until_s)``: from entry to the latest known end of a trade and of its label rows."""
    until = labels.where("trade_id is not null and info_ends is not null").groupBy("trade_id").agg(F.max("info_ends").alias("_info"))
    s = lambda c: floor_div(micros(c), big(US))
    return trades.join(until, "trade_id", "left").select("book_id", s("entry_time").alias("from_s"), F.greatest(s("end_time"), "_info").alias("until_s"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = trade_intervals(table(spark, d, "trades"), table(spark, d, "label_dataset"))
    return merged_periods(rows, entity="book_id", start="from_s", end="until_s")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(table(spark, d, "candles"), table(spark, d, "feeds"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return idle_days(_totals(spark, d))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d).withColumns({c: F.col(c).cast("double") for c in ("sum_7d", "sum_30d")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_candles, p2_rejects, p3_found, p5_found, p6_found, p6_rolling)
}
