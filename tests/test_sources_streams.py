from __future__ import annotations

import lzma
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.ticks import highwater
from tickloom.sources import feeds as S
from tickloom.sources import sinks as O
from tickloom.sources.records import read_candle_lines
from tickloom.streaming.twins import stream_bars, stream_cusum, stream_highwater


def test_binary_feeds(spark, tmp_path):
    t = np.array([(0, 110005, 110000, 1.5, 2.5), (999, 110007, 110001, 0.5, 0.25)], S.TICK_RECORD)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1000.bin").write_bytes(lzma.compress(t.tobytes()))
    (tmp_path / "t" / "2000.bin").write_bytes(b"")
    start = F.regexp_extract("path", r"(\d+)\.bin$", 1)
    rows = sorted(map(tuple, S.read_binary_ticks(spark, str(tmp_path / "t"), start).drop("path").collect()))
    assert [(r[0], str(r[1]), str(r[2]), r[3], r[4]) for r in rows] == [(1000, "1.10000000", "1.10005000", 2.5, 1.5), (1999, "1.10001000", "1.10007000", 0.25, 0.5)]
    b = np.array([(60, 1, 4, 0, 9, 3.0)], S.BAR_RECORD)
    (tmp_path / "60.bars").write_bytes(lzma.compress(b.tobytes()))
    r = S.read_binary_bars(spark, str(tmp_path / "60.bars"), F.lit(1000)).first()
    assert r.b == 1060 and [str(r[c])[:7] for c in ("open", "high", "low", "close")] == ["0.00001", "0.00009", "0E-8"[:7], "0.00004"]
    with pytest.raises(ValueError):
        S.decode_ticks(lzma.compress(b"12345"))


def test_stamps_in_fixed_offset(spark):
    rows = [("20240310 070000", "20240310 070000123"), ("20240230 000000", "20240230 000000000"), ("x", "20240310 07000012"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(F.unix_seconds(S.est_to_utc(F.col("a"))).alias("a"), S.est_millis(F.col("b")).alias("b"))
    got = [tuple(r) for r in df.collect()]
    assert got == [(1_710_072_000, 1_710_072_000_123), (None, None), (None, None), (None, None)]


def test_files_of_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"timestamp,open,high,low,close\r\n2025-01-01T00:00:00Z,1,1,1,1\r\nEOF")
    lines = S.read_lines(spark, str(tmp_path))
    assert sorted((r.line_no, r.kind) for r in read_candle_lines(lines).collect()) == [(1, "header"), (2, "candle"), (3, "reject")]
    (tmp_path / "c.csv").write_text("timestamp,open,high,low,close,volume\n2025-01-01 00:00:00+00:00,1.5,2,1,1.25,3\n")
    r = S.read_candles(spark, str(tmp_path / "c.csv")).first()
    assert str(r.open) == "1.50000000" and r.timestamp.hour == 0


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b|c", 0.5)], "i long, s string, x double")
    for fmt in ("parquet", "json", "orc"):
        assert O.write_verified(df, str(tmp_path / fmt), fmt).count() == 2
    text = O.markdown(df.orderBy("i"))
    assert text.splitlines()[2] == "| 1 | a | unknown |"
    back = O.parse_markdown(spark.createDataFrame([(x,) for x in text.splitlines()], "l string"), "l", ["i", "s", "x"])
    assert sorted(tuple(r) for r in back.collect()) == [("1", "a", "unknown"), ("2", "b\\|c", "0.5")]
    with pytest.raises(ValueError):
        O.markdown(df, 1)
    u = O.union_reports([df, df.select("i").withColumn("z", F.lit(1))])
    assert u.columns == ["i", "s", "x", "z"] and u.count() == 4
    labels = spark.createDataFrame([(1, "take_profit", None), (2, "stop_loss", "reached")], "b long, outcome string, post_status string")
    O.write_labels(labels, str(tmp_path / "labels"))
    assert spark.read.csv(str(tmp_path / "labels" / "hard_negatives"), header=True).count() == 1


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1 + i % 3, i // 3, rng.choice([None, 1000 + i * 10 - rng.choice([0, 0, 40])])) for i in range(300)]
    df = spark.createDataFrame(rows, "quote_id long, feed_id long, seq long, source_time long")
    for k in range(3):  # three files in order: three micro-batches
        df.where(f"quote_id >= {k * 100} and quote_id < {k * 100 + 100}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drain(stream_highwater(src, key="feed_id", seq="seq", time_ms="source_time", ident="quote_id"), "hw")
    want = highwater(df).select("quote_id", "available_ms", "late")
    assert sorted(map(tuple, got.select("quote_id", "available_ms", "late").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)

    bars = [(1 + i % 2, 60 * (i // 2) + (600 if i > 90 else 0), math.exp(rng.gauss(0, 0.01))) for i in range(200)]
    bdf = spark.createDataFrame(bars, "feed_id long, b long, close double")
    bdf.where("b < 3000").coalesce(1).write.parquet(str(tmp_path / "bars/0"))
    bdf.where("b >= 3000").coalesce(1).write.parquet(str(tmp_path / "bars/1"))
    src = spark.readStream.schema(bdf.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "bars"))
    got = drain(stream_cusum(src, key="feed_id", time="b", close="close", step_s=60, h=0.02), "cu")
    from tickloom.operators.events import cusum_events

    full = bdf.select("feed_id", F.lit(60).cast("bigint").alias("step"), "b", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")])
    want = {tuple(r) for r in cusum_events(full, 0.02).where("event").select("feed_id", "b").collect()}
    assert {(r.feed_id, r.b) for r in got.where("event").collect()} == want and want

    ticks = spark.createDataFrame([(i, 1, 1_735_689_600 + i * 700, float(i % 13)) for i in range(100)], "id long, k long, s long, p double").withColumn("ts", F.timestamp_seconds("s"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks/0"))
    src = spark.readStream.schema(ticks.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "ticks"))
    got = drain(stream_bars(src, time="ts", key="k", price="p", order="id"), "ba").collect()
    for r in got:
        inside = [(i, float(i % 13)) for i in range(100) if r.b <= 1_735_689_600 + i * 700 < r.b + 3600]
        p = [x for _, x in inside]
        assert (r.open, r.high, r.low, r.close, r.n) == (p[0], max(p), min(p), p[-1], len(p))
    assert len(got) >= 15  # all bars that the watermark has passed


def test_records_with_newlines_stay_whole(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes(b'timestamp,open,high,low,close\n2025-01-01T00:00:00Z,"1\n",1,1,1\n2025-01-01T00:01:00Z,1,1,1,1')
    rows = sorted((r.line_no, r.raw) for r in S.read_lines(spark, str(tmp_path)).collect())
    assert [n for n, _ in rows] == [1, 2, 3] and rows[1][1].count("\n") == 1


def test_faulty_binary_records_are_kept_with_a_reason(spark, tmp_path):
    t = [(5, 2, 1, 1, 1), (4, 2, 1, 1, 1), (5, 1, 2, 1, 1), (6, 2, 0, 1, 1), (7, 2, 1, math.nan, 1), (7, 2, 1, -1, 1), (3_600_000, 2, 1, 1, 1)]
    assert S.tick_faults(np.array(t, S.TICK_RECORD)).tolist() == ["", "order", "price", "price", "volume", "volume", "range"]
    b = [(0, 2, 2, 1, 3, 1), (0, 2, 2, 1, 3, 1), (60, 2, 4, 1, 3, 1), (90, 2, 2, 1, 3, 1), (120, 2, 2, 0, 3, 1), (180, 2, 2, 1, 3, math.inf), (86_400, 2, 2, 1, 3, 1)]
    bars = np.array(b, S.BAR_RECORD)
    assert S.bar_faults(bars).tolist() == ["", "order", "price", "range", "price", "volume", "range"]
    (tmp_path / "x.bin").write_bytes(lzma.compress(bars.tobytes()))
    got = {(r.b, r.reason) for r in S.read_binary_bars(spark, str(tmp_path), F.lit(0)).collect()}
    assert (0, None) in got and (0, "order") in got and len(got) == 7
    assert len(S.tick_faults(np.zeros(0, S.TICK_RECORD))) == 0


def test_label_exports(spark):
    rows = [(1, 0, 1, "take_profit", 30, 50.0, None), (1, 10, 1, "take_profit", 40, 60.0, None), (1, 40, -1, "stop_loss", 50, -20.0, "reached"), (1, 50, 1, "timeout", 90, 5.0, None), (1, 60, 1, "censored", 90, None, None)]
    x = O.label_exports(spark.createDataFrame(rows, "feed_id long, b long, side int, outcome string, end_s long, pnl_pips double, post_status string"))
    got = {k: sorted((r.b, r.label) for r in v.collect()) for k, v in x.items()}
    assert got == {"all": [(0, 1), (10, 1), (40, 0), (50, 0)], "hard_negatives": [(40, 0)], "selected": [(10, 1), (50, 0)]}


def test_streams_go_on_where_they_ended(spark, tmp_path):
    from tickloom.streaming.run import drained, file_stream

    df = spark.createDataFrame([(i, 1, i, 1000 + i - 5 * (i == 6)) for i in range(10)], "quote_id long, feed_id long, seq long, source_time long")
    df.where("quote_id < 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: drained(stream_highwater(file_stream(spark, str(tmp_path / "in")), key="feed_id", seq="seq", time_ms="source_time", ident="quote_id"), "hw", f"file://{tmp_path}/at")
    assert run().count() == 5
    df.where("quote_id >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted((r.quote_id, r.late) for r in run().collect()) == [(i, i == 6) for i in range(10)]


def test_written_tables_are_released(spark):
    from tickloom.session import _SCRATCH, release, written

    assert written(spark.range(3), "x").count() == 3
    assert any("/x-" in p for p in _SCRATCH) and release(spark) >= 1 and not _SCRATCH
