from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.operators.grid import regular_grid

UTC = dt.timezone.utc
R = "candle_id long, feed_id long, ts timestamp, close_px decimal(18,8), ingested_at timestamp, value string"
S = "feed_id long, bar_seconds int, first_ts timestamp, last_ts timestamp, mark string"
C = "minute_ts timestamp, active boolean"


def at(s):
    return None if s is None else dt.datetime.fromtimestamp(s, UTC)


def tables(spark, readings, sources, minutes):
    from decimal import Decimal

    r = [(i, f, at(t), None if v is None else Decimal(str(v)), at(g), "x") for i, f, t, v, g in readings]
    return (
        spark.createDataFrame(r, R),
        spark.createDataFrame([(f, b, at(a), at(z), "x") for f, b, a, z in sources], S),
        spark.createDataFrame([(at(m), a) for m, a in minutes], C),
    )


def brute(readings, sources, minutes, gap):
    on = {m for m, a in minutes if a and m is not None}
    out = {}
    for f, b, a, z in sources:
        if None in (f, b, a, z) or b <= 0:
            continue
        best = {}
        for i, g, t, v, ing in readings:
            if g == f and t is not None and v is not None:
                k = t // b * b
                if k not in best or (ing is not None, ing, i, t) > best[k][0]:
                    best[k] = ((ing is not None, ing, i, t), t, float(v))
        for m in range(int(-(-a // b) * b), int(-(-z // 1)), b):
            if m >= z or m not in on:
                continue
            if m in best:
                out[f, m] = ("observed", best[m][2])
                continue
            p = max((k for k in best if k < m), default=None)
            q = min((k for k in best if k > m), default=None)
            if p is not None and q is not None and best[q][1] - best[p][1] <= gap * b:
                (_, t0, v0), (_, t1, v1) = best[p], best[q]
                out[f, m] = ("interpolated", v0 + (v1 - v0) * (m - t0) / (t1 - t0))
            else:
                out[f, m] = ("missing", None)
    return out


def run(spark, *args, **kw):
    rows = regular_grid(*tables(spark, *args), **kw).collect()
    assert len({(r.feed_id, r.bar_s) for r in rows}) == len(rows)
    return {(r.feed_id, r.bar_s): (r.mark, None if r.value is None else round(r.value, 9)) for r in rows}


def test_random_series_equal_brute_force(spark):
    rng = random.Random(5)
    base = 1_736_000_040 // 86_400 * 86_400
    minutes = [(base + 60 * i, i % 97 < 80 and not 400 <= i < 500) for i in range(3000)] + [(None, True), (base, None)]
    sources = [(1, 60, base + 61.5, base + 150_000.25), (2, 300, base, base + 100_000), (3, 900, base + 90_000, base + 120_000), (4, None, base, base), (5, 60, base + 99, base + 99)]
    readings, i = [], 0
    for f, b in ((1, 60), (2, 300), (3, 900), (9, 60)):
        for k in range(0, 180_000, b):
            for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
                i += 1
                readings.append((i, f, rng.choice([base + k + rng.randrange(b), base + k, base + k, None] if rng.random() < 0.1 else [base + k + rng.randrange(b)]), rng.choice([None, 1.5]) if rng.random() < 0.1 else round(rng.uniform(1, 2), 5), rng.choice([None, base + rng.randrange(1000)])))
    rng.shuffle(readings)
    for chunk in (16, 4096):
        got = run(spark, readings, sources, minutes, max_gap_steps=4, chunk_steps=chunk)
        want = {k: (m, None if v is None else round(v, 9)) for k, (m, v) in brute(readings, sources, minutes, 4).items()}
        assert got == want
        assert {m for m, _ in got.values()} == {"observed", "interpolated", "missing"}


def test_empty_inputs(spark):
    day = 1_736_035_200
    src, clk = [(1, 60, day, day + 300)], [(day + 60 * i, True) for i in range(10)]
    assert run(spark, [], src, clk) == {(1, day + 60 * i): ("missing", None) for i in range(5)}
    assert run(spark, [(1, 1, day, 1, None)], [], clk) == {}
    assert run(spark, [(1, 1, day, 1, None)], src, []) == {}
    twice = run(spark, [(1, 1, day + 3, 1, None)] * 2, src * 2, clk * 2)
    assert twice[1, day] == ("observed", 1.0) and len(twice) == 5


def test_a_hot_source_is_split(spark):
    day = 1_736_035_200
    r, s, c = tables(spark, [], [(1, 60, day, day + 86_400 * 20)], [])
    clock = spark.range(20 * 1440).select(F.timestamp_seconds(F.col("id") * 60 + day).alias("minute_ts"), F.lit(True).alias("active"))
    grid = regular_grid(r, s, clock, chunk_steps=1000)
    assert grid.count() == 20 * 1440
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = regular_grid(r, s, clock, chunk_steps=1000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and max(p[1] for p in parts) < 20 * 1440 * 0.7
