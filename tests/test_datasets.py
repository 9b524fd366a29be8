from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import datasets as D
from tickloom.operators import features as X
from tickloom.operators import ledger as A
from tickloom.operators import stats as S
from tickloom.operators.events import cusum_scan
from tickloom.operators.tick_labels import tick_labels
from tickloom.operators.ticks import merged_order

Q = "quote_id long, feed_id long, seq long, source_time long, v long"


def test_range_summaries_equal_a_scan(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 2]), i % 7, rng.choice([None, rng.randrange(0, 400)]), rng.randrange(100)) for i in range(200)]
    asked = [(1000 + i, rng.choice([1, 2, 3, None]), rng.choice([None, rng.randrange(-20, 420)])) for i in range(60)]
    a = spark.createDataFrame(asked, "row_id long, feed_id long, at long")
    for chunk in (50, 10_000):
        got = {r.row_id: tuple(r)[1:] for r in D.range_summaries(a, spark.createDataFrame(rows, Q), "feed_id", "row_id", "at", 90, "source_time", "seq", "quote_id", F.col("v"), chunk).collect()}
        up = {r.row_id: r.hit_ms for r in D.first_at_or_above(a.withColumn("level", F.lit(80)), spark.createDataFrame(rows, Q), "feed_id", "row_id", "at", "level", 90, "source_time", "quote_id", F.col("v"), chunk).collect()}
        assert set(got) == {i for i, g, t in asked if g is not None and t is not None}
        for i, g, t in asked:
            if i not in got:
                continue
            inside = sorted((r[3], r[2], r[0], r[4]) for r in rows if r[1] == g and r[3] is not None and t <= r[3] < t + 90)
            v = [x[3] for x in inside]
            want = (min(v), max(v), max(max(v[: k + 1]) - v[k] for k in range(len(v))), max(v[k] - min(v[: k + 1]) for k in range(len(v))), len(v)) if v else (None, None, None, None, 0)
            assert got[i] == want
            assert up[i] == min((x[0] for x in inside if x[3] >= 80), default=None)


def test_earliest_affected_equals_a_scan(spark):
    rng = random.Random(3)
    spans = [(g, a, a + rng.randrange(1, 40)) for g in (1, 2) for a in range(0, 400, 50)]
    rows = [(i, rng.choice([1, 2]), a := rng.randrange(400), a + rng.randrange(0, 30)) for i in range(60)]
    got = {(r.g, r.a): r.i for r in D.earliest_affected(spark.createDataFrame(spans, "g long, a long, z long"), spark.createDataFrame(rows, "i long, g long, s long, e long"), "g", "s", "e", "i", 16).collect()}
    assert got == {(g, a): min(((s, i) for i, h, s, e in rows if h == g and s < e and s < z and e > a), default=(0, None))[1] for g, a, z in spans}


def test_history_is_enough(spark):
    rng = random.Random(1)
    bars = [(f, 60, 1_735_689_600 + 60 * (i + (7 if i > 300 else 0)), *[1.1 + rng.random()] * 4) for f in (1, 2) for i in range(400)]
    df = spark.createDataFrame(bars, "feed_id long, step long, b long, open double, high double, low double, close double")
    cut = 1_735_689_600 + 60 * 350
    op = lambda x: X.momentum_side(x, 20)
    got = X.from_history(X.export_history(df.where(f"b < {cut}"), 22), df.where(f"b >= {cut - 300}"), op).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op(df).where(f"b >= {cut}").collect()), key=str)


def test_quantiles_of_two_levels(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=501), np.repeat([1.0, 5.0], 50), np.append(rng.random(100), 1e9), np.array([3.0])):
        df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("h", 2.0)], "k string, v double")
        r = S.describe(df, ["k"], "v").where("k = 'g'").first()
        assert [r.q05, r.q50, r.q95] == pytest.approx(np.quantile(values, [0.05, 0.5, 0.95])) and r.n == len(values)
        t = S.tertiles(df, ["k"], "v").where("k = 'g'").first()
        assert [t.cut1, t.cut2] == list(np.quantile(values, [0.3333333333333333, 0.6666666666666666], method="inverted_cdf"))
    assert S.describe(df.limit(0), ["k"], "v").count() == 0


def test_sums_over_a_calendar(spark):
    points = [(86_400 * k + 61_200, 3 if k % 7 == 2 else 1) for k in range(10, 40) if k % 7 < 5]
    rng = random.Random(2)
    rows = [(i, a := rng.randrange(0, 50 * 86_400), a + rng.randrange(0, 9 * 86_400)) for i in range(80)] + [(90, None, 5), (91, points[0][0], points[0][0]), (92, points[0][0] - 1, points[0][0])]
    df = spark.createDataFrame(rows, "i long, a long, z long")
    got = {r.i: r.n for r in A.interval_sum(df, spark.createDataFrame(points, "at_s long, factor int"), "a", "z", "at_s", "factor", "n").collect()}
    assert got == {i: sum(f for t, f in points if (a is None or t > a) and t <= z) for i, a, z in rows}


def test_total_order_by_buckets(spark):
    rng = random.Random(9)
    a = [(1 + i % 2, i, rng.choice([None, rng.randrange(100)])) for i in range(50)]
    df = spark.createDataFrame(a, "feed_id long, ordinal long, t long")
    got = {(r.kind, r.feed_id, r.ordinal): r.place for r in merged_order([(df, "x", 1, F.col("t")), (df, "y", 0, F.col("t"))], width=7).collect()}
    for g in (1, 2):
        events = sorted(((t is not None, t or 0, p, o, k) for f, o, t in a if f == g for k, p in (("x", 1), ("y", 0))))
        assert [got[k, g, o] for *_, o, k in events] == list(range(1, len(events) + 1))


def test_cusum_kernel_equals_the_sums():
    rng = np.random.default_rng(8)
    for _ in range(50):
        x, reset = rng.normal(0, 1, 300).cumsum() / 10, rng.random(300) < 0.02
        up = down = 0.0
        want = []
        for i in range(300):
            change = x[i] - x[i - 1] if i else 0.0
            up, down = (0.0, 0.0) if reset[i] or i == 0 else (max(0, up + change), min(0, down + change))
            fired = up > 0.3 or down < -0.3
            up, down = (0.0 if up > 0.3 else up), (0.0 if down < -0.3 else down)
            want.append(fired)
        reset[0] = True
        whole, _, _ = cusum_scan(x, reset, 0.3)
        assert whole.tolist() == want
        first, lo, hi = cusum_scan(x[:120], reset[:120], 0.3)
        rest, _, _ = cusum_scan(x[120:], reset[120:], 0.3, lo, hi)
        assert first.tolist() + rest.tolist() == want


def test_tick_labels_over_days(spark):
    day = 86_400_000
    quotes = [(1, 1, 100, 1.0, 1.01), (2, 1, day + 5, 1.2, 1.21), (3, 1, 3 * day, 1.6, 1.61), (4, 2, 100, 1.0, 1.01), (5, 2, 2 * day, 0.9, 0.91), (6, 2, 2 * day + 1, 2.0, 2.01), (7, 3, 100, 1.0, 1.01), (8, 3, 4 * day + 10, 1.0, 1.01)]
    rows = [(i, f, t, True, False, b, a) for i, f, t, b, a in quotes] + [(9, 2, day + 9, False, False, 5.0, 6.0)]
    q = spark.createDataFrame(rows, "quote_id long, feed_id long, source_time long, is_valid boolean, ambiguous boolean, bid double, ask double")
    asked = [(10, 1, 0, 1, 4 * day), (11, 2, 0, 1, 4 * day), (12, 3, 0, 1, 4 * day), (13, 3, 0, -1, 5 * day), (14, 1, 200_000, 1, 4 * day), (15, 1, 0, 1, 2 * day), (16, 9, 0, 1, day), (17, 1, 0, 1, None)]
    d = spark.createDataFrame(asked, "row_id long, feed_id long, at_ms long, side int, deadline long")
    got = {r.row_id: (r.reason, r.terminal_ms) for r in tick_labels(d, q, deadline=F.col("deadline"), tp=F.lit("0.5"), sl=F.lit("0.05")).collect()}
    assert got == {
        10: ("tp", 3 * day), 11: ("censored", None), 12: ("timeout", 4 * day + 10), 13: ("timeout_unobserved", None),
        14: ("entry_expired", None), 15: ("timeout_unobserved", None), 16: ("entry_expired", None),
    }
