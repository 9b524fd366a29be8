"""Golden rows, brute force, causality and invariance of the engine's own operators."""

from __future__ import annotations

import itertools
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import clock as C
from tickloom.operators import events as E
from tickloom.operators import features as X
from tickloom.operators import intervals as V
from tickloom.operators import ticks as K
from tickloom.operators import touch as L

BAR = "feed_id long, step long, b long, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8)"
T0 = 1_767_571_200  # a Monday, 00:00 UTC


def D(x):
    return Decimal(str(x)).quantize(Decimal("0.00001"))


def bar(i, open_=1.1, high=1.101, low=1.099, close=1.1, step=60):
    return (1, step, T0 + i * step, D(open_), D(high), D(low), D(close))


def label(spark, rows, horizon=4320, tp="0.0050", sl="0.0020"):
    df = spark.createDataFrame(rows, BAR)
    out = L.contiguous_labels(df, tp=F.lit(tp).cast("decimal(18,8)"), sl=F.lit(sl).cast("decimal(18,8)"), horizon_bars=horizon).collect()
    return {(r.b, r.side): r for r in out}


@pytest.mark.parametrize(
    "rows,side,outcome,pips,end",
    [
        ([bar(0, high=1.105)], 1, "take_profit", 50, 60),
        ([bar(0, high=1.105)], -1, "stop_loss", -20, 60),
        ([bar(0, low=1.095)], -1, "take_profit", 50, 60),
        ([bar(0, low=1.098), bar(1, high=1.105)], 1, "stop_loss", -20, 60),
        ([bar(0, high=1.105, low=1.098)], 1, "ambiguous", None, 60),
        ([bar(0), bar(1, open_=1.097, low=1.097)], 1, "stop_loss", -30, 60),
        ([bar(0), bar(1, open_=1.106, high=1.106, low=1.097)], 1, "take_profit", 50, 60),
    ],
)
def test_outcomes_on_the_first_touched_bar(spark, rows, side, outcome, pips, end):
    r = label(spark, rows)[T0, side]
    assert (r.outcome, r.end_s) == (outcome, T0 + end)
    assert r.exit_i is None if pips is None else side * (r.exit_i - r.entry_i) == pips * 10_000


def test_hold_limits(spark):
    assert label(spark, [bar(0), bar(1)], 2)[T0, 1].outcome == "timeout"
    assert label(spark, [bar(0), bar(1, high=1.105)], 2)[T0, 1].outcome == "boundary"
    assert label(spark, [bar(0)], 2)[T0, 1].outcome == "censored"
    assert label(spark, [bar(0), bar(2)], 2)[T0, 1].outcome == "censored"


def test_hold_is_72_hours_on_every_scale(spark):
    d = lambda x: F.lit(x).cast("decimal(18,8)")
    m1 = [bar(i) for i in range(4319)] + [bar(4319, high=1.106)]
    h1 = [bar(i, step=3600) for i in range(72)] + [bar(72, high=1.106, step=3600)]
    for rows, want in ((m1[:4319] + [bar(4319)], ("timeout", 259_200)), (m1, ("boundary", 259_200)), (m1[1000:], ("take_profit", 259_200)), (h1, ("timeout", 259_200))):
        out = L.contiguous_labels(spark.createDataFrame(rows, BAR), tp=d("0.0050"), sl=d("0.0020")).where("side = 1").orderBy("b").first()
        assert (out.outcome, out.end_s - T0) == want
    stopped = [bar(0, low=1.098), *[bar(i) for i in range(1, 4318)], bar(4318, high=1.106), bar(4319)]
    out = L.contiguous_labels(spark.createDataFrame(stopped, BAR), tp=d("0.0050"), sl=d("0.0020")).where("side = 1").orderBy("b").first()
    assert (out.outcome, out.post_status, out.post_s) == ("stop_loss", "reached", T0 + 4319 * 60)


def test_target_after_the_stop(spark):
    r = label(spark, [bar(0, low=1.098), bar(1, high=1.105)], 10)[T0, 1]
    assert (r.post_status, r.post_s) == ("reached", T0 + 120)
    assert label(spark, [bar(0, low=1.098)] + [bar(i) for i in range(1, 3)], 3)[T0, 1].post_status == "not_reached"
    assert label(spark, [bar(0, low=1.098), bar(1)], 3)[T0, 1].post_status == "censored"
    assert label(spark, [bar(0, low=1.098), bar(1), bar(2, high=1.105)], 3)[T0, 1].post_status == "boundary"


def scan(rows, i, side, horizon, tp, sl):
    o = rows[i][3]
    target, stop = o + side * tp, o - side * sl
    deadline, expected = rows[i][2] + horizon * rows[i][1], rows[i][2]
    end, outcome, price = rows[i][2], "censored", None
    for r in rows[i:]:
        if r[2] != expected:
            break
        end = expected = r[2] + r[1]
        if side * (r[3] - stop) <= 0:
            return "stop_loss", r[2], r[3]
        if side * (r[3] - target) >= 0:
            return "take_profit", r[2], target
        t, s = (r[4] >= target, r[5] <= stop) if side > 0 else (r[5] <= target, r[4] >= stop)
        if t and s:
            return "ambiguous", end, None
        if s:
            return "stop_loss", end, stop
        if t:
            return ("take_profit" if end < deadline else "boundary"), end, target
        if end >= deadline:
            return "timeout", end, r[6]
    return outcome, end, price


def test_random_paths_equal_a_scan(spark):
    rng = random.Random(42)
    for horizon, tp, sl in ((1, "0.0005", "0.0002"), (30, "0.0010", "0.0020"), (200, "0.0050", "0.0020")):
        rows, p, i = [], 1.1, 0
        for _ in range(300):
            i += 1 if rng.random() > 0.03 else 5
            q = p + rng.gauss(0, 0.0004)
            rows.append(bar(i, p, max(p, q) + rng.random() * 3e-4, min(p, q) - rng.random() * 3e-4, q))
            p = q + rng.choice([0, 0, 0, 0.0008])
        got = label(spark, rows, horizon, tp, sl)
        for k in range(len(rows)):
            for side in (1, -1):
                r = got[rows[k][2], side]
                want = scan(rows, k, side, horizon, Decimal(tp), Decimal(sl))
                price = None if r.exit_i is None else Decimal(r.exit_i) / 10**8
                assert (r.outcome, r.end_s, price) == (want[0], want[1], want[2]), (k, side)


def test_chunks_of_time_change_no_label(spark):
    rng = random.Random(1)
    rows = [bar(i, 1.1 + rng.gauss(0, 1e-3), 1.104, 1.096, 1.1) for i in range(400)]
    df = spark.createDataFrame(rows, BAR)
    f = lambda n: sorted(map(tuple, L.first_touch(df, tp=F.lit("0.003").cast("decimal(18,8)"), sl=F.lit("0.003").cast("decimal(18,8)"), horizon_s=F.lit(3600), deadline=F.col("b") + 3600, censor=F.lit(T0 + 400 * 60), chunk_steps=n).collect()), key=repr)
    assert f(16) == f(8192)


def test_touch_index_equals_a_loop():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 200):
        h = rng.integers(0, 50, n)
        lo = h - rng.integers(0, 10, n)
        start, stop = rng.integers(0, n, 80), rng.integers(0, n + 1, 80)
        stop = np.maximum(start, stop)
        up, down = rng.integers(20, 60, 80), rng.integers(-20, 10, 80)
        want = [next((j for j in range(a, z) if h[j] >= u or lo[j] <= d), z) for a, z, u, d in zip(start, stop, up, down)]
        assert list(L.TouchIndex(h, lo).first(start, stop, up, down)) == want


# --- clock -----------------------------------------------------------------------------------------


def test_weekly_rule_over_daylight_saving(spark):
    import datetime as dt

    s = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())
    for shut, opens in ((s(2023, 3, 10, 22), s(2023, 3, 12, 21)), (s(2023, 11, 3, 21), s(2023, 11, 5, 22))):
        clock = C.weekly_clock(spark, shut - 7200, opens + 7200)
        rows = {r.m: r for r in C.coordinates(clock).collect()}
        assert rows[shut - 60].active and not rows[shut].active and not rows[opens - 60].active and rows[opens].active
        one = spark.createDataFrame([(shut - 60,)], "a long")
        coords = C.coordinates(clock)
        assert C.deadlines(one, coords, "a", 1).first().deadline_s == shut  # Friday's close, not Sunday's opening
        assert C.deadlines(one, coords, "a", 2).first().deadline_s == opens + 60
        two = spark.createDataFrame([(shut - 60, opens + 60)], "a long, z long")
        assert C.elapsed(two, coords, "a", "z").first().open_min == 2


def test_milliseconds_and_their_inverse(spark):
    minutes = [(T0 + 60 * i, not 30 <= i < 50) for i in range(80)]
    clock = spark.createDataFrame(minutes, "m long, active boolean").select(F.timestamp_seconds("m").alias("minute_ts"), "active")
    rows = spark.createDataFrame([(i, (T0 + 60 * 10) * 1000 + i * 77_777) for i in range(30)], "row_id long, t long")
    got = C.coordinate_ms(rows, clock, "t").collect()
    for r in got:
        x = r.t - T0 * 1000
        want = min(x, 1_800_000) + max(0, x - 3_000_000)
        assert r.open_ms == want and r.is_open == (x < 1_800_000 or x >= 3_000_000)
        assert r.next_open_ms == (r.t if r.is_open else (T0 + 3000) * 1000)
    for r in C.advance_ms(rows, clock, "t", 600_001).collect():
        x = r.t - T0 * 1000
        target = min(x, 1_800_000) + max(0, x - 3_000_000) + 600_001
        assert r.deadline_ms == T0 * 1000 + (target if target <= 1_800_000 else target + 1_200_000)


# --- features and events ---------------------------------------------------------------------------


def walk(n, seed=0, feed=1, gap_at=()):
    rng = random.Random(seed)
    rows, p, i = [], 1.2, 0
    for k in range(n):
        i += 7 if k in gap_at else 1
        q = p * math.exp(rng.gauss(0, 4e-4))
        rows.append((feed, 60, T0 + i * 60, D(p), D(max(p, q) + 1e-4), D(min(p, q) - 1e-4), D(q)))
        p = q
    return rows


def test_no_feature_sees_its_own_bar_or_later(spark):
    rows = walk(600, 3, gap_at={300})
    cut = 450
    changed = rows[:cut] + [(f, s, b, o + 1, h + 1, lo + 1, c + 1) for f, s, b, o, h, lo, c in rows[cut:]]
    run = lambda r, f: {x.b: tuple(x) for x in f(spark.createDataFrame(r, BAR)).collect()}
    for f in (X.past_features, X.momentum_side, lambda d: X.fractional_difference(d, 0.4, 1e-2)):
        a, z = run(rows, f), run(changed, f)
        until = rows[cut][2]
        assert all(a[b] == z[b] for b in a if b <= until)
        assert any(a[b] != z[b] for b in a if b > until)


def test_features_of_one_row_by_hand(spark):
    rows = walk(300, 5)
    got = {r.b: r for r in X.past_features(spark.createDataFrame(rows, BAR)).collect()}
    i = 280
    c = [float(r[6]) for r in rows]
    ret = [0.0] + [math.log(c[k] / c[k - 1]) for k in range(1, len(c))]
    r = got[rows[i][2]]
    assert r.valid and not got[rows[100][2]].valid
    for n in (5, 15, 60, 240):
        w = ret[i - n : i]
        assert r[f"ret_{n}"] == pytest.approx(sum(w))
        assert r[f"vol_{n}"] == pytest.approx(np.std(w), rel=1e-6)
        assert r[f"eff_{n}"] == pytest.approx(abs(sum(w)) / sum(map(abs, w)))
        assert r[f"z_{n}"] == pytest.approx((c[i - 1] - np.mean(c[i - n : i])) / max(np.std(c[i - n : i]), 1e-5), rel=1e-5)


def test_fractional_weights():
    w = X.fractional_weights(0.5, 1e-4)
    assert w[:3] == [1.0, -0.5, -0.125] and abs(w[-1]) >= 1e-4
    assert X.fractional_weights(1.0) == [1.0, -1.0]


def test_cusum_cases(spark):
    p = [1, 2, 4, 4, 128, 128]
    rows = [(1, 60, T0 + 60 * i, D(x), D(x), D(x), D(x)) for i, x in enumerate(p)]
    got = {r.b: r for r in E.cusum_events(spark.createDataFrame(rows, BAR), math.log(2)).collect()}
    assert [i for i in range(6) if got[T0 + 60 * i].event] == [2, 4]
    assert [i for i in range(6) if got[T0 + 60 * i].entry] == [3, 5]
    gap = [r if i < 2 else (*r[:2], r[2] + 600, *r[3:]) for i, r in enumerate(rows)]
    got = {r.b: r for r in E.cusum_events(spark.createDataFrame(gap, BAR), math.log(2)).collect()}
    assert [r[2] for r in gap if got[r[2]].event] == [gap[4][2]]


# --- overlap ---------------------------------------------------------------------------------------

FIVE = [(0, 3), (2, 4), (4, 6), (0, 10), (0, 10), (3, 7), (6, 12), (10, 15), (14, 20), (20, 25), (25, 30), (0, 30)]


def test_uniqueness_equals_counting(spark):
    df = spark.createDataFrame([(i, 1, a, z) for i, (a, z) in enumerate(FIVE)], "k long, g long, a long, z long")
    got = {r.k: r for r in V.uniqueness(df, "k", "g", "a", "z").collect()}
    n = [sum(a <= t < z for a, z in FIVE) for t in range(30)]
    raw = [sum(1 / n[t] for t in range(a, z)) / (z - a) for a, z in FIVE]
    for i, x in enumerate(raw):
        assert got[i].raw == pytest.approx(x) and got[i].weight == pytest.approx(x / np.mean(raw))
    c = V.concurrency(df, "g", "a", "z").first()
    assert c.most == max(n) and c.active_mean == pytest.approx(np.mean(n))


def test_schedules_equal_all_subsets(spark):
    rng = random.Random(2)
    for case in range(6):
        iv = [(i, 1, a := rng.randrange(12), a + rng.randrange(1, 6), rng.randrange(1, 60)) for i in range(9)]
        df = spark.createDataFrame(iv, "k long, g long, a long, z long, v long")
        fits = [s for n in range(10) for s in itertools.combinations(iv, n) if all(x[3] <= y[2] or y[3] <= x[2] for x, y in itertools.combinations(s, 2))]
        best = max((sum(x[4] for x in s), -sum(x[3] - x[2] for x in s)) for s in fits)
        got = {r.k for r in V.weighted_schedule(df, "k", "g", "a", "z", "v").collect()}
        chosen = [x for x in iv if x[0] in got]
        assert (sum(x[4] for x in chosen), -sum(x[3] - x[2] for x in chosen)) == best and tuple(chosen) in fits
        assert V.greedy_schedule(df, "k", "g", "a", "z").count() == max(map(len, fits))


def test_asof_lookups_equal_a_scan(spark):
    rng = random.Random(8)
    left = [(i, rng.choice([1, 2, 3]), rng.randrange(-50, 400)) for i in range(120)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(-40, 380)])) for _ in range(150)]
    ldf = spark.createDataFrame(left, "k long, g long, t long")
    rdf = spark.createDataFrame(right, "g long, s long").withColumn("at", F.col("s"))
    for width in (10, 1000):
        for strict in (False, True):
            for f, ok, pick in ((V.asof_backward, lambda s, t: s < t if strict else s <= t, max), (V.asof_forward, lambda s, t: s > t if strict else s >= t, min)):
                got = {r.k: r["at"] for r in f(ldf, rdf, "g", "t", "s", ["at"], width, strict=strict).collect()}
                want = {k: pick((s for h, s in right if h == g and s is not None and ok(s, t)), default=None) for k, g, t in left}
                assert got == want


def test_marks_combine_over_chunks(spark):
    rng = random.Random(3)
    v = [rng.randrange(1000) for _ in range(97)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "g long, i long, v long")
    for size in (1, 3, 16, 1024):
        r = V.ordered_marks(df, "g", ["i"], F.col("v"), F.floor(F.col("i") / size)).first()
        drop = max(max(v[: j + 1]) - v[j] for j in range(len(v)))
        rise = max(v[j] - min(v[: j + 1]) for j in range(len(v)))
        assert (r.low, r.high, r.max_drop, r.max_rise, r.n) == (min(v), max(v), drop, rise, len(v))


# --- ticks -----------------------------------------------------------------------------------------


def test_late_rows_are_kept_and_flagged(spark):
    rows = [(i, 1, i, t) for i, t in enumerate([100, 99, None, 100, 101, 50])]
    df = spark.createDataFrame(rows, "quote_id long, feed_id long, seq long, source_time long")
    for width in (1, 2, 4096):
        got = sorted((r.quote_id, r.available_ms, r.late) for r in K.highwater(df, width=width).collect())
        assert got == [(0, 100, False), (1, 100, True), (2, 100, False), (3, 100, False), (4, 101, False), (5, 101, True)]


def test_volatility_queries_have_the_whole_history_and_horizon(spark, monkeypatch):
    from tickloom.plans import market

    d = "/root/testdata/sf0.01"
    v = market.ew_volatility(spark, d)
    assert v.where("valid and returns < 100").count() == 0
    asked, rows = {}, market._session_rows
    monkeypatch.setattr(market, "_session_rows", lambda s, d, horizon=4320: asked.update(h=horizon) or rows(s, d, horizon))
    monkeypatch.setattr(market.L, "session_labels", lambda r, **k: asked.update(k) or r.selectExpr("feed_id", "1 side", "'' outcome"))
    market.volatility_labels(spark, d)
    assert (asked["h"], asked["longest_s"]) == (4320, 10 * 86_400)


def test_fractional_difference_keeps_its_long_memory(spark):
    n = len(X.fractional_weights(0.5, 1e-4))
    got = X.fractional_difference(spark.createDataFrame([bar(i, close=1.1 + i % 7 / 1000, high=1.2) for i in range(n + 5)], BAR))
    assert [r.b for r in got.where("valid").orderBy("b").collect()] == [T0 + i * 60 for i in range(n, n + 5)]
