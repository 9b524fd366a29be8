from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from tickloom.operators.periods import merged_periods
from tickloom.operators.rolling import idle_days, trailing_totals

UTC = dt.timezone.utc


def merge(rows):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((s, e) for b, s, e in rows if b == k and s is not None and e is not None and e > s)
        done = []
        for s, e in iv:
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out |= {(k, "period", s, e): 1 for s, e in done} | {(k, "gap", a[1], b[0]): 1 for a, b in zip(done, done[1:])}
    return Counter(out)


def periods(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "book_id long, a long, b long, kind string")
    return Counter(tuple(r) for r in merged_periods(df, entity="book_id", start="a", end="b", **kw).collect())


def test_random_intervals_equal_a_plain_merge(spark):
    rng = random.Random(9)
    for span, length in ((2000, 4), (2000, 60), (500, 300)):
        rows = [(rng.choice([1, 1, 1, 2, 3, None]), s := rng.randrange(-span, span), s + rng.randrange(-2, length)) for _ in range(800)]
        rows += [(4, -span, span), (1, None, 5), (1, 5, None)] + rows[:20]
        for slot, fanout, levels in ((10, 4, 2), (7, 3, 3), (86_400, 32, 2), (5, 2, 1)):
            assert periods(spark, rows, slot=slot, fanout=fanout, levels=levels) == merge(rows)


def test_touching_nested_and_distant(spark):
    rows = [(1, 0, 10), (1, 10, 12), (1, 13, 14), (1, 2, 3), (1, 500, 501), (2, 5, 5)]
    assert periods(spark, rows, slot=4, fanout=2) == Counter(
        [(1, "period", 0, 12), (1, "gap", 12, 13), (1, "period", 13, 14), (1, "gap", 14, 500), (1, "period", 500, 501)]
    )
    assert periods(spark, [(1, 0, 10)][:0]) == Counter()


def test_touching_intervals_stay_apart_if_asked(spark):
    rng = random.Random(4)
    rows = [(1, s := rng.randrange(300), s + rng.randrange(1, 9)) for _ in range(90)]
    got = periods(spark, rows, slot=7, fanout=3, touching=False)
    done = []
    for s, e in sorted((s, e) for _, s, e in rows):
        if done and s < done[-1][1]:
            done[-1][1] = max(done[-1][1], e)
        else:
            done.append([s, e])
    assert {k[2:] for k in got if k[1] == "period"} == set(map(tuple, done)) and len(done) > 5


def test_rolling(spark):
    day = 86_400
    base = 20_000 * day
    rng = random.Random(1)
    feeds = [(1, base + 3600, base + 40 * day), (2, base + day - 1, base + day + 1), (3, None, base), (4, base, base)]
    reads = [(rng.choice([1, 1, 2, 9, None]), rng.choice([None, base + rng.randrange(-40 * day, 45 * day)]), rng.choice([None, 1.0, 2.5, 4.0])) for _ in range(160)]
    at = lambda s: None if s is None else dt.datetime.fromtimestamp(s, UTC)
    r = spark.createDataFrame([(f, at(t), v, 1) for f, t, v in reads], "feed_id long, ts timestamp, close_px double, n_1d int")
    e = spark.createDataFrame([(f, at(a), at(z), 1) for f, a, z in feeds], "feed_id long, first_ts timestamp, last_ts timestamp, n_1d int")
    totals = trailing_totals(r, e)
    got = {(x.feed_id, x.day_s): x for x in totals.collect()}
    want = {(1, base + k * day) for k in range(40)} | {(2, base), (2, base + day)}
    assert set(got) == want
    idle = set()
    for f, s in want:
        vals = {k: [v for g, t, v in reads if g == f and t is not None and v is not None and s - (k - 1) * day <= t < s + day] for k in (1, 7, 30)}
        x = got[f, s]
        assert (x.n_1d, x.n_7d, x.n_30d) == tuple(len(vals[k]) for k in (1, 7, 30))
        assert x.sum_30d == (sum(vals[30]) if vals[30] else None)
        assert x.mean_7d == (sum(vals[7]) / len(vals[7]) if vals[7] else None)
        if not vals[1] and vals[7]:
            idle.add((f, s))
    assert {tuple(x) for x in idle_days(totals).collect()} == idle and idle
    assert trailing_totals(r.limit(0), e).where("n_30d > 0 or sum_7d is not null").count() == 0
    assert trailing_totals(r, e.limit(0)).count() == 0
