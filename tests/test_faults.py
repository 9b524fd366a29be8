from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import numpy as np

from tickloom.operators.faults import FaultConfig, _nearer, _side_medians, _spread, candle_readings, exact_spikes, group_readings, implausible, phase_space_outliers

UTC = dt.timezone.utc
C = "candle_id long, feed_id long, ts timestamp, open_px decimal(18,8), high_px decimal(18,8), low_px decimal(18,8), close_px decimal(18,8), tab string"
G = "group_id long, feed_id long, ts_ms long, bid_min decimal(18,8), ask_max decimal(18,8)"


def d(x):
    return None if x is None else Decimal(str(round(x, 5)))


def series(n, seed=1, level=1.2, feed=1, step=60):
    rng = random.Random(seed)
    rows, p = [], level
    for i in range(n):
        q = p + rng.gauss(0, 0.0005)
        rows.append([i, feed, 1_736_000_000 + i * step, p, max(p, q) + 0.0003 + rng.random() * 1e-4, min(p, q) - 0.0003 - rng.random() * 1e-4, q])
        p = q
    return rows


def judged(spark, candles, groups=(), cfg=FaultConfig()):
    c = spark.createDataFrame([(i, f, None if t is None else dt.datetime.fromtimestamp(t, UTC), *map(d, px), "x") for i, f, t, *px in candles], C)
    g = spark.createDataFrame([(i, f, t, d(b), d(a)) for i, f, t, b, a in groups], G)
    out = implausible(candle_readings(c).unionByName(group_readings(g)), cfg).collect()
    found = {}
    for r in out:
        assert (r.tab, r.rec_id) not in found
        found[r.tab, r.rec_id] = "".join(k for k, on in (("i", r.impossible), ("s", r.stuck), ("p", r.spike)) if on)
    return found


def test_kinds_of_faults(spark):
    rows = series(600)
    rows[50][4] += 0.05  # spike of the high
    rows[120][5] -= 0.03  # and of the low
    for i in (200, 201, 202):  # all prices a digit off for three bars
        rows[i][3:] = [x * 10 for x in rows[i][3:]]
    for r in rows[300:]:  # a lasting change of level is none
        r[3:] = [x + 0.2 for x in r[3:]]
    rows[400][4] = rows[400][3] - 0.001  # impossible
    rows[410][5] = 0.0
    top = max(r[4] for r in rows[450:479])
    for r in rows[450:460] + rows[470:479]:  # the second run is one short of stuck
        r[4] = top
    rows[599][2] = None
    want = {50: "p", 120: "p", 200: "p", 201: "p", 202: "p", 400: "i"} | {i: "s" for i in range(450, 460)}
    for cfg in (FaultConfig(), FaultConfig(chunk=40, halo=32)):
        got = judged(spark, rows, cfg=cfg)
        assert got.pop(("candles", 410)).startswith("i")
        assert {k[1]: v for k, v in got.items()} == want


def test_chunks_change_nothing(spark):
    rows = series(1500, 7) + [[5000 + i, 2, *r[2:]] for i, r in enumerate(series(700, 8, 150.0, step=3600))]
    rng = random.Random(2)
    for _ in range(40):
        r = rng.choice(rows)
        r[rng.choice([4, 5])] += rng.choice([-1, 1]) * rng.uniform(20, 60) * 0.0012
    rows += [[9000 + i, *rng.choice(rows)[1:]] for i in range(60)]  # repeated rows
    for r in rng.sample(rows, 40):
        r[rng.choice([2, 3, 4, 5, 6])] = None
    a = judged(spark, rows)
    assert a == judged(spark, rows, cfg=FaultConfig(chunk=50, halo=40)) and len(a) > 30


def test_stuck_runs_count_equal_stamps_once(spark):
    rows = series(60)
    for r in rows[10:19]:
        r[4] = 1.205
    rows.append([100, *rows[12][1:]])  # a tenth row, but a ninth stamp
    assert not any("s" in v for v in judged(spark, rows).values())
    rows[19][4] = 1.205
    rows.append([101, 1, rows[15][2], 1.2, 1.31, 1.19, 1.2])  # a revision amid the run
    assert {k[1] for k, v in judged(spark, rows).items() if "s" in v} == {*range(10, 20), 100}


def test_groups_and_degenerate_feeds(spark):
    rng = random.Random(4)
    groups, m = [], 1.1
    for i in range(300):
        m += rng.gauss(0, 2e-5)
        groups.append([i, 1, 1_736_000_000_000 + i * 900, m - 1e-4 - rng.random() * 1e-5, m + 1e-4])
    groups[40][4] += 0.02
    groups[60][3] = -1.0
    groups[80][3], groups[80][4] = groups[80][4], groups[80][3]
    for g in groups[100:120]:
        g[3], g[4] = 1.1, 1.1002
    groups += [[1000 + i, 2, 1_736_000_000_000 + i, 5.0, 5.0] for i in range(15)]  # no range at all
    groups += [[2000, 3, None, 1.0, 1.1], [2001, None, 5, 1.0, 1.1], [2002, 3, 5, None, None], [2003, 3, 6, 1.0, None]]
    got = {k[1]: v for k, v in judged(spark, [], groups).items()}
    assert got[40] == "p" and got[60].startswith("i") and got[80].startswith("i")
    assert {k for k, v in got.items() if "s" in v} == set(range(100, 120))
    assert not any(k >= 1000 for k in got)
    assert judged(spark, [], []) == {}


def test_differences_find_what_the_value_alone_does_not():
    n = 400
    level = 100 + 40 * np.sin(np.arange(n) / 12)  # swings far wider than a bar, slowly
    hi, lo = level + 0.5, level - 0.5
    hi[200] += 14
    usable = np.ones(n, bool)
    found = phase_space_outliers([hi, lo], level, usable, 1.0, FaultConfig())
    before, after = _side_medians(level, 15)
    u = _nearer(hi, before[np.arange(n)], after[np.arange(n) + 1])
    assert found[200] and abs(u[200]) < np.sqrt(2 * np.log(n)) * _spread(u, 0.0)
    assert exact_spikes([hi, lo], level, found, ~usable, ~usable, 1.0, FaultConfig()).nonzero()[0].tolist() == [200]


def test_mutual_spikes_come_to_an_end():
    rng = np.random.default_rng(4)
    for _ in range(200):
        level = rng.choice([0.0, 20.0, 40.0], 12)
        cand = rng.random(12) < 0.8
        got = exact_spikes([level], level, cand, np.zeros(12, bool), np.zeros(12, bool), 1.0, FaultConfig())
        assert not (got & ~cand).any()
