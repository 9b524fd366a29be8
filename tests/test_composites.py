from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import chunks as K
from tickloom.operators import composites as O


def test_two_level_lag_and_running_sums_equal_plain_loops(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randrange(60), i, rng.choice([None, *range(5)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, t long, i long, v long")
    seq = {g: sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]) for g in (1, 2)}
    for width in (1, 7, 1000):
        got = {r.i: r for r in K.with_previous(df, ["g"], ["t", "i"], ["i", "v"], width).collect()}
        nxt = {r.i: r for r in K.with_previous(df, ["g"], ["t", "i"], ["i"], width, ahead=True).collect()}
        for s in seq.values():
            for k, r in enumerate(s):
                p = s[k - 1] if k else (None,) * 4
                assert (got[r[2]].prev_i, got[r[2]].prev_v) == (p[2], p[3])
                assert nxt[r[2]].next_i == (s[k + 1][2] if k + 1 < len(s) else None)
        for how, f in (("sum", sum), ("max", max), ("min", min)):
            run = {r.i: r.o for r in K.with_running(df, ["g"], ["t", "i"], F.col("v"), "o", width, how=how).collect()}
            for s in seq.values():
                for k, r in enumerate(s):
                    known = [x[3] for x in s[: k + 1] if x[3] is not None]
                    assert run[r[2]] == (f(known) if known else None)
    assert K.with_previous(df.limit(0), ["g"], ["t", "i"], ["i"], 5).count() == 0


def test_top_k_breaks_ties_by_key_and_keeps_hot_groups_whole(spark):
    rows = [(1, i, float(i % 7)) for i in range(500)] + [(2, 9, None), (3, 1, 0.0)]
    df = spark.createDataFrame(rows, "g long, k long, x double")
    got = {(r.g, r.place): r.k for r in O.top_k(df, "g", F.col("x"), "k", 3).collect()}
    assert got == {(1, 1): 6, (1, 2): 13, (1, 3): 20, (3, 1): 1}


def test_sample_does_not_depend_on_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in O.hashed_sample(df, "k", 50).collect()}
    assert a == {r.k for r in O.hashed_sample(df.repartition(9).orderBy(F.desc("k")), "k", 50).collect()} and len(a) == 50
    assert a != {r.k for r in O.hashed_sample(df, "k", 50, seed="1").collect()}


def test_range_count_equals_a_scan(spark):
    rng = random.Random(2)
    pts = [(rng.choice([1, 2]), rng.randrange(100)) for _ in range(150)]
    rs = [(i, rng.choice([1, 2, 3]), a := rng.randrange(-5, 100), a + rng.randrange(0, 40)) for i in range(60)]
    out = O.range_count(spark.createDataFrame(rs, "i long, g long, a long, z long"), spark.createDataFrame(pts, "g long, t long"), "g", "a", "z", "t", 8)
    assert {r.i: r.n for r in out.collect()} == {i: sum(h == g and a <= t < z for h, t in pts) for i, g, a, z in rs}


def test_every_opening_is_kept(spark):
    rows = spark.createDataFrame([(1, 1), (2, -1), (3, None), (4, 1)], "b long, side int")
    lab = spark.createDataFrame([(1, 1, "tp"), (1, -1, "sl"), (2, -1, "sl"), (3, 1, "tp")], "b long, side int, outcome string")
    got = {r.b: r.outcome for r in O.one_sided(rows, lab, ["b"], "side", "outcome").collect()}
    assert got == {1: "tp", 2: "sl", 3: "no_primary_signal", 4: "no_primary_signal"}


def test_contrasts_are_antisymmetric(spark):
    df = spark.createDataFrame([(1, 0.2, 0.5), (1, 0.4, 0.9)], "g int, a double, b double")
    got = {(r.left, r.right): r.delta for r in O.contrasts(df, ["g"], {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got["a", "b"] == pytest.approx(-0.4) and got["b", "a"] == pytest.approx(0.4)
