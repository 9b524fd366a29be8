from __future__ import annotations

import random

from pyspark.sql import functions as F

from tickloom.llm.nearest import nearest_in_time

L, R = "row_id long, feed_id long, t long, extra string", "quote_id long, feed_id long, s long, extra string"
NAMES = dict(left_id="row_id", right_id="quote_id", entity="feed_id", left_time="t", right_time="s")


def run(spark, left, right, tolerance):
    df = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), tolerance=tolerance, **NAMES)
    assert df.columns == ["row_id", "quote_id", "gap"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute(left, right, tolerance):
    out = []
    for i, f, t, _ in left:
        near = [(abs(s - t), s, q) for q, g, s, _ in right if None not in (q, g, s, f, t) and g == f and abs(s - t) <= tolerance]
        best = min(near, default=None)
        out.append((i, best[2] if best else None, best[1] - t if best else None))
    return sorted(out, key=repr)


def test_random_tables_equal_brute_force(spark):
    rng = random.Random(3)
    pick = lambda xs: rng.choice(xs)
    for tolerance in (1, 7, 30):
        left = [(i, pick([1, 1, 1, 2, 3, None]), pick([None, *range(-50, 400)]), "a") for i in range(300)]
        right = [(1000 + i, pick([1, 1, 1, 2, None]), pick([None, *range(-50, 400)]), "b") for i in range(200)]
        left += left[:5]  # repeated rows come out as often
        assert run(spark, left, right, tolerance) == brute(left, right, tolerance)


def test_bounds_and_ties(spark):
    left = [(1, 1, 100, None), (2, 1, 200, None), (3, 1, 300, None)]
    right = [(11, 1, 130, None), (12, 1, 190, None), (13, 1, 210, None), (15, 1, 300, None), (14, 1, 300, None)]
    assert run(spark, left, right, 30) == [(1, 11, 30), (2, 12, -10), (3, 14, 0)]
    assert run(spark, left, right, 29)[0] == (1, None, None)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1, None)], 5) == []
    assert run(spark, [(1, 1, 1, None)], [], 5) == [(1, None, None)]


def test_one_hot_entity_makes_no_pairs(spark):
    n = 20_000
    left = spark.range(n).select(F.col("id").alias("row_id"), F.lit(1).alias("feed_id"), (F.col("id") % 50).alias("t"))
    right = spark.range(n).select(F.col("id").alias("quote_id"), F.lit(1).alias("feed_id"), (F.col("id") % 40).alias("s"))
    df = nearest_in_time(left, right, tolerance=30, **NAMES)
    assert df.count() == n and df.where("quote_id is null").count() == 0
    assert df.where("gap = 0 and quote_id >= 40").count() == 0
