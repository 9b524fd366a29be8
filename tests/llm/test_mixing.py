from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.mixing import mix, shares, water_fill
from tickloom.llm.tokens import count_tokens

T = "source string, target_share double, max_repeats int, text string"


def test_clamped_sources_leave_their_share():
    plan = {a.source: a.allotted for a in water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, {"a": 2, "b": 1, "c": 1}, 200)}
    assert plan == {"a": 20, "b": pytest.approx(108), "c": pytest.approx(72)}


def test_default_total_reaches_the_targets():
    plan = {a.source: a.allotted for a in water_fill({"a": 0.5, "b": 0.4, "none": 0.1}, {"a": 100, "b": 1000}, {"a": 3, "b": 1, "none": 5}, None)}
    assert plan["a"] == pytest.approx(300) and plan["b"] == pytest.approx(240) and plan["none"] == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0.01, 1), st.integers(0, 500), st.integers(0, 4)), min_size=1), st.floats(1, 3000))
def test_water_filling_is_feasible_and_fair(sources, total):
    w, n, c = ({s: v[i] for s, v in sources.items()} for i in range(3))
    plan = {a.source: a.allotted for a in water_fill(w, n, c, total)}
    caps = {s: n[s] * c[s] for s in w}
    assert all(plan[s] <= caps[s] + 1e-6 for s in w)
    assert sum(plan.values()) == pytest.approx(min(total, sum(caps.values())), abs=1e-6)
    free = [plan[s] / w[s] for s in w if plan[s] < caps[s] - 1e-6]
    if free:  # sources below their cap have one ratio, and clamped ones no higher one
        assert max(free) == pytest.approx(min(free))
        assert all(plan[s] / w[s] <= free[0] + 1e-6 for s in w)


def test_mixture(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7), "big" if i % 10 else "small") for i in range(400)]
    rows += [(1000, None, "big"), (1001, "", "small"), (1002, "x", None), (1003, "x", "unlisted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame(
        [("big", 0.6, 1, "c"), ("small", 0.3, 4, "c"), ("absent", 0.1, 2, "c"), ("small", 0.3, 4, "c"), (None, 0.5, 1, "c")], T
    )
    got = mix(docs, targets, buckets=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(5), targets, buckets=16).collect()))
    sizes = {i: n for (i, _, _), n in zip(rows, count_tokens([t for _, t, _ in rows]))}
    cap = {"big": 1, "small": 4}
    assert all(0 < r.copies <= cap[r.source] and r.n_tokens == sizes[r.doc_id] for r in got)
    assert len({r.doc_id for r in got}) == len(got) and all(r.doc_id < 1000 for r in got)
    total = sum(r.n_tokens * r.copies for r in got)
    small = sum(r.n_tokens * r.copies for r in got if r.source == "small") / total
    assert small == pytest.approx(1 / 3, abs=0.01)
    table = {r.source: r for r in shares(mix(docs, targets.dropDuplicates(["source"]), buckets=16), targets.dropDuplicates(["source"])).collect()}
    assert table["absent"].tokens == 0 and table["small"].reached_share == pytest.approx(small)
    full = {r.source: r for r in shares(mix(docs, targets.dropDuplicates(["source"]), buckets=16, total_tokens="all"), targets.dropDuplicates(["source"])).collect()}
    have = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in ("big", "small")}
    assert full["small"].tokens == pytest.approx(min(4 * have["small"], sum(have.values()) / 3), abs=50) and full["small"].most_copies <= 4
    other = mix(docs, targets, buckets=16, seed=5).collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in got}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 2, "")], T)
    assert mix(docs.limit(0), targets).count() == 0
    assert mix(docs, targets.limit(0)).count() == 0
    assert [r.copies for r in mix(docs, targets).collect()] == [2]
