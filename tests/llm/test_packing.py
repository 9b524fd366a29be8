from __future__ import annotations

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.packing import BestFit, fill_report, pack
from tickloom.llm.tokens import count_tokens, encoder


def slow_best_fit(sizes, capacity, open_bins):
    """The same rule with plain lists: (free, order) of open bins."""
    bins, out, nxt, age = [], [], 0, 0
    for s in sizes:
        fit = [b for b in bins if b[0] >= s]
        if fit:
            b = min(fit, key=lambda x: (x[0], x[2]))
            bins.remove(b)
        else:
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda x: (x[0], x[2])))
            b, nxt = (capacity, nxt, 0), nxt + 1
        out.append(b[1])
        age += 1
        if b[0] > s:
            bins.append((b[0] - s, b[1], age))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_best_fit_equals_plain_lists(sizes, open_bins):
    fit = BestFit(20, open_bins)
    assert [fit.place(s) for s in sizes] == slow_best_fit(sizes, 20, open_bins)


def test_rows(spark):
    texts = ["a b c", "", None, "word " * 30, "x", "x", "y z " * 3] * 4
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, container_kind string")
    kinds = spark.createDataFrame([("small", 8), ("large", 64), ("none", 0), (None, 5), ("small", 8), ("odd", None)], "container_kind string, capacity_tokens int")
    placed = pack(docs, kinds, open_bins=3)
    rows = placed.collect()
    sizes = dict(enumerate(count_tokens(texts)))
    for kind, cap in (("small", 8), ("large", 64)):
        used, got = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.container_kind == kind:
                used[r.container_id] += r.n_tokens
                got[r.doc_id].append((r.piece, r.from_token, r.n_tokens))
        assert max(used.values()) <= cap
        assert set(got) == {i for i, n in sizes.items() if n}
        for i, parts in got.items():
            parts.sort()
            assert sum(p[2] for p in parts) == sizes[i]
            assert len(parts) == -(-sizes[i] // cap)  # split only beyond the capacity
            assert [p[1] for p in parts] == [k * cap for k in range(len(parts))]
    assert {r.container_kind for r in rows} == {"small", "large"}
    report = {r.container_kind: r for r in fill_report(placed).collect()}
    assert report["large"].tokens == sum(sizes.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    kinds = spark.createDataFrame([("small", 8)], "container_kind string, capacity_tokens int")
    assert pack(docs, kinds).count() == 0
    one = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    assert pack(one, kinds).count() == 1
    assert pack(one, kinds.limit(0)).count() == 0


def test_very_long_runs_are_counted():
    import regex

    from tickloom.llm.tokens import PATTERN

    enc = encoder()
    pieces = lambda s: sum(len(enc._encode_single_piece(m.group(0))) for m in regex.finditer(PATTERN, s))
    for s in ("def f(x):\n\treturn x  # ü\n\n\n  y" * 50, "a" * 3000 + "\n" * 2000 + "  b", "x=1;\r\n" * 300):
        assert count_tokens([s]) == [pieces(s)] == [len(enc.encode_ordinary(s))]
    # 499,999 single blanks and " word"; pairs of newlines
    assert count_tokens([" " * 500_000 + "word", "\n" * 400_000]) == [500_000, 200_000]


def test_tokens_round_trip():
    enc = encoder()
    for s in ("def f(x):\n\treturn x  # ü <|endoftext|>", "  \n\n x", "漢字 and 'll"):
        assert enc.decode(enc.encode_ordinary(s)) == s
    assert count_tokens([None, "", "a"]) == [0, 0, 1]
