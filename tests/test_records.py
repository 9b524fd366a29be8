from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest

from tickloom.sources.records import RESUME, read_candle_lines, record_ends, structural_index

HEAD6, HEAD5 = "timestamp,open,high,low,close,volume", '"timestamp","open","high","low","close"'
GOOD = "2025-03-07 10:58:00+00:00,1.3,1.5,1.2,1.4,3"
CASES = [
    (GOOD, None),
    (GOOD + "\r", None),
    ('"2025-03-07T10:58:00Z"," 1.3","1.5 ",1.2,1.4,""', None),
    ("2024-02-29T23:59:59Z, 1 ,1,1,1,", None),
    (HEAD6, "header"),
    ('"timestamp","open","high","low","close","volume"', "header"),
    ("timestamp,open,high,low,close", "column_count"),
    ("", "column_count"),
    ("\r", "column_count"),
    (None, "column_count"),
    ("EOF", "column_count"),
    (GOOD + ",", "column_count"),
    ("2025-02-29 10:58:00Z,1.3,1.5,1.2,1.4,3", "bad_timestamp"),
    ("2025-03-07 24:00:00Z,1.3,1.5,1.2,1.4,3", "bad_timestamp"),
    ("2025-03-07 10:58:00,1.3,1.5,1.2,1.4,3", "bad_timestamp"),
    ("2025-03-07 10:58:00+01:00,1.3,1.5,1.2,1.4,3", "bad_timestamp"),
    ("2025-03-07  10:58:00Z,1.3,1.5,1.2,1.4,3", "bad_timestamp"),
    ("2025-03-07 10:58:00Z,1e0,1.5,1.2,1.4,3", "bad_open"),
    ("2025-03-07 10:58:00Z,1.,1.5,1.2,1.4,3", "bad_open"),
    ("2025-03-07 10:58:00Z,.5,1.5,.2,1.4,3", "bad_low"),
    ("2025-03-07 10:58:00Z,1.3,1..5,1.2,1.4,3", "bad_high"),
    ("2025-03-07 10:58:00Z,1.3,1.5,1.2,-1.4,3", "bad_close"),
    ("2025-03-07 10:58:00Z,1.3,1.5,0.0,1.4,3", "not_positive"),
    ("2025-03-07 10:58:00Z,1.3,1.35,1.2,1.4,3", "price_order"),
    ("2025-03-07 10:58:00Z,1.3,1.5,1.31,1.4,3", "price_order"),
    ("2025-03-07 10:58:00Z,1.3,1.5,1.2,1.4,n/a", "bad_volume"),
    ('2025-03-07 10:58:00Z,"1.3,1.5,1.2,1.4,3', "open_quote"),
    ('2025-03-07 10:58:00Z,1.3",1.5,1.2,"1.4,3', "stray_quote"),
    ('2025-03-07 10:58:00Z,1"3",1.5,1.2,1.4,3', "stray_quote"),
    ('2025-03-07 10:58:00Z,""1.3"",1.5,1.2,1.4,3', "stray_quote"),
    ('"2025-03-07 10:58:00Z,1.3",1.5,1.2,1.4,3,4', "bad_timestamp"),
    ("2025-03-07 10:58:00Z,1.3,1.5,1.2,1.4," + "9" * 60_000, "out_of_range"),
    ("ü" * 50_000, "column_count"),
]


def lines(spark, rows):
    return spark.createDataFrame(rows, "line_id long, file_name string, line_no int, raw string, kind string")


def test_cases(spark):
    rows = [(1, "a", 1, "﻿" + HEAD6, "x")] + [(i + 2, "a", i + 2, raw, "x") for i, (raw, _) in enumerate(CASES)]
    got = {r.line_id: r for r in read_candle_lines(lines(spark, rows)).collect()}
    assert got[1].kind == "header" and len(got) == len(rows)
    for i, (raw, want) in enumerate(CASES):
        r = got[i + 2]
        if want is None:
            assert (r.kind, r.reasons) == ("candle", []), raw
        elif want == "header":
            assert r.kind == "header"
        else:
            assert r.kind == "reject" and want in r.reasons, (raw, r.reasons)
            assert r.ts is None and r.open is None and r.raw == raw
    assert got[2].open == Decimal("1.3") and got[2].ts.hour == 10 and got[2].volume == 3 and got[4].volume is None


def test_files_without_a_header_and_narrow_files(spark):
    rows = [(1, "n", 1, HEAD5, ""), (2, "n", 2, GOOD, ""), (3, "n", 3, GOOD.rpartition(",")[0], ""), (4, "none", 7, GOOD, ""), (5, None, None, GOOD, ""), (5, None, None, GOOD, "")]
    rows += [(6, "n", 4, "timestamp,open,high,low,close", ""), (7, "none", 8, "1,2,3", "")]
    got = sorted((r.line_id, r.kind) for r in read_candle_lines(lines(spark, rows)).collect())
    assert got == [(1, "header"), (2, "reject"), (3, "candle"), (4, "candle"), (5, "candle"), (5, "candle"), (6, "header"), (7, "reject")]
    assert read_candle_lines(lines(spark, rows).limit(0)).count() == 0


def plain_fields(line):
    out, cur, inside = [], "", False
    for ch in line:
        inside ^= ch == '"'
        if ch == "," and not inside:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def test_structural_index_equals_a_scan_by_hand():
    rng = random.Random(1)
    texts = ["".join(rng.choice('ab,"',) for _ in range(rng.randrange(12))) for _ in range(500)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    a, b, of, odd = structural_index(buf, starts, ends)
    got = [[] for _ in texts]
    for x, y, r in zip(a, b, of):
        got[r].append(bytes(buf[x:y]).decode())
    assert got == [plain_fields(t) for t in texts]
    assert list(odd) == [t.count('"') % 2 == 1 for t in texts]


@pytest.mark.parametrize("text,want", [("a\nb\n", [2, 4]), ('a,"x\ny"\nb', [8, 9]), ("", [0]), ("a", [1]), ('"\n', [2]), ('""\n"\n', [3, 5])])
def test_record_ends(text, want):
    assert list(record_ends(np.frombuffer(text.encode(), np.uint8))) == want


def test_open_quotes_swallow_no_record():
    text = b'timestamp,open\n2025-01-01 00:00:00Z,"1\n2025-01-01 00:01:00Z,1\n"2025-01-01 00:02:00Z","1\n"\n2025-01-01 00:03:00Z,1'
    ends = record_ends(np.frombuffer(text, np.uint8), RESUME).tolist()
    rows = [text[a:z] for a, z in zip([0, *ends], ends)]
    assert [r[:1] for r in rows] == [b"t", b"2", b"2", b'"', b"2"] and rows[3].count(b"\n") == 2
