"""SQL (DuckDB dialect) for the queries of ``composite``."""

from tickloom.plans.market_sql import _CONTIGUOUS, BARS, CLOCK, FEATURES, M1, r
from tickloom.plans.research_sql import _SCORED, _SPANS, _ll

SQL: dict[str, str] = {
    "session_features": f"WITH {BARS}, {CLOCK}, {M1} SELECT feed_id, b, coalesce(seg - lag(seg, 241) OVER (PARTITION BY feed_id ORDER BY b) = 0, FALSE) AS valid FROM segs",
    "decision_bars": f"""WITH {BARS}, m AS (SELECT row_id, feed_id, decision_ms FROM economic_matrix WHERE feed_id IS NOT NULL AND decision_ms IS NOT NULL),
c AS (SELECT feed_id, (b + step) * 1000 AS closed_ms, b AS bar_s, close FROM bars)
SELECT row_id, bar_s, close FROM m ASOF LEFT JOIN c ON m.feed_id = c.feed_id AND c.closed_ms <= m.decision_ms""",
    "uniqueness_open": f"""WITH {_SPANS}, {CLOCK}, iv AS (
  SELECT trade_id, book_id, x.coord AS a, y.coord AS z FROM sp JOIN coords x ON x.m = sp.a // 60 * 60 JOIN coords y ON y.m = sp.z // 60 * 60 WHERE x.coord < y.coord),
dl AS (SELECT book_id, t, sum(d) AS d FROM (SELECT book_id, a AS t, 1 AS d FROM iv UNION ALL SELECT book_id, z, -1 FROM iv) GROUP BY 1, 2),
el AS (SELECT book_id, t, sum(d) OVER w AS n, lead(t) OVER w AS nx FROM dl WINDOW w AS (PARTITION BY book_id ORDER BY t)),
ar AS (SELECT *, coalesce(sum((nx - t) / greatest(n, 1)) OVER (PARTITION BY book_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS area FROM el)
SELECT trade_id, {r("(y.area - x.area) / (z - a)", 8)} AS raw FROM iv s JOIN ar x ON x.book_id = s.book_id AND x.t = a JOIN ar y ON y.book_id = s.book_id AND y.t = z""",
    "one_sided_projection": _CONTIGUOUS
    + """, mx AS (SELECT feed_id, step, b, lag(close, 1) OVER w AS near, lag(close, 61) OVER w AS far, lag(b, 61) OVER w AS fb FROM bars WINDOW w AS (PARTITION BY feed_id ORDER BY b)),
sd AS (SELECT feed_id, b, CAST(CASE WHEN b - fb = step * 61 THEN CASE WHEN near > far THEN 1 WHEN near < far THEN -1 ELSE 0 END END AS INT) AS side FROM mx)
SELECT sd.feed_id, sd.b, sd.side, coalesce(outcome, 'no_primary_signal') AS outcome FROM sd LEFT JOIN lab ON lab.feed_id = sd.feed_id AND lab.b = sd.b AND lab.side = sd.side""",
    "candidate_summary": _CONTIGUOUS
    + "SELECT side, outcome, CAST(grouping(side, outcome) AS INT) AS level, count(*) AS n, CAST(sum(end_s - b) AS BIGINT) AS seconds FROM lab GROUP BY GROUPING SETS ((side, outcome), (outcome), (side), ())",
    "censor_diagnostics": _CONTIGUOUS
    + f""", {FEATURES}, j AS (
  SELECT year(make_timestamp(l.b * 1000000)) || '-Q' || quarter(make_timestamp(l.b * 1000000)) AS quarter, outcome IN ('take_profit', 'stop_loss', 'timeout') AS conclusive, vol_60, eff_60
  FROM lab l JOIN feat f ON f.feed_id = l.feed_id AND f.b = l.b WHERE f.valid)
SELECT quarter, conclusive, count(*) AS n, {r("avg(vol_60)", 8)} AS vol_60, {r("avg(eff_60)", 6)} AS eff_60 FROM j GROUP BY 1, 2""",
    "coverage": "SELECT feed_id, count(*) AS rows, "
    + ", ".join(f"{r(f'avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 8)} AS {c}" for c in ("feature_valid", "volatility_valid", "calendar_eligible", "eligible"))
    + " FROM economic_matrix GROUP BY 1",
    "range_count": """SELECT row_id, (SELECT count(*) FROM quotes q WHERE q.feed_id = m.feed_id AND is_valid AND seq IS NOT NULL AND source_time >= decision_ms AND source_time < decision_ms + 900000) AS n
FROM economic_matrix m WHERE feed_id IS NOT NULL AND decision_ms IS NOT NULL""",
    "zone_map": """WITH x AS (
  SELECT feed_id, seq // 1024 AS block, bid, max(bid) OVER w AS hi, min(bid) OVER w AS lo FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND is_valid AND bid IS NOT NULL
  WINDOW w AS (PARTITION BY feed_id, seq // 1024 ORDER BY seq, quote_id ROWS UNBOUNDED PRECEDING))
SELECT feed_id, block, min(bid) AS low, max(bid) AS high, max(hi - bid) AS max_drop, max(bid - lo) AS max_rise, count(*) AS n FROM x GROUP BY 1, 2""",
    "widest_spreads": """SELECT feed_id, quote_id, ask - bid AS score, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY ask - bid DESC, quote_id) AS INT) AS place
FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND is_valid AND ask - bid IS NOT NULL QUALIFY place <= 5""",
    "hashed_sample": "SELECT trade_id FROM trades ORDER BY sha256('0/' || CAST(trade_id AS VARCHAR)), trade_id LIMIT 500",
    "member_diversity": f"WITH {_SCORED} SELECT side, {r('corr(p, q)', 8)} AS r FROM sc GROUP BY 1",
    "sequence_faults": """WITH c AS (SELECT feed_id, seq, count(*) AS c FROM (SELECT feed_id, unnest(generate_series(first_seq, last_seq)) AS seq FROM quote_groups WHERE feed_id IS NOT NULL AND first_seq <= last_seq) GROUP BY 1, 2),
h AS (SELECT feed_id, seq, count(*) AS h FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2)
SELECT feed_id, count(*) FILTER (h IS NOT NULL AND c IS NOT NULL) AS both, count(*) FILTER (c IS NULL) AS unclaimed, count(*) FILTER (h IS NULL) AS missing, count(*) FILTER (c > 1) AS claimed_twice
FROM h FULL JOIN c USING (feed_id, seq) GROUP BY 1""",
    "distinct_openings": "SELECT symbol, count(*) AS rows, count(DISTINCT epoch(entry_time)) AS openings FROM trades WHERE entry_time IS NOT NULL GROUP BY 1",
}
_LOSS = {"first": _ll("p"), "second": _ll("q"), "even": "-ln(0.5::DOUBLE)"}
SQL["model_contrasts"] = f"WITH {_SCORED} " + " UNION ALL ".join(
    f"SELECT side, '{a}' AS \"left\", '{b}' AS \"right\", {r(f'avg(({_LOSS[a]}) - ({_LOSS[b]}))', 7)} AS delta FROM sc GROUP BY side" for a in _LOSS for b in _LOSS if a != b
)
