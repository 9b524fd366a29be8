"""SQL (DuckDB dialect) for the queries of ``datasets``."""

from tickloom.plans.account_sql import _FLOWS
from tickloom.plans.market_sql import _CONTIGUOUS, _HW, _IV, _Q, _UNION, BARS, CLOCK, FEATURES, M1, SQL as _MARKET, _cusum, _fraction, r
from tickloom.plans.research_sql import _LABELED, _SPANS, _SWEEP, _folds

_DEC = "m AS (SELECT * FROM economic_matrix WHERE feed_id IS NOT NULL AND decision_ms IS NOT NULL)"
_BAD = "hz AS (SELECT feed_id, source_time AS t FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND source_time IS NOT NULL AND NOT coalesce(is_valid AND NOT coalesce(ambiguous, FALSE), FALSE))"


def _bars(price: str) -> str:
    return f"""SELECT feed_id, bar_ms, arg_min({price}, (source_time, seq, quote_id)) FILTER (ok) AS open, max({price}) FILTER (ok) AS high, min({price}) FILTER (ok) AS low,
  arg_max({price}, (source_time, seq, quote_id)) FILTER (ok) AS close, count(*) FILTER (ok) AS n, min(ask - bid) FILTER (ok) AS spread_min, max(ask - bid) FILTER (ok) AS spread_max, bool_and(ok) AS valid
FROM x GROUP BY 1, 2"""


_X = f"WITH {_Q}, x AS (SELECT *, source_time // 60000 * 60000 AS bar_ms, coalesce(is_valid, FALSE) AND bid IS NOT NULL AND ask IS NOT NULL AS ok FROM q WHERE source_time IS NOT NULL)"


def _windows(unit: str, months: str) -> str:
    return f"""
WITH t AS (SELECT feed_id, CAST(epoch(first_ts) AS BIGINT) AS a, CAST(epoch(last_ts) AS BIGINT) AS z FROM feeds),
m AS (SELECT *, unnest(generate_series(date_trunc('{unit}', make_timestamp(a * 1000000)), date_trunc('{unit}', make_timestamp((z - 1) * 1000000)), INTERVAL {months})) AS mm FROM t)
SELECT feed_id, a, z, CAST(epoch(mm) AS BIGINT) AS period_from, CAST(epoch(mm + INTERVAL {months}) AS BIGINT) AS period_to FROM m"""


def _coord(rows: str, time: str) -> str:
    """Open milliseconds before an instant, by the calendar's intervals."""
    return f"(SELECT e.*, coalesce(prefix_ms + least({time}, end_ms) - start_ms, 0) AS open_ms, coalesce({time} < end_ms, FALSE) AS is_open FROM {rows} e ASOF LEFT JOIN iv ON e.{time} >= iv.start_ms)"


def _valid(k: float) -> str:
    n = len(_fraction(k, 1e-3))
    return f"coalesce(b - lag(b, {n}) OVER w = step * {n}, FALSE)"


_SILENT = f"""{_HW}, s AS (SELECT feed_id, available_ms AS last_ms, lead(available_ms) OVER (PARTITION BY feed_id ORDER BY seq, quote_id) AS back_ms FROM hw WHERE available_ms IS NOT NULL),
si AS (SELECT * FROM s WHERE back_ms - last_ms > 60000)"""


def _recursive(name: str, h: str) -> str:
    """The recursive CTE of a threshold under its own names."""
    body = _cusum("bars", "b - lag(b) OVER w <> step").split("\nSELECT feed_id, b, event")[0]
    body = body.replace("z AS (", f"z{name} AS (", 1).replace("c AS (\n", f"c{name} AS (\n", 1).replace("FROM z WHERE", f"FROM z{name} WHERE").replace("FROM c JOIN z ON z.", f"FROM c{name} c JOIN z{name} z ON z.")
    return body.replace("0.002", h) + f", e{name} AS (SELECT feed_id, b FROM c{name} WHERE was AND NOT reset)"


_CANDIDATES = f"""{_CONTIGUOUS.replace("WITH ", "WITH RECURSIVE ", 1)}, {FEATURES}, {_recursive("1", "0.002")}, {_recursive("2", "0.005")}, cd AS (
  SELECT l.feed_id, l.b, l.side, l.outcome, coalesce(f.valid, FALSE) AS valid, e1.b IS NOT NULL AS fine, e2.b IS NOT NULL AS coarse, e1.b IS NOT NULL AND e2.b IS NOT NULL AS common
  FROM lab l LEFT JOIN feat f ON f.feed_id = l.feed_id AND f.b = l.b LEFT JOIN e1 ON e1.feed_id = l.feed_id AND e1.b = l.b LEFT JOIN e2 ON e2.feed_id = l.feed_id AND e2.b = l.b)"""
_MONTH = "strftime(make_timestamp(starts * 1000000), '%Y-%m')"
_INFO = f"{_LABELED}, {_folds('lb', 'info_ends')}"

SQL: dict[str, str] = {
    "tick_bars_ask": f"{_X} {_bars('ask')}",
    "side_prices": f"""{_X}, b AS ({_bars('bid')}), a AS ({_bars('ask')}), j AS (
  SELECT b.feed_id, b.bar_ms, a.open < b.open OR a.high < b.high OR a.low < b.low OR a.close < b.close AS crossed, a.close - b.close AS w FROM a JOIN b USING (feed_id, bar_ms) WHERE b.n > 0)
SELECT feed_id, bar_ms // 86400000 * 86400 AS day_s, count(*) AS minutes, count(*) FILTER (crossed) AS crossed, max(w) AS widest_close, count(*) FILTER (crossed) = 0 AS accepted FROM j GROUP BY 1, 2""",
    "quarter_windows": _windows("quarter", "3 MONTH"),
    "week_windows": _windows("week", "7 DAY"),
    "calendar_denominators": f"""WITH {_IV}, {_DEC}, c AS (SELECT *, coalesce(calendar_eligible, FALSE) AS f FROM {_coord('m', 'decision_ms')})
SELECT feed_id, count(*) AS decisions, count(*) FILTER (is_open) AS inside, count(*) FILTER (f AND NOT is_open) AS flagged_outside, count(*) FILTER (NOT f AND is_open) AS unflagged_inside FROM c GROUP BY 1""",
    "silences_open": f"""WITH {_IV}, {_SILENT},
a AS (SELECT feed_id, last_ms, back_ms, open_ms AS c0 FROM {_coord('si', 'last_ms')}),
z AS (SELECT feed_id, last_ms, back_ms, c0, open_ms AS c1 FROM {_coord('a', 'back_ms')})
SELECT feed_id, last_ms, back_ms, (SELECT max(start_ms + c0 + 60000 - prefix_ms) FROM iv WHERE prefix_ms < c0 + 60000 AND c0 + 60000 <= prefix_ms + end_ms - start_ms) AS silent_at_ms,
  c1 - c0 AS open_ms, c1 - c0 >= 900000 AS resets FROM z WHERE c1 - c0 > 60000""",
    "causal_events": f"""WITH {_SILENT}, dy AS (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS day),
ro AS (SELECT CAST(epoch((day + INTERVAL 17 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT) AS at_s FROM dy WHERE isodow(day) < 6),
e AS (
  SELECT feed_id, at_s * 1000 AS time, 1 AS phase, at_s // 86400 AS ordinal, 'funding' AS kind FROM feeds JOIN ro ON at_s * 1000 >= epoch_ms(first_ts) AND at_s * 1000 < epoch_ms(last_ts)
  UNION ALL SELECT feed_id, last_ms + 60000, 2, max(last_ms), 'timer' FROM si GROUP BY feed_id, last_ms + 60000
  UNION ALL SELECT feed_id, decision_ms, 3, row_id, 'decision' FROM economic_matrix WHERE feed_id IS NOT NULL AND decision_ms IS NOT NULL
  UNION ALL SELECT feed_id, source_time, 4, quote_id, 'source' FROM q WHERE source_time IS NOT NULL
  UNION ALL SELECT feed_id, epoch_ms(last_ts), 5, 0, 'end' FROM feeds)
SELECT feed_id, time, kind, ordinal, row_number() OVER (PARTITION BY feed_id ORDER BY time, phase, ordinal) AS place FROM e""",
    "asof_expiring": f"""WITH {_DEC} SELECT row_id, (SELECT min(source_time) FROM quotes q WHERE q.feed_id = m.feed_id AND is_valid AND seq IS NOT NULL AND source_time >= decision_ms AND source_time < decision_ms + 30000) AS quote_ms FROM m""",
    "next_hazard": f"WITH {_DEC}, {_BAD} SELECT row_id, (SELECT min(t) FROM hz WHERE hz.feed_id = m.feed_id AND t > decision_ms) AS hazard_ms FROM m",
    "hazard_return": f"""WITH {_BAD}, g AS (SELECT feed_id, source_time AS t FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND is_valid AND NOT coalesce(ambiguous, FALSE) AND source_time IS NOT NULL)
SELECT DISTINCT hz.feed_id, hz.t AS hazard_ms, g.t AS return_ms FROM hz ASOF LEFT JOIN g ON g.feed_id = hz.feed_id AND g.t > hz.t""",
    "range_summaries": f"""WITH {_DEC}, q AS (SELECT feed_id, quote_id, seq, source_time AS t, CAST(CAST(bid AS DECIMAL(28,8)) * 100000000 AS BIGINT) AS v FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND is_valid AND source_time IS NOT NULL AND bid IS NOT NULL),
p AS (SELECT row_id, v, max(v) OVER w AS hi, min(v) OVER w AS lo FROM m JOIN q ON q.feed_id = m.feed_id AND t >= decision_ms AND t < decision_ms + 900000 WINDOW w AS (PARTITION BY row_id ORDER BY t, seq, quote_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT row_id, min(v) AS low, max(v) AS high, max(hi - v) AS max_drop, max(v - lo) AS max_rise, count(*) AS n FROM p GROUP BY 1)
SELECT row_id, low, high, max_drop, max_rise, coalesce(n, 0) AS n FROM m LEFT JOIN g USING (row_id)""",
    "first_crossing": f"""WITH {_DEC}, q AS (SELECT feed_id, source_time AS t, CAST(CAST(bid AS DECIMAL(28,8)) * 100000000 AS BIGINT) AS v FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND is_valid AND source_time IS NOT NULL AND bid IS NOT NULL),
l AS (SELECT feed_id, t, max(v) AS v FROM q GROUP BY 1, 2),
a AS (SELECT m.row_id, m.feed_id, decision_ms, l.v FROM m ASOF JOIN l ON l.feed_id = m.feed_id AND l.t <= m.decision_ms),
k AS (SELECT a.*, v + CASE WHEN symbol LIKE '%JPY' THEN 5000000 ELSE 50000 END AS level FROM a JOIN feeds USING (feed_id))
SELECT row_id, (SELECT min(t) FROM q WHERE q.feed_id = k.feed_id AND t >= decision_ms AND t < decision_ms + 3600000 AND q.v >= level) AS hit_ms FROM k""",
    "earliest_affected": f"""WITH {_UNION}, {_DEC} SELECT un.feed_id, a, z, arg_min(row_id, (earliest_input_ms, row_id)) AS row_id
FROM un LEFT JOIN m ON m.feed_id = un.feed_id AND earliest_input_ms < information_cap_ms AND earliest_input_ms < z AND information_cap_ms > a GROUP BY 1, 2, 3""",
    "cusum_candidates": f"{_CANDIDATES} SELECT * FROM cd",
    "population_support": f"""{_CANDIDATES}, p AS (
  SELECT *, 'all' AS population FROM cd WHERE valid UNION ALL SELECT *, 'fine' FROM cd WHERE valid AND fine UNION ALL SELECT *, 'coarse' FROM cd WHERE valid AND coarse UNION ALL SELECT *, 'common' FROM cd WHERE valid AND common)
SELECT population, side, outcome, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "session_stale": f"""WITH lab0 AS ({_MARKET["session_labels"]}), {BARS}, {CLOCK}, {M1}, t AS (SELECT feed_id, b, side, end_s FROM lab0 WHERE outcome IN ('timeout', 'censored')),
k AS (SELECT feed_id, b + 60 AS closed FROM inside), j AS (SELECT t.*, closed FROM t ASOF LEFT JOIN k ON k.feed_id = t.feed_id AND k.closed <= t.end_s)
SELECT feed_id, b, side, end_s, y.coord - x.coord AS stale FROM j LEFT JOIN coords x ON x.m = closed LEFT JOIN coords y ON y.m = end_s""",
    "fold_guard": f"""WITH {_INFO}, g AS (
  SELECT CAST(fold AS INT) AS fold, part, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test, max(info_ends) FILTER (role = 'train') AS known_until, min(starts) FILTER (role = 'test') AS test_from
  FROM pt WHERE role IS NOT NULL GROUP BY 1, 2) SELECT *, coalesce(known_until < test_from, TRUE) AS clean FROM g""",
    "fold_months": f"""WITH {_INFO} SELECT CAST(fold AS INT) AS fold, part || '_' || role AS partition, {_MONTH} AS month, count(*) AS rows, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives,
  count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS unknown FROM pt WHERE role IS NOT NULL GROUP BY ALL""",
    "fold_regimes": f"""WITH lb AS (SELECT *, info_ends - starts AS length FROM label_dataset WHERE starts IS NOT NULL AND info_ends >= starts AND side IN (-1, 1)), {_folds('lb', 'info_ends')},
cu AS (SELECT side, quantile_disc(length, 0.3333333333333333) AS c1, quantile_disc(length, 0.6666666666666666) AS c2 FROM lb GROUP BY 1),
x AS (SELECT CAST(fold AS INT) AS fold, part || '_' || role AS partition, pt.side, y, CASE WHEN length <= c1 THEN 'low' WHEN length <= c2 THEN 'mid' ELSE 'high' END AS band FROM pt JOIN cu ON cu.side = pt.side WHERE role IS NOT NULL)
SELECT fold, partition, side, band, count(*) AS n, count(*) FILTER (y = 1) AS positives, CAST(grouping(fold, partition, side, band) AS INT) AS level FROM x
GROUP BY GROUPING SETS ((fold, partition, side, band), (fold, partition, band), (fold, partition))""",
    "observed_boundary_long": f"WITH {BARS} SELECT feed_id, b AS buffer_from FROM bars WHERE b < 1745000000 QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY b DESC) = 1941",
    "horizon_mask": f"WITH {_LABELED} SELECT side, count(*) AS rows, count(*) FILTER (info_ends - starts <= 14400) AS within FROM lb GROUP BY 1",
    "warm_start": f"SELECT * FROM ({_MARKET['momentum_side']}) WHERE b >= 1745000000",
    "common_support": f"""WITH {BARS}, v AS (SELECT feed_id, b, {_valid(0.25)} AS q, {_valid(0.5)} AS h, {_valid(0.75)} AS t FROM bars WINDOW w AS (PARTITION BY feed_id ORDER BY b))
SELECT feed_id, strftime(make_timestamp(b * 1000000), '%Y-%m') AS month, count(*) AS bars, count(*) FILTER (q) AS quarter, count(*) FILTER (h) AS half, count(*) FILTER (t) AS three_quarters, count(*) FILTER (q AND h AND t) AS common FROM v GROUP BY 1, 2""",
    "paired_rows": f"""WITH {_DEC} SELECT feed_id, decision_ms, max(row_id) FILTER (side = 1) AS long, max(row_id) FILTER (side = -1) AS short FROM m WHERE side IN (-1, 1) GROUP BY 1, 2
HAVING count(*) FILTER (side = 1) = 1 AND count(*) FILTER (side = -1) = 1""",
    "month_offsets": f"""WITH {_DEC}, g AS (SELECT feed_id, strftime(make_timestamp(decision_ms * 1000), '%Y-%m') AS month, count(*) AS rows, min(row_id) AS first, max(row_id) AS last FROM m GROUP BY 1, 2)
SELECT *, CAST(coalesce(sum(rows) OVER (PARTITION BY feed_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM g""",
    "control_alignment": """WITH s AS (SELECT trade_id, CAST(max(y) AS INT) AS y, max(starts) AS starts, TRUE AS here FROM label_dataset WHERE trade_id IS NOT NULL GROUP BY 1),
a AS (SELECT trade_id, CASE WHEN outcome = 'take_profit' THEN 1 WHEN outcome IN ('stop_loss', 'timeout') THEN 0 END AS y, CAST(epoch(entry_time) AS BIGINT) AS starts, TRUE AS here FROM trades),
j AS (SELECT CASE WHEN a.here IS NULL THEN 'missing' WHEN s.here IS NULL THEN 'extra'
  ELSE concat_ws('+', CASE WHEN s.y IS DISTINCT FROM a.y THEN 'y' END, CASE WHEN s.starts IS DISTINCT FROM a.starts THEN 'starts' END) END AS st FROM s FULL JOIN a USING (trade_id))
SELECT CASE WHEN st = '' THEN 'equal' ELSE st END AS status, count(*) AS rows FROM j GROUP BY 1""",
    "uniqueness_ms": f"""WITH sp AS (SELECT row_id AS trade_id, feed_id AS book_id, decision_ms AS a, information_end_ms AS z FROM economic_matrix WHERE feed_id IS NOT NULL AND information_end_ms > decision_ms),
{_SWEEP.removeprefix(_SPANS + ", ")}, u AS (
  SELECT trade_id, s.book_id, (y.area - x.area) / (z - a) AS raw FROM sp s JOIN ar x ON x.book_id = s.book_id AND x.t = a JOIN ar y ON y.book_id = s.book_id AND y.t = z)
SELECT trade_id AS row_id, {r("raw", 8)} AS raw, {r("raw / avg(raw) OVER (PARTITION BY book_id)", 6)} AS weight FROM u""",
    "concurrency_diagnostics": f"""WITH {_SWEEP}, u AS (
  SELECT s.book_id, (y.area - x.area) / (z - a) AS raw FROM sp s JOIN ar x ON x.book_id = s.book_id AND x.t = a JOIN ar y ON y.book_id = s.book_id AND y.t = z),
g AS (SELECT book_id, count(*) AS n, avg(raw) AS me, min(raw) AS mi, max(raw) AS ma FROM u GROUP BY 1),
c AS (SELECT book_id, CAST(max(n) AS BIGINT) AS most, sum((nx - t) * n) / sum(nx - t) AS am FROM el WHERE n > 0 AND nx IS NOT NULL GROUP BY 1)
SELECT book_id, n, most, {r("me", 6)} AS raw_mean, {r("mi", 6)} AS raw_min, {r("ma", 6)} AS raw_max, {r("am", 6)} AS active_mean FROM g JOIN c USING (book_id)""",
    "portfolio_report": f"WITH {_FLOWS} SELECT scenario, count(DISTINCT book_id) AS books, count(DISTINCT trade_id) AS trades, CAST(sum(amount) AS DOUBLE) AS net FROM fl GROUP BY 1",
}
