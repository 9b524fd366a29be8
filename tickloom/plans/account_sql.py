"""SQL (DuckDB dialect) for the queries of ``account``. Iterative fits and random draws have none."""

from tickloom.plans.market_sql import _IV, r

_CLOSED = """cl AS (
  SELECT trade_id, book_id, CAST(epoch(entry_time) AS BIGINT) AS a, CAST(epoch(end_time) AS BIGINT) AS z, entry_price, CASE WHEN side = 'long' THEN 1 ELSE -1 END * (exit_price - entry_price) AS move
  FROM trades WHERE book_id IS NOT NULL AND entry_time < end_time AND entry_price IS NOT NULL AND exit_price IS NOT NULL),
dy AS (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS day),
ro AS (SELECT CAST(epoch((day + INTERVAL 17 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT) AS at_s, CASE isodow(day) WHEN 3 THEN 3 ELSE 1 END AS factor FROM dy WHERE isodow(day) < 6),
ng AS (SELECT c.*, (SELECT coalesce(sum(factor), 0) FROM ro WHERE at_s > a AND at_s <= z) AS nights FROM cl c)"""
_FLOWS = f"""{_CLOSED}, sc(scenario, commission, slip, rate) AS (VALUES ('S0', 0.0::DECIMAL(18,8), 0.0::DECIMAL(18,8), 0.0::DECIMAL(18,8)), ('S1', 0.035, 0.00001, 0.05), ('S2', 0.07, 0.00005, 0.1)),
fl AS (
  SELECT scenario, book_id, trade_id, a AS at_s, 'entry_commission' AS kind, -CAST(commission AS DECIMAL(28,8)) AS amount, 0::DECIMAL(28,8) AS numerator FROM ng, sc
  UNION ALL SELECT scenario, book_id, trade_id, z, 'realized', CAST(CAST(move AS DECIMAL(28,8)) * 1000 - 2 * CAST(slip AS DECIMAL(28,8)) * 1000 AS DECIMAL(28,8)), 0 FROM ng, sc
  UNION ALL SELECT scenario, book_id, trade_id, z, 'exit_commission', -CAST(commission AS DECIMAL(28,8)), 0 FROM ng, sc
  UNION ALL SELECT scenario, book_id, trade_id, z, 'funding', 0, CAST(CAST(rate * 1000 AS DECIMAL(9,2)) * CAST(entry_price AS DECIMAL(18,8)) * nights AS DECIMAL(28,8)) FROM ng, sc)"""
_MARKS = """bal AS (
  SELECT scenario || '/' || CAST(book_id AS VARCHAR) AS account, scenario, book_id, 10000 + sum(amount) OVER (PARTITION BY scenario, book_id ORDER BY at_s, trade_id, kind ROWS UNBOUNDED PRECEDING) AS v, at_s, trade_id, kind FROM fl),
pk AS (SELECT *, max(v) OVER (PARTITION BY account ORDER BY at_s, trade_id, kind ROWS UNBOUNDED PRECEDING) AS peak FROM bal),
mk AS (SELECT account, min(scenario) AS scenario, min(book_id) AS book_id, min(v) AS low, max(v) AS high, greatest(max(peak - v), 10000 - min(v)) AS drawdown FROM pk GROUP BY account)"""
_MONTH = "strftime(make_timestamp(at_s * 1000000), '%Y-%m')"
_REPORT = f"""pr AS (
  SELECT scenario, book_id, {_MONTH} AS month, coalesce(sum(amount) FILTER (kind = 'realized'), 0) AS realized,
    coalesce(sum(amount) FILTER (kind LIKE '%commission'), 0) AS commission, sum(numerator) AS numerator FROM fl GROUP BY ALL)"""
_M = """m AS (
  SELECT row_id, strftime(make_timestamp(decision_ms * 1000), '%Y-%m') AS month, y, 1.0::DOUBLE + (row_id % 5) / 4.0::DOUBLE AS w
  FROM economic_matrix WHERE y IN (0, 1) AND side IN (-1, 1) AND features IS NOT NULL AND len(features) = 28)"""

SQL: dict[str, str] = {
    "funding_nights": f"WITH {_CLOSED} SELECT trade_id, CAST(nights AS BIGINT) AS nights FROM ng",
    "cashflow_ledger": f"WITH {_FLOWS} SELECT scenario, kind, count(*) AS flows, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(numerator) AS DOUBLE) AS numerator FROM fl GROUP BY 1, 2",
    "period_pnl": f"WITH {_FLOWS}, {_REPORT} SELECT scenario, book_id, month, CAST(realized AS DOUBLE) AS realized, CAST(commission AS DOUBLE) AS commission, {r('CAST(numerator AS DOUBLE) / 365', 4)} AS funding FROM pr",
    "drawdown": f"WITH {_FLOWS}, {_MARKS} SELECT account, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(drawdown AS DOUBLE) AS drawdown, low < 0 AS breach FROM mk",
    "exposure_months": f"""WITH {_CLOSED}, mo AS (
  SELECT book_id, a, z, unnest(generate_series(date_trunc('month', make_timestamp(a * 1000000)), date_trunc('month', make_timestamp((z - 1) * 1000000)), INTERVAL 1 MONTH)) AS mm FROM cl)
SELECT book_id, CAST(epoch(mm) AS BIGINT) AS month_s, CAST(sum(least(z, CAST(epoch(mm + INTERVAL 1 MONTH) AS BIGINT)) - greatest(a, CAST(epoch(mm) AS BIGINT))) AS BIGINT) AS held_s, count(*) AS trades FROM mo GROUP BY 1, 2""",
    "promotion": f"""WITH {_FLOWS}, {_REPORT}, {_MARKS}, g AS (SELECT book_id, bool_and(realized + commission > 0) AS every_month FROM pr WHERE scenario = 'S1' GROUP BY 1)
SELECT g.book_id, every_month, drawdown <= 500 AND NOT low < 0 AS contained FROM g JOIN mk ON mk.book_id = g.book_id AND mk.scenario = 'S2'""",
    "weighted_prior": f"WITH {_M} SELECT month, count(*) AS n, sum(w) AS weight, {r('sum(w * y) / sum(w)', 9)} AS prior FROM m GROUP BY 1",
}

def _touch(start: str, deadline: str, tp: int, sl: int) -> str:
    return f"""{start} q AS (
  SELECT feed_id, quote_id, source_time AS t, bid, ask, NOT coalesce(is_valid, FALSE) OR coalesce(ambiguous, FALSE) OR bid IS NULL OR ask IS NULL AS bad
  FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL AND source_time IS NOT NULL),
good AS (SELECT * FROM q WHERE NOT bad), hz AS (SELECT * FROM q WHERE bad),
d0 AS (
  SELECT row_id, m.feed_id, decision_ms AS at_ms, side, {deadline} AS dl, CASE WHEN f.symbol LIKE '%JPY' THEN 0.01 ELSE 0.0001 END::DECIMAL(18,8) AS pip
  FROM economic_matrix m JOIN feeds f USING (feed_id) WHERE decision_ms IS NOT NULL AND side IN (-1, 1)),
d AS (SELECT * FROM d0 WHERE dl IS NOT NULL),
e AS (
  SELECT d.*, g.t AS et, CASE WHEN side = 1 THEN g.ask ELSE g.bid END AS fill,
    (SELECT min(t) FROM hz WHERE hz.feed_id = d.feed_id AND hz.t >= d.at_ms) AS bad0
  FROM d LEFT JOIN good g ON g.quote_id = (SELECT arg_min(x.quote_id, (x.t, x.quote_id)) FROM good x WHERE x.feed_id = d.feed_id AND x.t >= d.at_ms AND x.t < d.at_ms + 30000)),
n AS (SELECT *, coalesce(bad0 < least(coalesce(et, 9223372036854775807), at_ms + 30000), FALSE) AS entry_bad, fill + side * {tp} * pip AS target, fill - side * {sl} * pip AS loss,
  (SELECT min(t) FROM hz WHERE hz.feed_id = e.feed_id AND hz.t > e.et) AS bad1 FROM e),
c AS (
  SELECT n.row_id, arg_min(struct_pack(t := x.t, won := side * (CASE WHEN side = 1 THEN x.bid ELSE x.ask END - target) >= 0), (x.t, x.quote_id)) AS hit
  FROM n JOIN good x ON x.feed_id = n.feed_id AND x.t > et AND x.t < dl
   AND (side * (CASE WHEN side = 1 THEN x.bid ELSE x.ask END - target) >= 0 OR side * (CASE WHEN side = 1 THEN x.bid ELSE x.ask END - loss) <= 0) GROUP BY 1),
z AS (SELECT n.*, hit.t AS ct, hit.won AS won, (SELECT min(t) FROM good x WHERE x.feed_id = n.feed_id AND x.t >= n.dl) AS tt FROM n LEFT JOIN c USING (row_id)),
o AS (
  SELECT *, CASE WHEN et IS NULL AND entry_bad THEN 'entry_defect' WHEN et IS NULL THEN 'entry_expired' WHEN entry_bad THEN 'entry_defect' WHEN least(target, loss) <= 0 THEN 'invalid_prices'
    WHEN ct IS NOT NULL AND (bad1 IS NULL OR ct < bad1) THEN CASE WHEN won THEN 'tp' ELSE 'sl' END WHEN bad1 < dl THEN 'censored'
    WHEN tt < dl + 60000 AND (bad1 IS NULL OR bad1 > tt) THEN 'timeout' WHEN bad1 < dl + 60000 THEN 'censored' ELSE 'timeout_unobserved' END AS reason FROM z)
SELECT row_id, reason, CASE WHEN NOT entry_bad THEN et END AS entry_ms, CASE WHEN reason IN ('tp', 'sl') THEN ct WHEN reason = 'timeout' THEN tt END AS terminal_ms,
  CASE WHEN NOT entry_bad THEN CAST(CAST(fill AS DECIMAL(28,8)) * 100000000 AS BIGINT) END AS fill_i FROM o"""


# Open milliseconds of the decision, and the instant at which 4,320 open minutes more have gone by.
_ENDS = f"""WITH {_IV}, o AS (SELECT m.*, coalesce(prefix_ms + least(decision_ms, end_ms) - start_ms, 0) + 259200000 AS goal FROM (SELECT * FROM economic_matrix WHERE decision_ms IS NOT NULL) m ASOF LEFT JOIN iv ON m.decision_ms >= iv.start_ms),
ends AS (SELECT o.*, (SELECT max(start_ms + goal - prefix_ms) FROM iv WHERE prefix_ms < goal AND goal <= prefix_ms + end_ms - start_ms) AS dl_ms FROM o),"""
SQL["tick_first_touch"] = _touch(_ENDS, "m.dl_ms", 50, 20).replace("FROM economic_matrix m JOIN", "FROM ends m JOIN").replace("o AS (\n  SELECT *, CASE WHEN et", "oo AS (\n  SELECT *, CASE WHEN et").replace("END AS fill_i FROM o", "END AS fill_i FROM oo")
SQL["tick_first_touch_short"] = _touch("WITH", "decision_ms + 900000", 5, 2)
