"""SQL (DuckDB dialect) for the queries of ``market``."""

BARS = """
f AS (SELECT feed_id, CAST(bar_seconds AS BIGINT) AS step, CASE WHEN symbol LIKE '%JPY' THEN 1000000 ELSE 10000 END AS pip_i FROM feeds),
st AS (
  SELECT c.*, step, pip_i, epoch_us(ts) AS t_us, epoch_us(ingested_at) AS in_us, (epoch_us(ts) // (step * 1000000)) * step AS b,
    CASE WHEN open_px IS NULL OR high_px IS NULL OR low_px IS NULL OR close_px IS NULL THEN 'missing'
         WHEN least(open_px, high_px, low_px, close_px) <= 0 THEN 'not_positive'
         WHEN low_px > least(open_px, close_px) OR greatest(open_px, close_px) > high_px THEN 'range' END AS bad
  FROM candles c JOIN f USING (feed_id) WHERE ts IS NOT NULL),
bars AS (
  SELECT feed_id, step, pip_i, b, open_px AS open, high_px AS high, low_px AS low, close_px AS close FROM st WHERE bad IS NULL
  QUALIFY row_number() OVER (PARTITION BY feed_id, b ORDER BY in_us DESC NULLS LAST, candle_id DESC) = 1),
seq AS (
  SELECT *, lag(b) OVER w AS pb, lead(b) OVER w AS nb, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY feed_id ORDER BY b)),
runs AS (
  SELECT *, sum(CASE WHEN b - pb = step THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id ORDER BY b) AS run FROM seq)
"""
CLOCK = """
mins AS (
  SELECT CAST(epoch(minute_ts) AS BIGINT) AS m, active FROM session_clock
  UNION ALL SELECT max(CAST(epoch(minute_ts) AS BIGINT)) + 60, FALSE FROM session_clock),
coords AS (
  SELECT m, active, CAST(coalesce(sum(CAST(active AS INT)) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS coord FROM mins),
ranks AS (SELECT coord AS rank, m AS rm FROM coords WHERE active)
"""
M1 = """
inside AS (
  SELECT s.*, coord, coord - lag(coord) OVER (PARTITION BY feed_id ORDER BY b) - 1 AS missing
  FROM bars s JOIN coords ON m = b AND active WHERE step = 60),
broken AS (SELECT *, coalesce(missing >= 15, FALSE) AS broke FROM inside),
segs AS (SELECT *, sum(CAST(broke AS INT)) OVER (PARTITION BY feed_id ORDER BY b) AS seg FROM broken),
ends AS (
  SELECT *, lead(broke) OVER w AS gap_next, lead(b) OVER w IS NULL AS at_end, max(b) OVER (PARTITION BY feed_id) AS last_s
  FROM broken WINDOW w AS (PARTITION BY feed_id ORDER BY b)),
barrier AS (
  SELECT e.*, CASE WHEN at_end THEN b + 60 WHEN gap_next THEN rm + 60 END AS bar FROM ends e LEFT JOIN ranks ON rank = coord + 15),
censors AS (SELECT *, min(bar) OVER (PARTITION BY feed_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS censor_s FROM barrier)
"""


def r(e: str, n: int) -> str:
    return f"floor({e} * 1e{n} + 0.5) / 1e{n}"


def day_of(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d')"


_MONTH = "strftime(make_timestamp(b * 1000000), '%Y-%m')"
SQL: dict[str, str] = {
    "clean_bars": f"WITH {BARS} SELECT feed_id, step, b, open, high, low, close FROM bars",
    "candle_violations": f"""WITH {BARS} SELECT candle_id, feed_id, coalesce(bad, CASE WHEN t_us <> b * 1000000 THEN 'misaligned' END) AS reason
FROM st WHERE bad IS NOT NULL OR t_us <> b * 1000000""",
    "dup_quarantine": f"WITH {BARS} SELECT candle_id, feed_id, t_us AS ts_us, count(*) OVER (PARTITION BY feed_id, t_us) AS copies FROM st QUALIFY copies > 1",
    "gap_list": f"WITH {BARS} SELECT feed_id, pb + step AS gap_from, b AS gap_to, (b - pb - step) // step AS missing FROM seq WHERE b - pb > step",
    "gap_triage": f"""WITH {BARS}, had AS (SELECT DISTINCT feed_id, b, TRUE AS had FROM st),
gone AS (SELECT feed_id, unnest(generate_series(pb + step, b - 1, step)) AS b FROM seq WHERE b - pb > step)
SELECT feed_id, {_MONTH} AS month,
  CASE WHEN had THEN 'quarantined'
       WHEN (b // 86400 + 3) % 7 = 5 OR ((b // 86400 + 3) % 7 = 4 AND b % 86400 >= 75600) OR ((b // 86400 + 3) % 7 = 6 AND b % 86400 < 82800) THEN 'weekend'
       ELSE 'unresolved' END AS cause, count(*) AS missing
FROM gone LEFT JOIN had USING (feed_id, b) GROUP BY ALL""",
    "month_coverage": f"WITH {BARS} SELECT feed_id, {_MONTH} AS month, count(*) AS bars, min(b) AS first_s, max(b) AS last_s, min(low) AS low, max(high) AS high FROM bars GROUP BY ALL",
    "side_reconciliation": """
WITH q AS (SELECT DISTINCT feed_id, source_time // 60000 * 60 AS m, 1 AS l FROM quotes WHERE source_time IS NOT NULL),
g AS (SELECT DISTINCT feed_id, ts_ms // 60000 * 60 AS m, 1 AS r FROM quote_groups WHERE ts_ms IS NOT NULL)
SELECT feed_id, m // 86400 * 86400 AS day_s, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS both, count(*) FILTER (r IS NULL) AS left_only,
  count(*) FILTER (l IS NULL) AS right_only, bool_and(l IS NOT NULL AND r IS NOT NULL) AS accepted
FROM q FULL JOIN g USING (feed_id, m) GROUP BY ALL""",
    "session_coordinates": f"WITH {CLOCK} SELECT m, active, coord FROM coords",
    "weekly_clock": """
WITH l AS (SELECT active, minute_ts AT TIME ZONE 'America/New_York' AS t FROM session_clock)
SELECT active, isodow(t) < 5 OR (isodow(t) = 5 AND hour(t) < 17) OR (isodow(t) = 7 AND hour(t) >= 17) AS by_rule, count(*) AS minutes FROM l GROUP BY ALL""",
    "open_elapsed": f"""WITH {CLOCK}, t AS (
  SELECT trade_id, CAST(epoch(entry_time) AS BIGINT) // 60 * 60 AS a, CAST(epoch(end_time) AS BIGINT) // 60 * 60 AS z FROM trades WHERE entry_time IS NOT NULL AND end_time IS NOT NULL)
SELECT trade_id, y.coord - x.coord AS open_min FROM t LEFT JOIN coords x ON x.m = a LEFT JOIN coords y ON y.m = z""",
    "session_deadline": f"""WITH {CLOCK}, t AS (SELECT trade_id, CAST(epoch(entry_time) AS BIGINT) // 60 * 60 AS a FROM trades WHERE entry_time IS NOT NULL)
SELECT trade_id, (SELECT min(m) FROM coords z WHERE z.coord >= x.coord + 4320) AS deadline_s FROM t LEFT JOIN coords x ON x.m = a""",
    "missing_open_minutes": f"WITH {BARS}, {CLOCK}, {M1} SELECT feed_id, b, missing, broke FROM broken",
    "censor_times": f"WITH {BARS}, {CLOCK}, {M1} SELECT feed_id, b, censor_s FROM censors",
    "open_intervals": """
WITH a AS (SELECT CAST(epoch(minute_ts) AS BIGINT) AS m FROM session_clock WHERE active),
k AS (SELECT m, m - 60 * row_number() OVER (ORDER BY m) AS g FROM a),
i AS (SELECT min(m) * 1000 AS start_ms, (max(m) + 60) * 1000 AS end_ms FROM k GROUP BY g)
SELECT start_ms, end_ms, CAST(coalesce(sum(end_ms - start_ms) OVER (ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix_ms FROM i""",
    "rollovers": """
WITH d AS (SELECT unnest(generate_series(DATE '2025-01-05', DATE '2025-08-02', INTERVAL 1 DAY)) AS day)
SELECT CAST(epoch((day + INTERVAL 17 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT) AS at_s, CAST(CASE isodow(day) WHEN 3 THEN 3 ELSE 1 END AS INT) AS factor
FROM d WHERE isodow(day) < 6""",
    "month_windows": """
WITH t AS (SELECT feed_id, CAST(epoch(first_ts) AS BIGINT) AS a, CAST(epoch(last_ts) AS BIGINT) AS z FROM feeds),
m AS (SELECT *, unnest(generate_series(date_trunc('month', make_timestamp(a * 1000000)), date_trunc('month', make_timestamp((z - 1) * 1000000)), INTERVAL 1 MONTH)) AS mm FROM t)
SELECT feed_id, a, z, CAST(epoch(mm) AS BIGINT) AS month_from, CAST(epoch(mm + INTERVAL 1 MONTH) AS BIGINT) AS month_to FROM m""",
}
_IV = "iv AS (" + SQL["open_intervals"].strip().replace("WITH a AS", "WITH a AS", 1) + ")"
SQL["clock_ms"] = f"""WITH {_IV}, e AS (SELECT row_id, decision_ms AS t FROM economic_matrix),
s AS (SELECT row_id, t, prefix_ms, start_ms, end_ms FROM e ASOF LEFT JOIN iv ON e.t >= iv.start_ms),
n AS (SELECT row_id, min(start_ms) AS nx FROM e JOIN iv ON iv.start_ms > t GROUP BY 1)
SELECT row_id, CASE WHEN t IS NOT NULL THEN coalesce(prefix_ms + least(t, end_ms) - start_ms, 0) END AS open_ms, coalesce(t < end_ms, FALSE) AS is_open,
  CASE WHEN t < end_ms THEN t ELSE nx END AS next_open_ms FROM s LEFT JOIN n USING (row_id)"""
SQL["clock_advance"] = f"""WITH {_IV}, e AS (SELECT row_id, decision_ms AS t FROM economic_matrix WHERE decision_ms IS NOT NULL),
s AS (SELECT row_id, coalesce(prefix_ms + least(t, end_ms) - start_ms, 0) + 259200000 AS target FROM e ASOF LEFT JOIN iv ON e.t >= iv.start_ms)
SELECT row_id, (SELECT max(start_ms + target - prefix_ms) FROM iv WHERE prefix_ms < target AND target <= prefix_ms + end_ms - start_ms) AS deadline_ms FROM s"""

_W = {n: f"w{n} AS (PARTITION BY feed_id ORDER BY b ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (5, 15, 60, 240)}
_F = []
for n in (5, 15, 60, 240):
    _F += [
        f"sum(rr) OVER w{n} AS ret_{n}",
        f"sqrt(greatest(sum(rr * rr) OVER w{n} / {n} - (sum(rr) OVER w{n} / {n}) * (sum(rr) OVER w{n} / {n}), 0.0)) AS vol_{n}",
        f"CAST(sum(hl) OVER w{n} AS DOUBLE) / {n} / 0.0001 AS range_{n}",
        f"CASE WHEN count(*) OVER w{n} = {n} THEN (pc - avg(c) OVER w{n}) / greatest(stddev_pop(c) OVER w{n}, 1e-5) END AS z_{n}",
        f"abs(sum(rr) OVER w{n}) / greatest(sum(abs(rr)) OVER w{n}, 1e-12) AS eff_{n}",
    ]
FEATURES = f"""
fx AS (SELECT feed_id, step, b, high - low AS hl, CAST(open AS DOUBLE) AS o, CAST(high AS DOUBLE) AS h, CAST(low AS DOUBLE) AS l, CAST(close AS DOUBLE) AS c FROM bars),
fr AS (
  SELECT *, coalesce(ln(c) - ln(lag(c) OVER w), 0.0) AS rr, lag(c) OVER w AS pc, lag(o) OVER w AS po, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lag(b, 241) OVER w AS far
  FROM fx WINDOW w AS (PARTITION BY feed_id ORDER BY b)),
feat AS (
  SELECT feed_id, b, {", ".join(_F)},
    (pc - po) / greatest(ph - pl, 1e-5) AS body, (ph - greatest(pc, po)) / CASE WHEN pc IS NOT NULL THEN greatest(ph - pl, 1e-5) END AS upper,
    (least(pc, po) - pl) / CASE WHEN pc IS NOT NULL THEN greatest(ph - pl, 1e-5) END AS lower,
    sin((b % 86400) / 3600.0 * (2 * pi() / 24)) AS hour_sin, cos((b % 86400) / 3600.0 * (2 * pi() / 24)) AS hour_cos,
    sin(((b // 86400 + 3) % 7) * (2 * pi() / 7)) AS dow_sin, cos(((b // 86400 + 3) % 7) * (2 * pi() / 7)) AS dow_cos,
    coalesce(b - far = 241 * step, FALSE) AS valid
  FROM fr WINDOW {", ".join(_W.values())})
"""
_NAMES = [f"{k}_{n}" for n in (5, 15, 60, 240) for k in ("ret", "vol", "range", "z", "eff")] + ["body", "upper", "lower", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
SQL["features_past"] = f"WITH {BARS}, {FEATURES} SELECT feed_id, b, valid, " + ", ".join(
    f"{r(c, 2 if c.startswith('z_') else 6)} AS {c}" for c in _NAMES
) + " FROM feat"
_TURNED = [c for c in _NAMES if c.startswith(("ret_", "z_")) or c == "body"]
SQL["features_oriented"] = f"""WITH {BARS}, {FEATURES}, sides AS (SELECT * FROM feat, (VALUES (1), (-1)) v(side) WHERE valid)
SELECT feed_id, side, count(*) AS n, {", ".join(f"{r(f'avg({c} * side)' if c in _TURNED else f'avg({c})', 2 if c.startswith('z_') else 6)} AS {c}" for c in _NAMES)},
  {r("avg(CAST(side AS DOUBLE))", 6)} AS direction FROM sides GROUP BY feed_id, side"""


def _fraction(d: float, tol: float) -> list[float]:
    w = [1.0]
    while abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= tol:
        w.append(nxt)
    return w


_FW = _fraction(0.5, 1e-4)
SQL["fractional_difference"] = (
    f"WITH {BARS}, x AS (SELECT *, ln(CAST(close AS DOUBLE)) AS lc, lag(b, {len(_FW)}) OVER (PARTITION BY feed_id ORDER BY b) AS far FROM bars), "
    f"y AS (SELECT feed_id, b, coalesce(b - far = step * {len(_FW)}, FALSE) AS valid, list(lc) OVER (PARTITION BY feed_id ORDER BY b ROWS BETWEEN {len(_FW)} PRECEDING AND 1 PRECEDING) AS p FROM x) "
    f"SELECT feed_id, b, valid, CASE WHEN valid THEN {r(f'list_dot_product(p, {list(reversed(_FW))})', 6)} END AS frac FROM y"
)
SQL["momentum_side"] = f"""WITH {BARS}, x AS (
  SELECT feed_id, step, b, lag(close, 1) OVER w AS near, lag(close, 61) OVER w AS far, lag(b, 61) OVER w AS fb FROM bars WINDOW w AS (PARTITION BY feed_id ORDER BY b))
SELECT feed_id, b, CAST(CASE WHEN b - fb = step * 61 THEN CASE WHEN near > far THEN 1 WHEN near < far THEN -1 ELSE 0 END END AS INT) AS side FROM x"""


def _ew(lag: int, window: int, span: int, minimum: int) -> str:
    k = f"{span - 1}.0 / {span + 1}.0"
    return f"""WITH {BARS}, {CLOCK}, {M1},
an AS (SELECT s.*, CAST(s.close AS DOUBLE) / CAST(a.close AS DOUBLE) - 1 AS ret, row_number() OVER (PARTITION BY s.feed_id, s.seg ORDER BY s.b) AS pos
  FROM segs s LEFT JOIN segs a ON a.feed_id = s.feed_id AND a.seg = s.seg AND a.coord = s.coord - {lag}),
p AS (
  SELECT i.feed_id, i.b, count(j.ret) AS n, sum(pow({k}, i.pos - 1 - j.pos)) FILTER (j.ret IS NOT NULL) AS a,
    sum(pow({k}, i.pos - 1 - j.pos) * j.ret) AS bb, sum(pow({k}, i.pos - 1 - j.pos) * j.ret * j.ret) AS c,
    sum(pow({k}, 2 * (i.pos - 1 - j.pos))) FILTER (j.ret IS NOT NULL) AS d
  FROM an i LEFT JOIN an j ON j.feed_id = i.feed_id AND j.seg = i.seg AND j.pos < i.pos AND j.pos >= i.pos - {window} GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN n >= {minimum} THEN sqrt((c - bb * bb / a) / (a - d / a)) END AS sigma FROM p)
SELECT feed_id, b, {r("sigma", 7)} AS sigma, n AS returns, CASE WHEN n < {minimum} THEN 'insufficient_history' WHEN sigma = 0 THEN 'zero_volatility' ELSE '' END AS reason,
  n >= {minimum} AND sigma > 0 AS valid FROM v"""


SQL["ew_volatility"] = _ew(1440, 500, 100, 100)
SQL["ew_volatility_hour"] = _ew(60, 120, 40, 30)


def _cusum(source: str, reset: str) -> str:
    return f"""z AS (
  SELECT feed_id, b, row_number() OVER w AS i, coalesce({reset}, TRUE) AS reset, coalesce(ln(CAST(close AS DOUBLE)) - ln(CAST(lag(close) OVER w AS DOUBLE)), 0.0) AS x
  FROM {source} WINDOW w AS (PARTITION BY feed_id ORDER BY b)),
c AS (
  SELECT feed_id, i, b, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, FALSE AS event, FALSE AS was, reset FROM z WHERE i = 1
  UNION ALL
  SELECT feed_id, i, b,
    CASE WHEN reset THEN 0.0 WHEN dn < -0.002 THEN u WHEN u > 0.002 THEN 0.0 ELSE u END,
    CASE WHEN reset OR dn < -0.002 THEN 0.0 ELSE dn END,
    NOT reset AND (dn < -0.002 OR u > 0.002), was, reset
  FROM (SELECT z.feed_id, z.i, z.b, z.reset, greatest(0.0, c.up + z.x) AS u, least(0.0, c.down + z.x) AS dn, c.event AS was FROM c JOIN z ON z.feed_id = c.feed_id AND z.i = c.i + 1))
SELECT feed_id, b, event, was AND NOT reset AS entry FROM c WHERE event OR (was AND NOT reset)"""


SQL["cusum_events"] = f"WITH RECURSIVE {BARS}, {_cusum('bars', 'b - lag(b) OVER w <> step')}"
SQL["session_cusum"] = f"WITH RECURSIVE {BARS}, {CLOCK}, {M1}, {_cusum('broken', 'broke OR lag(b) OVER w IS NULL')}"

# Which barrier first: all bars an entry can reach, the first touched one, and the order of rules on it.
_ENTRIES = """
px AS (SELECT *, CAST(CAST(open AS DECIMAL(28,8)) * 100000000 AS BIGINT) AS o, CAST(CAST(high AS DECIMAL(28,8)) * 100000000 AS BIGINT) AS h, CAST(CAST(low AS DECIMAL(28,8)) * 100000000 AS BIGINT) AS l, CAST(CAST(close AS DECIMAL(28,8)) * 100000000 AS BIGINT) AS c FROM {src}),
en AS (SELECT p.*, side, o + side * 50 * pip_i AS target, o - side * 20 * pip_i AS stop FROM px p, (VALUES (1), (-1)) v(side)),
pairs AS (
  SELECT e.feed_id, e.b, e.side, e.o AS eo, e.target, e.stop, e.deadline, e.censor, j.b AS jb, j.step AS step, j.o, j.h, j.l, j.c,
    j.h >= greatest(e.target, e.stop) OR j.l <= least(e.target, e.stop) AS touch,
    CASE WHEN e.side > 0 THEN j.h >= e.target ELSE j.l <= e.target END AS hit_target, CASE WHEN e.side > 0 THEN j.l <= e.stop ELSE j.h >= e.stop END AS hit_stop
  FROM en e JOIN px j ON j.feed_id = e.feed_id AND j.b >= e.b AND j.b < least(e.deadline, e.censor)),
firsts AS (
  SELECT feed_id, b, side, eo, target, stop, deadline, censor, min(jb) FILTER (touch) AS tb, max_by(c, jb) AS last_c, max(step) AS step
  FROM pairs GROUP BY ALL),
hits AS (
  SELECT f.*, p.o, p.hit_target, p.hit_stop, f.side * (p.o - f.stop) <= 0 AS open_stop, f.side * (p.o - f.target) >= 0 AS open_target
  FROM firsts f LEFT JOIN pairs p ON p.feed_id = f.feed_id AND p.b = f.b AND p.side = f.side AND p.jb = f.tb),
lab AS (
  SELECT *, CASE WHEN tb IS NULL THEN CASE WHEN {timeout} THEN 'timeout' ELSE 'censored' END
    WHEN open_stop THEN 'stop_loss' WHEN open_target THEN 'take_profit' WHEN hit_target AND hit_stop THEN 'ambiguous' WHEN hit_stop THEN 'stop_loss'
    WHEN tb + step < deadline THEN 'take_profit' ELSE 'boundary' END AS outcome,
    CASE WHEN tb IS NULL THEN least(deadline, censor) WHEN open_stop OR open_target THEN tb ELSE tb + step END AS end_s,
    CASE WHEN tb IS NULL THEN least(deadline, censor) ELSE tb + step END AS info_s,
    CASE WHEN tb IS NULL THEN CASE WHEN {timeout} THEN last_c END WHEN open_stop THEN o WHEN open_target THEN target WHEN hit_target AND hit_stop THEN NULL
      WHEN hit_stop THEN stop ELSE target END AS exit_i
  FROM hits)
"""
_CONTIGUOUS = (
    f"WITH {BARS}, bounds AS (SELECT *, b + 259200 AS deadline, max(b) OVER (PARTITION BY feed_id, run) + step AS censor FROM runs), "
    + _ENTRIES.format(src="bounds", timeout="deadline <= censor")
)
SQL["first_touch_labels"] = (
    _CONTIGUOUS
    + """SELECT feed_id, b, side, outcome, end_s, exit_i,
  CAST(CAST(side * (exit_i - eo) AS DOUBLE) / (CASE WHEN symbol LIKE '%JPY' THEN 1000000 ELSE 10000 END) AS DECIMAL(18,4)) AS pnl_pips
FROM lab JOIN (SELECT feed_id, symbol FROM feeds) USING (feed_id)"""
)
SQL["label_audit"] = (
    _CONTIGUOUS
    + f"SELECT feed_id, {_MONTH} AS month, count(*) AS candidates, "
    + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in ("take_profit", "stop_loss", "timeout", "ambiguous", "boundary", "censored"))
    + ", count(*) FILTER (outcome IN ('take_profit', 'stop_loss', 'timeout')) AS retained FROM lab GROUP BY ALL"
)
SQL["hard_negatives"] = (
    _CONTIGUOUS
    + """, later AS (
  SELECT s.feed_id, s.b, s.side, s.deadline, s.censor, min(p.jb) AS kb, arg_min(p.side * (p.o - p.target) >= 0, p.jb) AS at_open, max(p.step) AS st
  FROM lab s LEFT JOIN pairs p ON p.feed_id = s.feed_id AND p.b = s.b AND p.side = s.side AND p.jb >= s.tb AND p.hit_target
  WHERE s.outcome = 'stop_loss' GROUP BY ALL),
w AS (SELECT *, CASE WHEN at_open THEN kb ELSE kb + st END AS at_s FROM later)
SELECT feed_id, b, side, at_s AS post_s, CASE WHEN at_s < deadline THEN 'reached' WHEN at_s IS NOT NULL THEN 'boundary' WHEN deadline <= censor THEN 'not_reached' ELSE 'censored' END AS post_status
FROM w"""
)
SQL["session_labels"] = (
    f"WITH {BARS}, {CLOCK}, {M1}, bounds AS (SELECT c.* EXCLUDE (rank, rm), censor_s AS censor, r2.rm + 60 AS deadline FROM censors c JOIN ranks r2 ON r2.rank = coord + 4319), "
    + _ENTRIES.format(src="bounds", timeout="deadline < censor OR (deadline = censor AND deadline = (SELECT max(b) FROM inside i WHERE i.feed_id = hits.feed_id) + 60)")
    + "SELECT feed_id, b, side, outcome, end_s, info_s, exit_i FROM lab"
)
SQL["session_labels"] = SQL["session_labels"].replace("c.* EXCLUDE (rank, rm)", "c.*").replace("SELECT e.*, CASE WHEN at_end", "SELECT e.*, CASE WHEN at_end")

_VOL_ENTRIES = (
    _ENTRIES.replace("side * 50 * pip_i", "side * tp_i").replace("side * 20 * pip_i", "side * sl_i").replace("(VALUES (1), (-1)) v(side))", "(VALUES (1), (-1)) v(side) WHERE ok)")
)


def _volatility_labels(ew: str) -> str:
    sigma = ew.replace(f"{r('sigma', 7)} AS sigma", "sigma AS sigma")
    return (
        f"""WITH {BARS}, {CLOCK}, {M1}, ew AS ({sigma}),
pv AS (SELECT feed_id, b, valid, sigma * CAST(lag(c.close) OVER (PARTITION BY feed_id ORDER BY b) AS DOUBLE) AS pv, open FROM ew JOIN inside c USING (feed_id, b)),
di AS (SELECT feed_id, b, CAST(floor(pv * 2.5e8 + 0.5) AS BIGINT) AS tp_i, CAST(floor(pv * 1e8 + 0.5) AS BIGINT) AS sl_i, valid, open FROM pv),
bounds AS (SELECT c.*, censor_s AS censor, r2.rm + 60 AS deadline, tp_i, sl_i, coalesce(valid AND CAST(CAST(c.open AS DECIMAL(28,8)) * 100000000 AS BIGINT) > tp_i AND sl_i > 0, FALSE) AS ok
  FROM censors c JOIN ranks r2 ON r2.rank = coord + 4319 JOIN di ON di.feed_id = c.feed_id AND di.b = c.b), """
        + _VOL_ENTRIES.format(src="bounds", timeout="deadline < censor OR (deadline = censor AND deadline = (SELECT max(b) FROM inside i WHERE i.feed_id = hits.feed_id) + 60)")
        + "SELECT feed_id, side, outcome, count(*) AS n FROM lab GROUP BY 1, 2, 3"
    )


SQL["volatility_labels"] = _volatility_labels(SQL["ew_volatility"])
SQL["volatility_labels_hour"] = _volatility_labels(SQL["ew_volatility_hour"])

_Q = "q AS (SELECT * FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL)"
_HW = f"""{_Q}, seen AS (
  SELECT *, max(source_time) OVER (PARTITION BY feed_id ORDER BY seq, quote_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM q),
hw AS (SELECT *, greatest(was, source_time) AS available_ms, coalesce(source_time < was, FALSE) AS late FROM seen)"""
SQL["late_flags"] = f"WITH {_HW} SELECT quote_id, available_ms, late FROM hw"
SQL["tick_audit"] = f"""WITH {_HW}, x AS (
  SELECT *, lag(quote_id) OVER w IS NULL AS first_row, lag(source_time) OVER w AS pt, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, available_ms - lag(available_ms) OVER w AS wait,
    source_time IS NOT NULL AND (bid IS NULL OR ask IS NULL OR bid <= 0 OR ask < bid) AS bad FROM hw WINDOW w AS (PARTITION BY feed_id ORDER BY seq, quote_id))
SELECT feed_id, count(*) AS rows, count(*) FILTER (source_time IS NULL) AS no_time, count(*) FILTER (late) AS late,
  count(*) FILTER (NOT first_row AND pt = source_time) AS ties,
  count(*) FILTER (NOT first_row AND pt IS NOT DISTINCT FROM source_time AND pb IS NOT DISTINCT FROM bid AND pa IS NOT DISTINCT FROM ask) AS repeats,
  count(*) FILTER (bad) AS bad_prices, min(ask - bid) FILTER (source_time IS NOT NULL AND NOT late AND NOT bad) AS spread_min,
  max(ask - bid) FILTER (source_time IS NOT NULL AND NOT late AND NOT bad) AS spread_max, max(wait) AS longest_wait_ms FROM x GROUP BY feed_id"""
SQL["tick_days"] = f"WITH {_Q} SELECT feed_id, {day_of('source_time')} AS day, count(*) AS rows, count(*) FILTER (is_valid) AS valid FROM q WHERE source_time IS NOT NULL GROUP BY ALL"
SQL["tie_groups"] = f"""WITH {_Q}, x AS (
  SELECT *, coalesce(is_valid, FALSE) AND source_time IS NOT NULL AS ok, lag(source_time) OVER w AS pt, lag(coalesce(is_valid, FALSE) AND source_time IS NOT NULL) OVER w AS pok
  FROM q WINDOW w AS (PARTITION BY feed_id ORDER BY seq, quote_id)),
g AS (SELECT *, sum(CASE WHEN ok AND pok AND pt = source_time THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id ORDER BY seq, quote_id) AS g FROM x)
SELECT feed_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, max(source_time) AS ts_ms, min(bid) AS bid_min, max(bid) AS bid_max, min(ask) AS ask_min, max(ask) AS ask_max,
  count(DISTINCT (bid, ask)) > 1 AS ambiguous, bool_and(ok) AS eligible FROM g GROUP BY feed_id, g"""
SQL["tick_bars"] = f"""WITH {_Q}, x AS (SELECT *, source_time // 60000 * 60000 AS bar_ms, coalesce(is_valid, FALSE) AND bid IS NOT NULL AND ask IS NOT NULL AS ok FROM q WHERE source_time IS NOT NULL)
SELECT feed_id, bar_ms, arg_min(bid, (source_time, seq, quote_id)) FILTER (ok) AS open, max(bid) FILTER (ok) AS high, min(bid) FILTER (ok) AS low,
  arg_max(bid, (source_time, seq, quote_id)) FILTER (ok) AS close, count(*) FILTER (ok) AS n, min(ask - bid) FILTER (ok) AS spread_min, max(ask - bid) FILTER (ok) AS spread_max, bool_and(ok) AS valid
FROM x GROUP BY 1, 2"""
SQL["silences"] = f"""WITH {_HW}, x AS (SELECT feed_id, available_ms AS last_ms, lead(available_ms) OVER (PARTITION BY feed_id ORDER BY seq, quote_id) AS back_ms FROM hw WHERE available_ms IS NOT NULL)
SELECT feed_id, last_ms, back_ms, last_ms + 60000 AS silent_at_ms FROM x WHERE back_ms - last_ms > 60000"""
_UNION = f"""{_HW}, sp AS (
  SELECT feed_id, source_time // 60000 * 60000 AS a, available_ms // 60000 * 60000 + 60000 AS z FROM hw WHERE (late OR NOT coalesce(is_valid, FALSE)) AND source_time IS NOT NULL),
rc AS (SELECT *, max(z) OVER (PARTITION BY feed_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
gr AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY a, z) AS k FROM rc),
un AS (SELECT feed_id, min(a) AS a, max(z) AS z FROM gr GROUP BY feed_id, k)"""
SQL["integrity_union"] = f"WITH {_UNION} SELECT feed_id, a, z FROM un"
SQL["integrity_hits"] = f"""WITH {_UNION} SELECT row_id, EXISTS (SELECT 1 FROM un WHERE un.feed_id = m.feed_id AND a < information_cap_ms AND z > earliest_input_ms) AS hit
FROM economic_matrix m WHERE earliest_input_ms < information_cap_ms AND feed_id IS NOT NULL"""
_ASOF = "WITH m AS (SELECT row_id, feed_id, decision_ms FROM economic_matrix WHERE decision_ms IS NOT NULL AND feed_id IS NOT NULL), v AS (SELECT DISTINCT feed_id, source_time FROM quotes WHERE is_valid AND source_time IS NOT NULL AND seq IS NOT NULL) "
SQL["asof_forward"] = _ASOF + "SELECT row_id, source_time AS quote_ms FROM m ASOF LEFT JOIN v ON m.feed_id = v.feed_id AND v.source_time >= m.decision_ms"
SQL["asof_backward"] = _ASOF + "SELECT row_id, source_time AS quote_ms FROM m ASOF LEFT JOIN v ON m.feed_id = v.feed_id AND v.source_time < m.decision_ms"
SQL["range_marks"] = f"""WITH {_Q}, x AS (
  SELECT feed_id, bid, max(bid) OVER w AS hi, min(bid) OVER w AS lo FROM q WHERE is_valid AND source_time IS NOT NULL AND bid IS NOT NULL
  WINDOW w AS (PARTITION BY feed_id ORDER BY source_time, seq, quote_id ROWS UNBOUNDED PRECEDING))
SELECT feed_id, min(bid) AS low, max(bid) AS high, max(hi - bid) AS max_drop, max(bid - lo) AS max_rise, count(*) AS n FROM x GROUP BY feed_id"""
SQL["event_order"] = f"""WITH {_Q}, e AS (
  SELECT feed_id, source_time AS t, 4 AS phase, quote_id AS ordinal, 'source' AS kind FROM q WHERE source_time IS NOT NULL
  UNION ALL SELECT feed_id, decision_ms, 3, row_id, 'decision' FROM economic_matrix WHERE feed_id IS NOT NULL AND decision_ms IS NOT NULL)
SELECT feed_id, ordinal, kind, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY t, phase, ordinal) AS INT) AS place FROM e"""
