"""SQL (DuckDB dialect) for the queries of ``research``. The weighted schedule has none: it is tested exhaustively."""

from tickloom.plans.market_sql import BARS, r
from tickloom.plans.research import FOLDS

_SPANS = """sp AS (
  SELECT trade_id, book_id, outcome, CAST(pnl_pips * 10000 AS BIGINT) AS value, CAST(epoch(entry_time) AS BIGINT) AS a, CAST(epoch(end_time) AS BIGINT) AS z
  FROM trades WHERE book_id IS NOT NULL AND entry_time < end_time)"""
_SWEEP = f"""{_SPANS}, dl AS (SELECT book_id, t, sum(d) AS d FROM (SELECT book_id, a AS t, 1 AS d FROM sp UNION ALL SELECT book_id, z, -1 FROM sp) GROUP BY 1, 2),
el AS (SELECT book_id, t, sum(d) OVER w AS n, lead(t) OVER w AS nx FROM dl WINDOW w AS (PARTITION BY book_id ORDER BY t)),
ar AS (SELECT *, coalesce(sum((nx - t) / greatest(n, 1)) OVER (PARTITION BY book_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS area FROM el)"""
_FOLD_ROWS = ", ".join(f"({f}, '{p}', {b}, {s})" for f, p, b, s in FOLDS)
_HASHED = """h AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day,
  sha256(concat_ws(chr(31), CAST(event_id AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR), CAST(user_id AS VARCHAR), event_type, coalesce(CAST(CAST(floor(value * 1e6 + 0.5) AS BIGINT) AS VARCHAR), chr(0)), coalesce(props, chr(0)))) AS h FROM events)"""
_CHAIN = """x AS (SELECT event_type, day, h[1:3] AS x, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS part FROM h GROUP BY 1, 2, 3),
b AS (SELECT event_type, day, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(part, '' ORDER BY x)) AS body FROM x GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(body) OVER (PARTITION BY event_type ORDER BY day), repeat('0', 64)) AS previous FROM b)"""
_LABELED = "lb AS (SELECT * FROM label_dataset WHERE starts IS NOT NULL AND info_ends >= starts)"


def _folds(source: str, info: str, only: str = "") -> str:
    return f"""fo(fold, part, boundary, stop) AS (VALUES {_FOLD_ROWS}),
pt AS (
  SELECT l.*, fold, part, CASE WHEN starts < boundary AND {info} < boundary - 14460 THEN 'train' WHEN starts >= boundary AND starts < stop AND {info} < stop THEN 'test' END AS role
  FROM {source} l, fo {only})"""


_SCORED = """sc AS (
  SELECT label_id, side, starts, CAST(y AS INT) AS y, ((label_id * 37) % 101 + 0.5::DOUBLE) / 102 AS p, ((label_id * 53 + y * 20) % 97 + 0.5::DOUBLE) / 98 AS q
  FROM label_dataset WHERE y IN (0, 1) AND starts IS NOT NULL)"""


def _ll(p: str) -> str:
    c = f"least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
    return f"-(y * ln({c}) + (1 - y) * ln(1 - {c}))"


def _grid(p: str, ts: str) -> str:
    return f"""{_SCORED}, g AS (
  SELECT side, threshold, count(*) FILTER ({p} >= threshold AND y = 1) AS tp, count(*) FILTER ({p} >= threshold AND y = 0) AS fp,
    count(*) FILTER ({p} < threshold AND y = 1) AS fn, count(*) FILTER ({p} < threshold AND y = 0) AS tn
  FROM sc, (SELECT CAST(unnest({ts}) AS DOUBLE) AS threshold) GROUP BY ALL),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM g)"""


SQL: dict[str, str] = {
    "uniqueness_weights": f"""WITH {_SWEEP}, u AS (
  SELECT trade_id, s.book_id, (y.area - x.area) / (z - a) AS raw FROM sp s JOIN ar x ON x.book_id = s.book_id AND x.t = a JOIN ar y ON y.book_id = s.book_id AND y.t = z)
SELECT trade_id, {r("raw", 8)} AS raw, {r("raw / avg(raw) OVER (PARTITION BY book_id)", 6)} AS weight FROM u""",
    "concurrency": f"WITH {_SWEEP} SELECT book_id, CAST(max(n) AS BIGINT) AS most, {r('sum((nx - t) * n) / sum(nx - t)', 6)} AS active_mean FROM el WHERE n > 0 AND nx IS NOT NULL GROUP BY 1",
    "schedule_greedy": f"""WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY z, a, trade_id) AS i FROM sp),
g AS (
  SELECT book_id, i, trade_id, z AS free, TRUE AS took FROM o WHERE i = 1
  UNION ALL SELECT o.book_id, o.i, o.trade_id, CASE WHEN a >= free THEN z ELSE free END, a >= free FROM g JOIN o ON o.book_id = g.book_id AND o.i = g.i + 1)
SELECT book_id, trade_id FROM g WHERE took""",
    "longest_run": f"""WITH {BARS}, l AS (SELECT feed_id, run, count(*) AS length, min(b) AS from_s FROM runs GROUP BY 1, 2)
SELECT feed_id, length, from_s FROM l QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY length DESC, from_s) = 1""",
    "purged_split": f"""WITH {_LABELED} SELECT label_id, CASE WHEN starts < 1745000000 AND info_ends < 1745000000 - 14460 THEN 'train'
  WHEN starts >= 1745000000 AND starts < 1750000000 AND info_ends < 1750000000 THEN 'test' END AS side FROM lb""",
    "fold_partitions": f"""WITH {_LABELED}, {_folds('lb', 'info_ends')} SELECT CAST(fold AS INT) AS fold, part || '_' || role AS partition, count(*) AS rows, min(starts) AS first_s, max(info_ends) AS last_s
FROM pt WHERE role IS NOT NULL GROUP BY ALL""",
    "class_support": f"""WITH {_LABELED}, {_folds('lb', 'info_ends')}, c AS (
  SELECT CAST(fold AS INT) AS fold, part || '_' || role AS partition, count(*) AS rows, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives,
    count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS unknown FROM pt WHERE role IS NOT NULL GROUP BY ALL)
SELECT *, CASE WHEN positives + negatives = 0 THEN 'empty' WHEN positives = 0 THEN 'no_positives' WHEN negatives = 0 THEN 'no_negatives' END AS reason FROM c""",
    "observed_boundary": f"""WITH {BARS} SELECT feed_id, b AS buffer_from FROM bars WHERE b < 1745000000 QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY b DESC) = 241""",
    "admission": """SELECT row_id, CASE WHEN NOT eligible THEN 'not_eligible' WHEN entry_ms IS NULL OR entry_ms = -9223372036854775808 THEN 'no_entry'
  WHEN information_end_ms IS NULL OR information_end_ms = -9223372036854775808 THEN 'no_information_end' WHEN information_end_ms > information_cap_ms THEN 'beyond_cap'
  WHEN y < 0 THEN 'unknown_label' ELSE 'admitted' END AS reason FROM economic_matrix""",
    "describe": "SELECT l_returnflag, l_linestatus, count(*) AS n, "
    + ", ".join(
        f"{r(e, 4)} AS {n}"
        for n, e in (("mean", "avg(l_extendedprice)"), ("std", "stddev_pop(l_extendedprice)"), ("low", "min(l_extendedprice)"), ("q05", "quantile_cont(l_extendedprice, 0.05)"), ("q50", "quantile_cont(l_extendedprice, 0.5)"), ("q95", "quantile_cont(l_extendedprice, 0.95)"), ("high", "max(l_extendedprice)"))
    )
    + " FROM lineitem GROUP BY 1, 2",
    "regime_tertiles": "SELECT event_type, quantile_disc(value, 0.3333333333333333) AS cut1, quantile_disc(value, 0.6666666666666666) AS cut2 FROM events GROUP BY 1",
    "regime_report": f"""WITH c AS (SELECT event_type, quantile_disc(value, 0.3333333333333333) AS cut1, quantile_disc(value, 0.6666666666666666) AS cut2 FROM events GROUP BY 1),
x AS (SELECT event_type, CASE WHEN value <= cut1 THEN 'low' WHEN value <= cut2 THEN 'mid' ELSE 'high' END AS band, strftime(ts, '%Y-%m') AS month, value FROM events JOIN c USING (event_type))
SELECT event_type, band, month, CAST(grouping(event_type, band, month) AS INT) AS level, count(*) AS n, {r("sum(value)", 3)} AS total
FROM x GROUP BY GROUPING SETS ((event_type, band), (event_type), (month, band), ())""",
    "ap_auc": f"""WITH {_SCORED}, s AS (SELECT side, p, count(*) AS n, sum(y) AS t, sum({_ll('p')}) AS ll, sum((p - y) * (p - y)) AS br FROM sc GROUP BY 1, 2),
k AS (SELECT *, sum(t) OVER (PARTITION BY side ORDER BY p DESC) AS ct, sum(n) OVER (PARTITION BY side ORDER BY p DESC) AS cn, sum(t) OVER (PARTITION BY side) AS pos, sum(n) OVER (PARTITION BY side) AS al FROM s)
SELECT side, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(t) AS BIGINT) AS positives, {r("sum(ll) / sum(n)", 8)} AS log_loss, {r("sum(br) / sum(n)", 8)} AS brier,
  {r("sum(t / pos * ct / cn)", 8)} AS average_precision, {r("sum((n - t) * (ct - t + t / 2.0) / (pos * (al - pos)))", 8)} AS roc_auc FROM k GROUP BY 1""",
    "thresholds": f"WITH {_grid('p', '[0.3, 0.4, 0.5]')} SELECT * FROM m",
    "chosen_threshold": f"WITH {_grid('q', '[0.1, 0.2, 0.3, 0.4, 0.5]')} SELECT side, threshold, f1 FROM m QUALIFY row_number() OVER (PARTITION BY side ORDER BY f1 DESC, threshold DESC) = 1",
    "reliability": f"WITH {_SCORED} SELECT side, CAST(least(floor(p * 10), 9) AS INT) AS decile, count(*) AS rows, {r('avg(p)', 8)} AS mean_p, {r('avg(CAST(y AS DOUBLE))', 8)} AS share FROM sc GROUP BY 1, 2",
    "weighted_quantiles": f"""WITH v AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
k AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t, sum(x * w) OVER (PARTITION BY l_returnflag) / sum(w) OVER (PARTITION BY l_returnflag) AS m FROM v)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, sum(w) AS weight, {r("sum(x * w) / sum(w)", 6)} AS mean,
  {r("sqrt(sum((x - m) * (x - m) * w) / sum(w))", 6)} AS std,
  min(x) FILTER (c >= t * 0.05) AS q05, min(x) FILTER (c >= t * 0.5) AS q50, min(x) FILTER (c >= t * 0.95) AS q95 FROM k GROUP BY 1""",
    "tri_all": """WITH x AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value >= 0 END AND user_id % 7 <> 3 AS ok FROM events)
SELECT user_id, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN FALSE WHEN count(*) FILTER (ok IS NULL) > 0 THEN NULL ELSE TRUE END AS all_ok FROM x GROUP BY 1""",
    "unit_root": f"""WITH {BARS}, x AS (SELECT feed_id, ln(CAST(close AS DOUBLE)) AS v, lag(ln(CAST(close AS DOUBLE))) OVER w AS l, lag(ln(CAST(close AS DOUBLE)), 2) OVER w AS ll FROM bars WINDOW w AS (PARTITION BY feed_id ORDER BY b)),
y AS (SELECT feed_id, v - l AS d, l, l - ll AS p FROM x WHERE ll IS NOT NULL),
s AS (SELECT feed_id, count(*) AS n, covar_pop(l, l) AS vl, covar_pop(p, p) AS vp, covar_pop(l, p) AS lp, covar_pop(d, l) AS dl, covar_pop(d, p) AS dp, covar_pop(d, d) AS dd FROM y GROUP BY 1),
q AS (SELECT *, vl * vp - lp * lp AS det FROM s WHERE n > 3),
b AS (SELECT *, (dl * vp - dp * lp) / det AS beta, (dp * vl - dl * lp) / det AS gamma FROM q WHERE det > 0)
SELECT feed_id, n, {r("beta / sqrt((dd - beta * dl - gamma * dp) / (n - 3) * vp / det)", 3)} AS t FROM b""",
    "row_hashes": f"WITH {_HASHED} SELECT event_id, h AS sha FROM h",
    "hash_chain": f"WITH {_HASHED}, {_CHAIN} SELECT *, sha256(previous || body) AS link FROM p",
    "broken_links": f"""WITH {_HASHED}, {_CHAIN}, l AS (SELECT *, sha256(previous || body) AS link FROM p),
a AS (SELECT * REPLACE (CASE WHEN CAST(day[9:10] AS INT) % 7 = 0 THEN sha256(body) ELSE body END AS body) FROM l)
SELECT event_type, day FROM (SELECT *, coalesce(lag(body) OVER (PARTITION BY event_type ORDER BY day), repeat('0', 64)) AS was FROM a) WHERE was <> previous OR link <> sha256(previous || body)""",
    "table_fingerprint": f"""WITH {_HASHED} SELECT event_type, count(*) AS rows, CAST(sum(CAST(('0x' || h[1:15]) AS HUGEINT)) AS VARCHAR) AS sum_a, CAST(sum(CAST(('0x' || h[16:30]) AS HUGEINT)) AS VARCHAR) AS sum_b FROM h GROUP BY 1""",
    "key_faults": """WITH a AS (SELECT trade_id, count(*) AS a FROM trades GROUP BY 1), b AS (SELECT trade_id, count(*) AS b FROM label_dataset WHERE trade_id IS NOT NULL GROUP BY 1),
j AS (SELECT * FROM a FULL JOIN b USING (trade_id))
SELECT trade_id, 'repeated_left' AS fault FROM j WHERE a > 1 UNION ALL SELECT trade_id, 'repeated_right' FROM j WHERE b > 1
UNION ALL SELECT trade_id, 'missing_left' FROM j WHERE a IS NULL UNION ALL SELECT trade_id, 'missing_right' FROM j WHERE b IS NULL""",
}
_D = {"log_loss": f"({_ll('p')}) - ({_ll('q')})", "brier": "(p - y) * (p - y) - (q - y) * (q - y)"}
SQL["week_sensitivity"] = (
    f"WITH {_SCORED}, w AS (SELECT side, (starts + 259200) // 604800 AS w, count(*) AS n, "
    + ", ".join(f"sum({e}) AS {k}" for k, e in _D.items())
    + " FROM sc GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY side) AS al, "
    + ", ".join(f"sum({k}) OVER (PARTITION BY side) AS s_{k}" for k in _D)
    + " FROM w) SELECT side, count(*) AS weeks, "
    + ", ".join(f"{r(f'sum({k}) / sum(n)', 7)} AS {k}_delta, {r(f'min((s_{k} - {k}) / nullif(al - n, 0))', 7)} AS {k}_min, {r(f'max((s_{k} - {k}) / nullif(al - n, 0))', 7)} AS {k}_max" for k in _D)
    + " FROM t GROUP BY 1"
)
_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SQL["drift"] = (
    "WITH x AS (" + " UNION ALL ".join(f"SELECT year(l_shipdate) AS year, '{c}' AS feature, {c} AS v FROM lineitem" for c in _COLS) + "), "
    "r AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS z FROM x WHERE year <= 1995 GROUP BY 1) "
    f"SELECT feature, CAST(year AS INT) AS year, count(*) AS n, {r('CASE WHEN max(s) > 0 THEN (avg(v) - max(m)) / max(s) END', 6)} AS shift, "
    f"{r('CASE WHEN max(s) > 0 THEN stddev_pop(v) / max(s) END', 6)} AS ratio, {r('avg(CAST(v < a OR v > z AS INT))', 8)} AS outside "
    "FROM x JOIN r USING (feature) WHERE year > 1995 GROUP BY 1, 2"
)
SQL["correlations"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS feature, count(*) AS n, {r(f'corr({c}, l_quantity)', 8)} AS r FROM lineitem GROUP BY 1" for c in _COLS[1:]
)
_PARTS = {"a": "ln(p / (1 - p))", "b": "q - 0.5"}
_SP = "(greatest({z}, 0.0) + ln(1 + exp(-abs({z}))) - y * {z})"
_LG = "power(1 / (1 + exp(-({z}))) - y, 2)"
_Z = "(ln(p / (1 - p)) + (q - 0.5) + 0.1)"
SQL["family_removal"] = f"WITH {_SCORED} " + " UNION ALL ".join(
    f"SELECT side, '{k}' AS family, {r('avg(' + _SP.format(z=f'({_Z} - ({e}))') + ' - ' + _SP.format(z=_Z) + ')', 7)} AS log_loss_delta, "
    f"{r('avg(' + _LG.format(z=f'({_Z} - ({e}))') + ' - ' + _LG.format(z=_Z) + ')', 7)} AS brier_delta FROM sc GROUP BY 1"
    for k, e in _PARTS.items()
)
SQL["consistent_gain"] = f"""WITH {_SCORED}, {_folds('sc', '(starts + 60)', "WHERE part = 'outer'")},
s AS (SELECT fold, avg({_ll('p')}) AS lp, avg({_ll('q')}) AS lq, avg((p - y) * (p - y)) AS bp, avg((q - y) * (q - y)) AS bq FROM pt WHERE role = 'test' GROUP BY 1)
SELECT bool_and(lq < lp) AS every_fold, avg(bq - bp) <= 0 AS mean_brier, count(*) AS folds FROM s"""
_TIES = """q AS (SELECT *, coalesce(is_valid, FALSE) AND source_time IS NOT NULL AS ok FROM quotes WHERE feed_id IS NOT NULL AND seq IS NOT NULL),
x AS (SELECT *, lag(source_time) OVER w AS pt, lag(ok) OVER w AS pok FROM q WINDOW w AS (PARTITION BY feed_id ORDER BY seq, quote_id)),
g AS (SELECT *, sum(CASE WHEN ok AND pok AND pt = source_time THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id ORDER BY seq, quote_id) AS g FROM x),
mine AS (SELECT DISTINCT feed_id, min(seq) AS first_seq, max(seq) AS last_seq, max(source_time) AS ts_ms, min(bid) AS bid_min, max(ask) AS ask_max FROM g GROUP BY feed_id, g HAVING bool_and(ok)),
given AS (SELECT DISTINCT feed_id, first_seq, last_seq, ts_ms, bid_min, ask_max FROM quote_groups WHERE eligible)"""
SQL["replay_difference"] = f"""WITH {_TIES}, d AS (SELECT 'first' AS side, * FROM (SELECT * FROM mine EXCEPT SELECT * FROM given) UNION ALL SELECT 'second', * FROM (SELECT * FROM given EXCEPT SELECT * FROM mine))
SELECT side, count(*) AS rows FROM d GROUP BY 1"""
# The optimum of every prefix, carried along as lists: fine for the rows of a small table.
SQL["schedule_weighted"] = f"""WITH RECURSIVE {_SPANS},
w AS (SELECT book_id, a, z, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY book_id ORDER BY z, a, trade_id) AS i FROM sp WHERE outcome = 'take_profit' AND value > 0),
p AS (SELECT w.*, (SELECT count(*) FROM w x WHERE x.book_id = w.book_id AND x.z <= w.a) AS k FROM w),
c AS (
  SELECT DISTINCT book_id, 0::BIGINT AS i, [0::BIGINT] AS vs, [0::BIGINT] AS ds, [0::BIGINT] AS ns FROM w
  UNION ALL
  SELECT book_id, i, list_append(vs, CASE WHEN take THEN nv ELSE vs[i] END), list_append(ds, CASE WHEN take THEN nd ELSE ds[i] END), list_append(ns, CASE WHEN take THEN ns[k + 1] + 1 ELSE ns[i] END)
  FROM (SELECT p.book_id, p.i, p.k, vs, ds, ns, vs[k + 1] + value AS nv, ds[k + 1] + z - a AS nd, nv > vs[p.i] OR (nv = vs[p.i] AND nd < ds[p.i]) AS take
        FROM c JOIN p ON p.book_id = c.book_id AND p.i = c.i + 1))
SELECT book_id, ns[-1] AS trades, vs[-1] AS value, ds[-1] AS seconds FROM c QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY i DESC) = 1"""
