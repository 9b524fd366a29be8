"""SQL (DuckDB dialect) the problem queries are checked with."""

_GRID = """
WITH bars AS (
  SELECT f.feed_id, CAST(f.bar_seconds AS BIGINT) AS step, CAST(epoch(c.minute_ts) AS BIGINT) AS b
  FROM feeds f JOIN session_clock c
    ON c.active AND c.minute_ts >= f.first_ts AND c.minute_ts < f.last_ts
   AND CAST(epoch(c.minute_ts) AS BIGINT) % f.bar_seconds = 0),
seen AS (
  SELECT c.feed_id, epoch_us(c.ts) AS t, CAST(c.close_px AS DOUBLE) AS v, c.ingested_at, c.candle_id,
         (epoch_us(c.ts) // (CAST(f.bar_seconds AS BIGINT) * 1000000)) * f.bar_seconds AS b
  FROM candles c JOIN feeds f USING (feed_id) WHERE c.ts IS NOT NULL AND c.close_px IS NOT NULL),
best AS (
  SELECT feed_id, b, t, v FROM seen
  QUALIFY row_number() OVER (PARTITION BY feed_id, b ORDER BY ingested_at DESC NULLS LAST, candle_id DESC NULLS LAST, t DESC) = 1)
"""

SQL: dict[str, str] = {
    "p1_found": _GRID
    + """
SELECT bars.feed_id, bars.b AS bar_s FROM bars LEFT JOIN best USING (feed_id, b) WHERE best.t IS NULL""",
    "p1_grid": _GRID
    + """
, around AS (
  SELECT g.feed_id, g.step, g.b, o.t AS ot, o.v AS ov, p.t AS pt, p.v AS pv, q.t AS qt, q.v AS qv
  FROM bars g LEFT JOIN best o ON o.feed_id = g.feed_id AND o.b = g.b
  ASOF LEFT JOIN best p ON p.feed_id = g.feed_id AND p.b < g.b
  ASOF LEFT JOIN best q ON q.feed_id = g.feed_id AND q.b > g.b)
SELECT feed_id, b AS bar_s,
  CASE WHEN ot IS NOT NULL THEN 'observed' WHEN qt - pt <= step * 6000000 THEN 'interpolated' ELSE 'missing' END AS mark,
  CASE WHEN ot IS NOT NULL THEN ov WHEN qt - pt <= step * 6000000
    THEN pv + (qv - pv) * (CAST(b * 1000000 - pt AS DOUBLE) / CAST(qt - pt AS DOUBLE)) END AS value
FROM around""",
    "p2_found": r"""
WITH l AS (SELECT line_id, file_name, line_no, regexp_replace(coalesce(raw, ''), '\r$', '') AS raw FROM raw_lines),
bare AS (SELECT *, len(raw) - len(replace(raw, ',', '')) + 1 AS n, replace(raw, '"', '') AS names FROM l),
h AS (SELECT file_name, n AS want, names AS heading FROM bare WHERE line_no = 1),
x AS (
  SELECT b.line_id, b.n, want,
    list_transform(string_split(raw, ','), lambda f: trim(f)) AS f
  FROM bare b JOIN h USING (file_name) WHERE line_no > 1 AND names <> heading),
u AS (
  SELECT *, list_transform(f, lambda v: CASE WHEN len(v) >= 2 AND v[1] = '"' AND v[-1] = '"' THEN trim(v[2:-2]) ELSE v END) AS v FROM x),
k AS (
  SELECT line_id, n <> want OR len(list_filter(v, lambda y: contains(y, '"'))) > 0
      OR NOT regexp_full_match(v[1], '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|\+00:00)')
      OR try_cast(replace(left(v[1], 19), 'T', ' ') AS TIMESTAMP) IS NULL
      OR len(list_filter(v[2:5], lambda y: NOT regexp_full_match(y, '[0-9]+(\.[0-9]+)?'))) > 0
      OR (n = 6 AND NOT regexp_full_match(v[6], '([0-9]+(\.[0-9]+)?)?')) AS bad,
    try_cast(v[2] AS DECIMAL(38,18)) AS o, try_cast(v[3] AS DECIMAL(38,18)) AS h,
    try_cast(v[4] AS DECIMAL(38,18)) AS l, try_cast(v[5] AS DECIMAL(38,18)) AS c FROM u)
SELECT line_id FROM k
WHERE bad OR coalesce(least(o, h, l, c) <= 0 OR l > least(o, c) OR h < greatest(o, c), TRUE)""",
    "p5_found": """
WITH info AS (SELECT trade_id, max(info_ends) AS i FROM label_dataset GROUP BY 1),
t AS (
  SELECT book_id, CAST(epoch(entry_time) AS BIGINT) AS s, greatest(CAST(epoch(end_time) AS BIGINT), i) AS e
  FROM trades LEFT JOIN info USING (trade_id)),
r AS (
  SELECT *, max(e) OVER (PARTITION BY book_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM t WHERE e > s AND book_id IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY s, e) AS k FROM r),
p AS (SELECT book_id, k, min(s) AS a, max(e) AS b FROM g GROUP BY 1, 2),
n AS (SELECT *, lead(a) OVER (PARTITION BY book_id ORDER BY a) AS nxt FROM p)
SELECT book_id, 'period' AS kind, a AS from_s, b AS to_s FROM p
UNION ALL SELECT book_id, 'gap', b, nxt FROM n WHERE nxt IS NOT NULL""",
}

_DAYS = """
WITH life AS (
  SELECT feed_id, epoch_us(first_ts) // 86400000000 AS d0, (epoch_us(last_ts) - 1) // 86400000000 AS d1 FROM feeds WHERE first_ts < last_ts),
daily AS (
  SELECT feed_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n, sum(close_px) AS total
  FROM candles WHERE ts IS NOT NULL AND close_px IS NOT NULL GROUP BY 1, 2),
dense AS (SELECT feed_id, d0, unnest(generate_series(d0 - 29, d1)) AS day FROM life),
j AS (SELECT feed_id, d0, day, coalesce(n, 0) AS n, total FROM dense LEFT JOIN daily USING (feed_id, day)),
w AS (
  SELECT feed_id, d0, day, n, sum(n) OVER a AS n7, sum(total) OVER a AS s7, sum(n) OVER b AS n30, sum(total) OVER b AS s30
  FROM j WINDOW a AS (PARTITION BY feed_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
               b AS (PARTITION BY feed_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""
#: Lines that are no reject of p2_found, typed.
SQL["p2_candles"] = (
    "WITH bad AS (" + SQL["p2_found"] + r"""),
v AS (
  SELECT line_id, list_transform(string_split(regexp_replace(raw, '\r$', ''), ','), lambda f: trim(replace(trim(f), '"', ''))) AS v
  FROM raw_lines WHERE line_no > 1 AND line_id NOT IN (SELECT line_id FROM bad))
SELECT line_id, CAST(epoch(CAST(replace(left(v[1], 19), 'T', ' ') AS TIMESTAMP)) AS BIGINT) AS ts_s,
  CAST(v[2] AS DECIMAL(18,8)) AS open, CAST(v[3] AS DECIMAL(18,8)) AS high, CAST(v[4] AS DECIMAL(18,8)) AS low, CAST(v[5] AS DECIMAL(18,8)) AS close,
  try_cast(nullif(v[6], '') AS DOUBLE) AS volume
FROM v WHERE v[1] <> 'timestamp'"""
)
SQL["p6_found"] = _DAYS + "SELECT feed_id, CAST(day * 86400 AS BIGINT) AS day_s FROM w WHERE day >= d0 AND n = 0 AND n7 > 0"
SQL["p6_rolling"] = (
    _DAYS
    + """
SELECT feed_id, CAST(day * 86400 AS BIGINT) AS day_s, n AS n_1d, CAST(n7 AS BIGINT) AS n_7d, CAST(s7 AS DOUBLE) AS sum_7d,
  CAST(s7 AS DOUBLE) / nullif(n7, 0) AS mean_7d, CAST(n30 AS BIGINT) AS n_30d,
  CAST(s30 AS DOUBLE) AS sum_30d, CAST(s30 AS DOUBLE) / nullif(n30, 0) AS mean_30d
FROM w WHERE day >= d0"""
)

def _run(series: str, pick: str) -> str:
    """Rows of runs of one value over stamps in a row; of several values at one stamp the first or the last by id (``pick``)."""
    return f"""(
  SELECT p.tab, p.id FROM p JOIN (
    SELECT tab, feed, t, v, count(*) OVER (PARTITION BY tab, feed, v, k) AS len
    FROM (SELECT tab, feed, t, v, row_number() OVER (PARTITION BY tab, feed ORDER BY t) - row_number() OVER (PARTITION BY tab, feed, v ORDER BY t) AS k
          FROM (SELECT tab, feed, t, {pick}(v, id) AS v FROM p WHERE series = '{series}' GROUP BY ALL))) r USING (tab, feed, t, v)
  WHERE series = '{series}' AND len >= CASE p.tab WHEN 'candles' THEN 10 ELSE 20 END)"""


def _spikes(known: str) -> str:
    """Candidates far from the levels just before and after, those of rows that are no case by the round before."""
    w = "PARTITION BY tab, feed ORDER BY t, id ROWS BETWEEN"
    far = "abs({0} - a) > 12 * scale AND abs({0} - z) > 12 * scale"
    return f"""(
  SELECT tab, id FROM (
    SELECT *, last_value(sound IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(sound IGNORE NULLS) OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z
    FROM (SELECT c.*, CASE WHEN NOT bad AND NOT held AND k.id IS NULL THEN level END AS sound FROM c LEFT JOIN {known} k ON k.tab = c.tab AND k.id = c.id))
  WHERE near AND scale > 0 AND (({far.format('hi')}) OR ({far.format('lo')})))"""


# Candidates are rows far from both local medians; the set that judges itself is unrolled, and does not change in the last round.
SQL["p3_found"] = f"""WITH r AS (
  SELECT 'candles' AS tab, feed_id AS feed, candle_id AS id, epoch_us(ts) AS t, CAST(high_px AS DOUBLE) AS hi, CAST(low_px AS DOUBLE) AS lo, CAST(close_px AS DOUBLE) AS level, CAST(high_px - low_px AS DOUBLE) AS width,
    coalesce(high_px <= 0, FALSE) OR coalesce(low_px <= 0, FALSE) OR coalesce(high_px < open_px, FALSE) OR coalesce(high_px < close_px, FALSE) OR coalesce(high_px < low_px, FALSE)
      OR coalesce(low_px > open_px, FALSE) OR coalesce(low_px > close_px, FALSE) AS bad FROM candles WHERE ts IS NOT NULL AND feed_id IS NOT NULL
  UNION ALL
  SELECT 'quote_groups', feed_id, group_id, ts_ms * 1000, CAST(ask_max AS DOUBLE), CAST(bid_min AS DOUBLE), CAST(bid_min AS DOUBLE) / 2 + CAST(ask_max AS DOUBLE) / 2, CAST(ask_max - bid_min AS DOUBLE),
    coalesce(bid_min <= 0, FALSE) OR coalesce(ask_max <= 0, FALSE) OR coalesce(ask_max < bid_min, FALSE) FROM quote_groups WHERE ts_ms IS NOT NULL AND feed_id IS NOT NULL),
p AS MATERIALIZED (
  SELECT tab, feed, id, t, 'hi' AS series, CAST(hi AS VARCHAR) AS v FROM r WHERE tab = 'candles' AND hi IS NOT NULL
  UNION ALL SELECT tab, feed, id, t, 'lo', CAST(lo AS VARCHAR) FROM r WHERE tab = 'candles' AND lo IS NOT NULL
  UNION ALL SELECT tab, feed, id, t, 'pair', CAST(lo AS VARCHAR) || '/' || CAST(hi AS VARCHAR) FROM r WHERE tab = 'quote_groups' AND lo IS NOT NULL AND hi IS NOT NULL),
stuck AS MATERIALIZED ({" UNION ".join(f"SELECT * FROM {_run(x, y)}" for x in ("hi", "lo", "pair") for y in ("arg_min", "arg_max"))}),
sc AS (SELECT tab, feed, median(width) AS scale FROM r GROUP BY ALL),
b AS (
  SELECT r.*, scale, s.id IS NOT NULL AS held, median(CASE WHEN NOT bad THEN level END) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS ma,
    median(CASE WHEN NOT bad THEN level END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS mz
  FROM r LEFT JOIN sc USING (tab, feed) LEFT JOIN stuck s ON s.tab = r.tab AND s.id = r.id WINDOW w AS (PARTITION BY r.tab, r.feed ORDER BY t, r.id)),
c AS MATERIALIZED (
  SELECT *, coalesce(greatest(least(abs(hi - coalesce(ma, mz)), abs(hi - coalesce(mz, ma))), least(abs(lo - coalesce(ma, mz)), abs(lo - coalesce(mz, ma)))) > 6 * scale, FALSE) AS near FROM b),
s0 AS MATERIALIZED (SELECT tab, id FROM c WHERE near),
""" + ",\n".join(f"s{k} AS MATERIALIZED {_spikes(f's{k - 1}')}" for k in range(1, 7)) + """
SELECT tab, id AS rec_id FROM s6 UNION SELECT tab, id FROM stuck UNION SELECT tab, id FROM c WHERE bad"""
