"""The same queries in ANSI SQL, over views of the same tables."""

from __future__ import annotations

from dayweave.plans import queries as q

# Rounding is written out, because the engines' own functions treat ties differently; ties,
# and what lies below them by a summing error only, go up.
_LI = """li AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey,
         l_extendedprice AS spon, NULLIF(l_quantity, 13) AS an, CAST(l_shipdate AS DATE) AS day
  FROM lineitem)"""
_NAMED = f"""{_LI}, named AS (
  SELECT * REPLACE (NULLIF(l_suppkey, {q.UNNAMED}) AS l_suppkey, NULLIF(l_linenumber, {q.UNNAMED}) AS l_linenumber)
  FROM li)"""
_NA = f"""{_LI}, na AS (
  SELECT l_returnflag, l_linestatus, n_name, day, spon, an
  FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
_EV = """ev AS (
  SELECT event_type, user_id, value AS spon,
         NULLIF(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), 13) AS an,
         CAST(ts AS DATE) AS day
  FROM events)"""
_STRICT = """CASE WHEN count(*) = count(spon) THEN avg(spon) END AS mean_spon,
         CASE WHEN count(*) = count(an) THEN avg(an) END AS mean_an"""
_PANEL = "l_returnflag, l_linestatus"
_ROUNDED = "floor(mean_spon * 1e6 + 501e-3) / 1e6 AS mean_spon, floor(mean_an * 1e6 + 501e-3) / 1e6 AS mean_an"


def _values(rows) -> str:
    def literal(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v) if isinstance(v, int) else f"DATE '{v}'"

    return "VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def _window(source: str, account: str, exclude: str = "") -> str:
    return f"""spans AS (
  SELECT {_PANEL}, {account}, min(day) AS min_val, max(day) AS max_val
  FROM {source} GROUP BY {_PANEL}, {account}),
win AS (
  SELECT {_PANEL}, max(min_val) AS lo, min(max_val) AS hi
  FROM spans {exclude} GROUP BY {_PANEL} HAVING max(min_val) <= min(max_val))"""


def _clip(source: str, account: str) -> str:
    return f"""{_window(source, account)},
clip AS (
  SELECT {source}.* FROM {source} JOIN win USING ({_PANEL}) WHERE day BETWEEN lo AND hi)"""


def _daily(source: str, keys: str) -> str:
    return f"daily AS (SELECT {keys}, day, {_STRICT} FROM {source} GROUP BY {keys}, day)"


def _bounds(source: str, panel: str) -> str:
    return f"""bounds AS (
  SELECT {panel}, min(day) AS lo, max(day) AS hi FROM {source} GROUP BY {panel}),
calendar AS (
  SELECT {panel}, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM bounds)"""


_COMPLETE_EVENTS = f"""{_EV}, {_daily("ev", "event_type, user_id")}, {_bounds("ev", "event_type")},
accounts AS (SELECT DISTINCT event_type, user_id FROM ev),
completed AS (
  SELECT event_type, user_id, day, CAST(date_diff('day', lo, day) AS INTEGER) AS t,
         mean_spon, mean_an
  FROM calendar JOIN accounts USING (event_type)
  LEFT JOIN daily USING (event_type, user_id, day))"""

_HOURS = f"""timed AS (
  SELECT *, date_trunc('hour', moment) AS hour
  FROM (SELECT event_id, event_type, user_id % {q.GROUPS} AS users, value AS spon,
               CASE WHEN event_id % 50 <> 7 THEN date_trunc('second', ts::TIMESTAMP) END AS moment FROM events)),
win AS (
  SELECT event_type, max(first_hour) AS lo, min(last_hour) AS hi
  FROM (SELECT event_type, users, min(hour) AS first_hour, max(hour) AS last_hour FROM timed GROUP BY event_type, users)
  GROUP BY event_type HAVING max(first_hour) <= min(last_hour))"""

_HOURLY_MEANS = f"""{_HOURS}, means AS (
  SELECT event_type, users, hour, avg(spon) AS mean FROM timed WHERE hour IS NOT NULL GROUP BY event_type, users, hour),
hours AS (
  SELECT event_type, a, CAST(unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour
  FROM (SELECT event_type, min(hour) AS a, max(hour) AS b FROM means GROUP BY event_type)),
hourly AS (
  SELECT event_type, users, hour, date_diff('hour', a, hour) AS t, coalesce(mean, 0) AS x
  FROM hours JOIN (SELECT DISTINCT event_type, users FROM means) USING (event_type) LEFT JOIN means USING (event_type, users, hour))"""

_NATION_SERIES = f"""{_NA}, {_daily("na", _PANEL + ", n_name")}, {_bounds("na", _PANEL)},
filled AS (
  SELECT {_PANEL}, nation.n_name, day, CAST(date_diff('day', lo, day) AS INTEGER) AS t,
         coalesce(mean_spon, 0) AS mean_spon, coalesce(mean_an, 0) AS mean_an
  FROM calendar CROSS JOIN nation LEFT JOIN daily USING ({_PANEL}, n_name, day)),
series AS (
  SELECT {_PANEL}, n_name, day, t, 'Spon' AS measure, mean_spon AS value FROM filled
  UNION ALL
  SELECT {_PANEL}, n_name, day, t, 'An', mean_an FROM filled)"""


def _wide(label: str, mean: str, columns: list[tuple[str, str]], where: str = "") -> str:
    cells = ",\n  ".join(
        f"floor(coalesce(max(CASE WHEN n_name = '{name}' THEN {mean} END), 0) * 1e6 + 501e-3) / 1e6 AS \"{column}_{label}\""
        for name, column in columns
    )
    return f"""WITH {_NA}, {_clip("na", "n_name")}, {_daily("clip", _PANEL + ", n_name")},
{_bounds("clip", _PANEL)}
SELECT {_PANEL}, day, CAST(date_diff('day', lo, day) AS INTEGER) AS t,
  {cells}
FROM calendar LEFT JOIN daily USING ({_PANEL}, day) {where}
GROUP BY {_PANEL}, day, lo"""


def _loess_days(source: str, keys: str, labels: list[tuple[str, str]]) -> str:
    days = "\n  UNION ALL\n  ".join(
        f"SELECT {keys}, '{label}' AS measure, CAST(date_diff('day', DATE '1970-01-01', day) AS INTEGER) AS x,\n"
        f"         count({column}) AS n, fsum({column}) AS total\n"
        f"  FROM {source} WHERE {column} IS NOT NULL GROUP BY {keys}, day"
        for label, column in labels
    )
    return f"""days AS (
  {days})"""


# From points `g` of a curve, numbered `grid_idx`, to values and slopes there. fsum is DuckDB's
# compensated sum; the plain one is off in the 14th digit here.
def _loess_fits(points: str, group: str) -> str:
    return f"""near AS (
  SELECT {group}, grid_idx, g, rows_all, x - g AS away, abs(x - g) AS distance, n, total,
         sum(n) OVER (PARTITION BY {group}, grid_idx ORDER BY abs(x - g)
                      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM {points} JOIN days USING ({group})),
scaled AS (
  SELECT *, min(CASE WHEN reached >= least(rows_all, floor(0.7::DOUBLE * rows_all + 1e-5::DOUBLE)) THEN distance END)
            OVER (PARTITION BY {group}, grid_idx) AS h
  FROM near),
units AS (
  SELECT {group}, grid_idx, g, h, n, total,
         CASE WHEN distance < h THEN away / h ELSE 1 END AS u FROM scaled),
weighted AS (
  SELECT *, (1 - abs(u * u * u)) * (1 - abs(u * u * u)) * (1 - abs(u * u * u)) AS w FROM units),
centred AS (
  SELECT *, fsum(w * n) OVER g AS s0, u - fsum(w * n * u) OVER g / fsum(w * n) OVER g AS d,
         fsum(w * n * u) OVER g / fsum(w * n) OVER g AS mean_u,
         fsum(w * total) OVER g / fsum(w * n) OVER g AS level
  FROM weighted WINDOW g AS (PARTITION BY {group}, grid_idx)),
spread AS (
  SELECT *, fsum(w * n * d * d) OVER g AS m2, fsum(w * n * d * d * d) OVER g AS m3
  FROM centred WINDOW g AS (PARTITION BY {group}, grid_idx)),
orthogonal AS (
  SELECT *, d * d - m3 / m2 * d - m2 / s0 AS p2, w * (total - n * level) AS rest FROM spread),
solved AS (
  SELECT {group}, grid_idx, g, count(CASE WHEN w > 0 THEN 1 END) AS m, s0,
         fsum(w * n * p2 * p2) AS q2,
         level - fsum(rest * d) / m2 * mean_u
           + fsum(rest * p2) / fsum(w * n * p2 * p2)
             * (mean_u * mean_u + m3 / m2 * mean_u - m2 / s0) AS top,
         (fsum(rest * d) / m2 - fsum(rest * p2) / fsum(w * n * p2 * p2) * (2 * mean_u + m3 / m2)) / h AS slope
  FROM orthogonal GROUP BY {group}, grid_idx, g, h, s0, m2, m3, mean_u, level)"""


_SOLVABLE = "m >= 3 AND q2 > 1e-9::DOUBLE * s0"


def _grid(group: str) -> str:
    return f"""grid AS (
  SELECT {group}, lo, hi, rows_all, grid_idx, lo + grid_idx * (hi - lo) / 79.0::DOUBLE AS g
  FROM (SELECT {group}, min(x) AS lo, max(x) AS hi, sum(n) AS rows_all FROM days GROUP BY {group})
  CROSS JOIN (SELECT unnest(range(80)) AS grid_idx)
  WHERE lo < hi)"""


def _loess(before: str, source: str, keys: str, labels: list[tuple[str, str]], month: str) -> str:
    group = f"{keys}, measure"
    return f"""WITH {before},
{_loess_days(source, keys, labels)},
{_grid(group)},
{_loess_fits("grid", group)}
SELECT {group}, CAST(grid_idx AS INTEGER) AS grid_idx, floor(g * 1e4 + 501e-3) / 1e4 AS x_day,
       floor((CASE WHEN {_SOLVABLE} THEN top END) * 1e4 + 501e-3) / 1e4 AS fit{month}
FROM solved"""


def _loess_interpolated(before: str, source: str, keys: str, labels: list[tuple[str, str]]) -> str:
    group = f"{keys}, measure"
    return f"""WITH RECURSIVE {before},
{_loess_days(source, keys, labels)},
{_grid(group)},
stretched AS (
  SELECT {group}, flatten(list(repeat([x], n) ORDER BY x)) AS xs FROM days GROUP BY {group} HAVING min(x) < max(x)),
cells AS (
  SELECT {group}, xs, floor(len(xs) * 0.7::DOUBLE * 0.2::DOUBLE) AS most, 1::BIGINT AS l, len(xs)::BIGINT AS u, NULL::DOUBLE AS cut
  FROM stretched
  UNION ALL
  SELECT {group}, xs, most, unnest([l, s + 1]), unnest([s, u]), (xs[s] + xs[s + 1]) / 2
  FROM (
    SELECT *, CASE WHEN k % 2 = 0 THEN mid + k // 2 ELSE mid - k // 2 END AS s
    FROM (
      SELECT *, (l + u) // 2 AS mid,
             list_min(list_transform(list_filter(range(l, u), lambda i: xs[i] <> xs[i + 1]),
                                     lambda i: 2 * abs(i - (l + u) // 2) + CASE WHEN i < (l + u) // 2 THEN 1 ELSE 0 END)) AS k
      FROM cells WHERE u - l + 1 > most)
    WHERE k IS NOT NULL)),
boxes AS (
  SELECT {group}, xs[1] AS lo, xs[-1] AS hi, len(xs) AS rows_all,
         greatest(xs[-1] - xs[1], greatest(abs(xs[1]), abs(xs[-1])) * 1e-3::DOUBLE + 1e-30::DOUBLE) AS spread FROM stretched),
ends AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY g) AS grid_idx
  FROM (
    SELECT DISTINCT {group}, cut AS g, rows_all FROM cells JOIN boxes USING ({group}) WHERE cut IS NOT NULL
    UNION ALL SELECT {group}, lo - 0.005::DOUBLE * spread, rows_all FROM boxes
    UNION ALL SELECT {group}, hi + 0.005::DOUBLE * spread, rows_all FROM boxes)),
{_loess_fits("ends", group)},
fitted AS MATERIALIZED (
  SELECT {group}, g, CASE WHEN {_SOLVABLE} THEN top END AS top, CASE WHEN {_SOLVABLE} THEN slope END AS slope FROM solved),
between_ends AS (
  SELECT {group}, g AS a, top AS top_a, slope AS slope_a, lead(g) OVER e AS b, lead(top) OVER e AS top_b, lead(slope) OVER e AS slope_b
  FROM fitted WINDOW e AS (PARTITION BY {group} ORDER BY g)),
placed AS (
  SELECT {group}, grid.grid_idx, grid.g, between_ends.* EXCLUDE ({group}), (grid.g - a) / (b - a) AS p
  FROM grid JOIN between_ends USING ({group}) WHERE a <= grid.g AND grid.g < b)
SELECT {group}, CAST(grid_idx AS INTEGER) AS grid_idx, floor(g * 1e4 + 501e-3) / 1e4 AS x_day,
       floor(((1 - p) * (1 - p) * (1 + 2 * p) * top_a + p * p * (3 - 2 * p) * top_b
              + (b - a) * (p * (1 - p) * (1 - p) * slope_a - p * p * (1 - p) * slope_b)) * 1e4 + 501e-3) / 1e4 AS fit
FROM placed"""


_EVENT_MONTH = ",\n       strftime(DATE '1970-01-01' + CAST(floor(g) AS INTEGER), '%b-%y') AS month"
_NATION_COLUMNS = [(n, n) for n in q.NATION_NAMES]
_NATION_CELLS = ", ".join(
    f"floor(max(CASE WHEN n_name = '{n}' THEN value END) * 1e6 + 501e-3) / 1e6 AS \"{n}\"" for n in q.NATION_NAMES
)
_ONE_PANEL_COLUMNS = [(name, f"AF_{alias}") for _, _, name, alias in q.ONE_PANEL_PICKS]
_DROPPED = f"({', '.join(map(str, q.TWO_NAMES))})"

_CSV = """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey,
       CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, l_linestatus,
       CAST(l_suppkey AS VARCHAR) AS l_suppkey, l_extendedprice AS spon,
       NULLIF(l_quantity, 13) AS an, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate,
       CAST(l_shipdate AS DATE) AS day
FROM lineitem"""
_CSV_TEXT = """SELECT lang, CAST(doc_id AS VARCHAR) AS doc_id,
       CAST(n_chars AS DOUBLE) AS n_chars, source, text FROM documents"""
_STORED = "stored AS (SELECT *, row_number() OVER () AS pos FROM lineitem)"
_UNEVEN = """NOT (pos % 2 = 0 AND t < 40) AND NOT (pos % 3 = 0 AND t > 500) AND NOT (pos % 5 = 0 AND t BETWEEN 100 AND 120)"""
_CHAIN = f"""{_LI}, {_daily("li", _PANEL + ", l_suppkey")}, late(f, s, a) AS ({_values(q.LATE)}),
spans AS (
  SELECT {_PANEL}, l_suppkey, min(day) AS first_day, max(day) AS last_day FROM daily GROUP BY {_PANEL}, l_suppkey),
win AS (
  SELECT {_PANEL}, max(first_day) AS lo, min(last_day) AS hi FROM spans
  WHERE ({_PANEL}, l_suppkey) NOT IN (SELECT (f, s, a) FROM late)
  GROUP BY {_PANEL} HAVING max(first_day) <= min(last_day)),
kept AS (
  SELECT daily.* FROM daily JOIN win USING ({_PANEL}) JOIN spans USING ({_PANEL}, l_suppkey)
  WHERE day BETWEEN lo AND hi AND first_day <> lo AND last_day <> hi),
{_bounds("kept", _PANEL)},
picks(l_returnflag, l_linestatus, l_suppkey, alias) AS ({_values(q.CHAIN_PICKS)}),
filled AS (
  SELECT {_PANEL}, l_suppkey, alias, CAST(date_diff('day', lo, day) AS INTEGER) AS t, day,
         coalesce(mean_spon, 0) AS mean_spon, coalesce(mean_an, 0) AS mean_an
  FROM calendar JOIN picks USING ({_PANEL}) LEFT JOIN kept USING ({_PANEL}, l_suppkey, day))"""

ORACLE = {
    "project_fields": f"WITH {_LI} SELECT {_PANEL}, l_suppkey, day, spon, an FROM li",
    "day_from_text": """WITH w AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN props
                        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS written FROM events)
SELECT event_id, written, TRY_CAST(substr(written, 1, 10) AS DATE) AS day FROM w""",
    "panel_values": "SELECT DISTINCT l_returnflag FROM lineitem",
    "panel_sizes": f"SELECT {_PANEL}, count(*) AS n FROM lineitem GROUP BY {_PANEL}",
    "one_panel": f"WITH {_LI} SELECT * FROM li WHERE l_returnflag = 'A' AND l_linestatus = 'F'",
    "panel_codes": """SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS panel
FROM lineitem""",
    "frequency_table": f"""SELECT {_PANEL}, l_linenumber, count(*) AS n FROM lineitem
GROUP BY {_PANEL}, l_linenumber""",
    "account_span": f"""WITH {_LI}, dated AS (
  SELECT * REPLACE (CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN NULL ELSE day END AS day) FROM li)
SELECT {_PANEL}, l_suppkey, CASE WHEN count(*) = count(day) THEN min(day) END AS min_val,
       CASE WHEN count(*) = count(day) THEN max(day) END AS max_val
FROM dated GROUP BY {_PANEL}, l_suppkey""",
    "common_window": f"WITH {_LI}, {_window('li', 'l_suppkey')} SELECT * FROM win",
    "common_window_excluding": f"""WITH {_LI}, late(f, s, a) AS ({_values(q.LATE)}), {_window(
        "li", "l_suppkey",
        f"WHERE ({_PANEL}, l_suppkey) NOT IN (SELECT (f, s, a) FROM late)")} SELECT * FROM win""",
    "clip_to_window": f"WITH {_LI}, {_clip('li', 'l_suppkey')} SELECT * FROM clip",
    "clip_given_windows": f"""WITH {_LI}, given(l_returnflag, l_linestatus, lo, hi) AS ({_values(q.WINDOWS)})
SELECT li.* FROM li JOIN given USING ({_PANEL}) WHERE day BETWEEN lo AND hi""",
    "daily_mean_strict": f"""WITH {_LI}, {_clip("li", "l_suppkey")}, {_daily("clip", _PANEL + ", l_suppkey")}
SELECT {_PANEL}, l_suppkey, day, {_ROUNDED} FROM daily""",
    "daily_mean_skip_missing": f"""WITH {_NA}
SELECT {_PANEL}, n_name, day, floor(avg(spon) * 1e6 + 501e-3) / 1e6 AS mean_spon, floor(avg(an) * 1e6 + 501e-3) / 1e6 AS mean_an
FROM na GROUP BY {_PANEL}, n_name, day""",
    "daily_mean_rows": f"""WITH {_LI}, rows_with_mean AS (
  SELECT *, avg(spon) OVER d AS mean_spon,
         CASE WHEN count(*) OVER d = count(an) OVER d THEN avg(an) OVER d END AS mean_an
  FROM li WINDOW d AS (PARTITION BY {_PANEL}, l_suppkey, day))
SELECT * REPLACE ({_ROUNDED}) FROM rows_with_mean""",
    "distinct_rows": f"""WITH {_EV}, {_daily("ev", "event_type, user_id")}
SELECT event_type, user_id, day, {_ROUNDED} FROM daily""",
    "active_days": f"""WITH {_LI} SELECT {_PANEL}, l_suppkey, count(DISTINCT day) AS n
FROM li GROUP BY {_PANEL}, l_suppkey""",
    "min_active_days": f"""WITH {_LI} SELECT {_PANEL}, l_suppkey, count(DISTINCT day) AS n
FROM li GROUP BY {_PANEL}, l_suppkey HAVING count(DISTINCT day) >= {q.LEAST_DAYS}""",
    "drop_sparse_accounts": f"""WITH {_LI}, {_daily("li", _PANEL + ", l_suppkey")}
SELECT {_PANEL}, l_suppkey, day, {_ROUNDED} FROM daily JOIN (
  SELECT {_PANEL}, l_suppkey FROM daily GROUP BY {_PANEL}, l_suppkey HAVING count(*) >= {q.LEAST_DAYS})
USING ({_PANEL}, l_suppkey)""",
    "drop_account": f"WITH {_NAMED} SELECT * FROM named WHERE l_suppkey <> {q.DROPPED_NAME}",
    "drop_any_ne_literal": f"""WITH {_NAMED} SELECT * FROM named
WHERE CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_suppkey <> 3 OR l_suppkey <> 5
           WHEN l_returnflag = 'N' AND l_linestatus = 'O'
           THEN l_suppkey <> 1 OR l_suppkey <> 7 OR l_suppkey <> 8
           ELSE TRUE END""",
    "drop_any_ne_one_table": f"""WITH {_NAMED} SELECT * FROM named
WHERE {" OR ".join(f"l_suppkey <> {n}" for n in q.TWO_NAMES)}""",
    "drop_accounts_intended": f"""WITH {_NAMED} SELECT * FROM named
WHERE CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_suppkey NOT IN (3, 5)
           WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_suppkey NOT IN (1, 7, 8)
           ELSE TRUE END""",
    "drop_by_other_column": f"""WITH {_NAMED} SELECT * FROM named
WHERE CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_linenumber <> 1
           WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_linenumber <> 2
           ELSE TRUE END""",
    "pick_accounts": f"""WITH {_LI}, picks(l_returnflag, l_linestatus, l_suppkey, alias) AS ({_values(q.PICKS)})
SELECT li.*, alias FROM li JOIN picks USING ({_PANEL}, l_suppkey)""",
    "panel_bounds": f"WITH {_LI}, {_bounds('li', _PANEL)} SELECT * FROM bounds",
    "calendar": f"WITH {_LI}, {_bounds('li', _PANEL)} SELECT {_PANEL}, day FROM calendar",
    "month_label": f"""WITH {_LI}, {_bounds("li", _PANEL)}
SELECT {_PANEL}, day, strftime(day, '%b-%y') AS month FROM calendar""",
    "complete_days": f"""WITH {_COMPLETE_EVENTS}
SELECT event_type, user_id, day, t, {_ROUNDED} FROM completed""",
    "complete_days_given_bounds": f"""WITH {_EV}, {_daily("ev", "event_type, user_id")},
bounds(event_type, lo, hi) AS ({_values(q.BOUNDS)}),
calendar AS (
  SELECT event_type, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds),
accounts AS (SELECT DISTINCT event_type, user_id FROM ev)
SELECT event_type, user_id, day, CAST(date_diff('day', lo, day) AS INTEGER) AS t, {_ROUNDED}
FROM calendar JOIN accounts USING (event_type) LEFT JOIN daily USING (event_type, user_id, day)""",
    "bins_from_text": f"""WITH {_HOURS}
SELECT event_id, CAST(floor(epoch(moment) / {q.QUARTER}) AS BIGINT) AS number,
       strftime(time_bucket(INTERVAL 15 MINUTE, moment), '%Y-%m-%d %H:%M:%S') AS starts FROM timed""",
    "hourly_window": f"""WITH {_HOURS}
SELECT event_type, strftime(lo, '%Y-%m-%d %H:%M:%S') AS lo, strftime(hi, '%Y-%m-%d %H:%M:%S') AS hi FROM win""",
    "hourly_completed": f"""WITH {_HOURS}, inside AS (
  SELECT event_type, users, hour, avg(spon) AS mean FROM timed JOIN win USING (event_type)
  WHERE hour BETWEEN lo AND hi GROUP BY event_type, users, hour),
hours AS (
  SELECT event_type, a, CAST(unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour
  FROM (SELECT event_type, min(hour) AS a, max(hour) AS b FROM inside GROUP BY event_type))
SELECT event_type, users, strftime(hour, '%Y-%m-%d %H:%M:%S') AS starts, CAST(date_diff('hour', a, hour) AS INTEGER) AS t,
       floor(coalesce(mean, 0) * 1e6 + 501e-3) / 1e6 AS mean_spon, mean IS NULL AS "was_filled_Spon"
FROM hours JOIN (SELECT DISTINCT event_type, users FROM inside) USING (event_type) LEFT JOIN inside USING (event_type, users, hour)""",
    "autocorrelations": f"""WITH RECURSIVE {_HOURLY_MEANS}, series AS (
  SELECT event_type, users, hour,
         CASE WHEN event_type = 'signup' THEN 1 WHEN NOT (event_type = 'click' AND users = 3 AND t = 5) THEN x END AS x
  FROM hourly),
centred AS (
  SELECT *, CASE WHEN count(*) OVER s = count(x) OVER s THEN x - avg(x) OVER s END AS d,
         row_number() OVER (PARTITION BY event_type, users ORDER BY hour) AS i
  FROM series WINDOW s AS (PARTITION BY event_type, users)),
products AS (
  SELECT a.event_type, a.users, lag, sum(a.d * b.d) AS c
  FROM centred a CROSS JOIN (SELECT unnest(range({q.LAGS + 1})) AS lag) JOIN centred b
    ON a.event_type = b.event_type AND a.users = b.users AND b.i = a.i + lag
  GROUP BY a.event_type, a.users, lag),
ratios AS (
  SELECT event_type, users, lag, CASE WHEN first_value(c) OVER s > 0 THEN c / first_value(c) OVER s END AS r
  FROM products WINDOW s AS (PARTITION BY event_type, users ORDER BY lag)),
listed AS (SELECT event_type, users, list(r ORDER BY lag) AS r FROM ratios GROUP BY event_type, users),
levinson AS (
  SELECT event_type, users, r, 1 AS k, [r[2]] AS phi FROM listed
  UNION ALL
  SELECT event_type, users, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - new * phi[k + 1 - j]), [new])
  FROM (
    SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
              / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS new
    FROM levinson WHERE k < {q.LAGS}))
SELECT event_type, users, n, CAST(lag AS INTEGER) AS lag, floor(r * 1e6 + 501e-3) / 1e6 AS acf, floor(p * 1e6 + 501e-3) / 1e6 AS pacf
FROM (SELECT event_type, users, lag, ratios.r, phi[k] AS p
      FROM ratios LEFT JOIN levinson USING (event_type, users) WHERE k = greatest(lag, 1) AND lag > 0
      UNION ALL SELECT event_type, users, lag, r, NULL FROM ratios WHERE lag = 0)
JOIN (SELECT event_type, users, count(*) AS n FROM centred GROUP BY event_type, users) USING (event_type, users)""",
    "unit_roots": f"""WITH RECURSIVE {_HOURLY_MEANS},
moved AS (SELECT event_type, users, t, x - avg(x) OVER (PARTITION BY event_type, users) AS y FROM hourly),
steps AS (SELECT *, lag(y) OVER o AS b, y - lag(y) OVER o AS d FROM moved WINDOW o AS (PARTITION BY event_type, users ORDER BY t)),
vectors AS (
  SELECT event_type, users, z FROM (
    SELECT event_type, users, t, [1.0::DOUBLE, t::DOUBLE, b, {", ".join(f"lag(d, {i}) OVER o" for i in range(1, q.DF_LAGS + 1))}, d] AS z
    FROM steps WINDOW o AS (PARTITION BY event_type, users ORDER BY t))
  WHERE t > {q.DF_LAGS}),
products AS (
  SELECT event_type, users, i, j, fsum(z[i] * z[j]) AS s, count(*) AS n
  FROM (SELECT *, unnest(range(1, {q.DF_LAGS + 5})) AS j FROM (SELECT *, unnest(range(1, {q.DF_LAGS + 5})) AS i FROM vectors))
  GROUP BY event_type, users, i, j),
lines AS (
  SELECT event_type, users, lag, i,
         list_concat(list(s ORDER BY j) FILTER (WHERE j <= 3 + lag), list(s) FILTER (WHERE j = {q.DF_LAGS + 4}),
                     list_transform(range(1, 4 + lag), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r
  FROM products CROSS JOIN (SELECT unnest(range({q.DF_LAGS + 1})) AS lag) WHERE i <= 3 + lag GROUP BY event_type, users, lag, i),
matrix AS (
  SELECT event_type, users, lag, list(r ORDER BY i) AS m, list(r[4 + lag] ORDER BY i) AS zy FROM lines GROUP BY event_type, users, lag),
solved AS (
  SELECT *, 1 AS p FROM matrix
  UNION ALL
  SELECT event_type, users, lag, list_transform(range(1, len(m) + 1), lambda i: CASE
           WHEN i = p THEN list_transform(m[p], lambda v: v / m[p][p])
           ELSE list_transform(range(1, len(m[p]) + 1), lambda j: m[i][j] - m[i][p] / m[p][p] * m[p][j]) END), zy, p + 1
  FROM solved WHERE p <= len(m)),
fitted AS (
  SELECT event_type, users, lag, n, m[3][4 + lag] AS b, m[3][7 + lag] AS v,
         s - list_sum(list_transform(range(1, 4 + lag), lambda i: m[i][4 + lag] * zy[i])) AS rest
  FROM solved JOIN products USING (event_type, users) WHERE p = len(m) + 1 AND i = {q.DF_LAGS + 4} AND j = {q.DF_LAGS + 4}),
best AS (
  SELECT event_type, users, n, lag, b / sqrt(v * rest / (n - 3 - lag)) AS statistic FROM fitted
  QUALIFY row_number() OVER (PARTITION BY event_type, users ORDER BY n * ln(rest / n) + 2 * (3 + lag), lag) = 1),
rows AS (
  SELECT *, -3.95877::DOUBLE - 9.0531::DOUBLE / n - 28.428::DOUBLE / n**2 - 134.155::DOUBLE / n**3 AS c1,
         -3.41049::DOUBLE - 4.3904::DOUBLE / n - 9.036::DOUBLE / n**2 - 45.374::DOUBLE / n**3 AS c5,
         -3.12705::DOUBLE - 2.5856::DOUBLE / n - 3.925::DOUBLE / n**2 - 22.380::DOUBLE / n**3 AS c10
  FROM best)
SELECT event_type, users, n, lag, {", ".join(f"floor({c} * 1e6 + 501e-3) / 1e6 AS {name}" for c, name in (("statistic", "statistic"), ("c1", "critical_1"), ("c5", "critical_5"), ("c10", "critical_10")))}
FROM rows""",
    "var_coefficients": f"""WITH RECURSIVE {_HOURLY_MEANS},
centred AS (SELECT *, avg(x) OVER (PARTITION BY event_type, users) AS mean FROM hourly),
vectors AS (
  SELECT event_type, t, list(x - mean ORDER BY users) AS y, list(mean ORDER BY users) AS means, list(users ORDER BY users) AS names
  FROM centred GROUP BY event_type, t),
lagged AS (
  SELECT event_type, means, names, len(y) AS k, list_concat([1.0::DOUBLE], y1, y2, y) AS z
  FROM (SELECT *, lag(y) OVER o AS y1, lag(y, 2) OVER o AS y2 FROM vectors WINDOW o AS (PARTITION BY event_type ORDER BY t))
  WHERE y2 IS NOT NULL),
products AS (
  SELECT event_type, i, j, fsum(z[i] * z[j]) AS s
  FROM (SELECT event_type, z, i, unnest(range(1, len(z) + 1)) AS j FROM (SELECT event_type, z, unnest(range(1, len(z) + 1)) AS i FROM lagged))
  GROUP BY event_type, i, j),
sizes AS (SELECT event_type, any_value(k) AS k, any_value(means) AS means, any_value(names) AS names FROM lagged GROUP BY event_type),
matrix AS (
  SELECT event_type, list(r ORDER BY i) AS m FROM (SELECT event_type, i, list(s ORDER BY j) AS r FROM products GROUP BY event_type, i)
  JOIN sizes USING (event_type) WHERE i <= 2 * k + 1 GROUP BY event_type),
solved AS (
  SELECT event_type, m, 1 AS p FROM matrix
  UNION ALL
  SELECT event_type, list_transform(range(1, len(m) + 1), lambda i: CASE
           WHEN i = p THEN list_transform(m[p], lambda v: v / m[p][p])
           ELSE list_transform(range(1, len(m[p]) + 1), lambda j: m[i][j] - m[i][p] / m[p][p] * m[p][j]) END), p + 1
  FROM solved WHERE p <= len(m)),
b AS (
  SELECT event_type, k, means, names, e, list_transform(m, lambda r: r[2 * k + 1 + e]) AS c
  FROM (SELECT *, unnest(range(1, k + 1)) AS e FROM solved JOIN sizes USING (event_type) WHERE p = len(m) + 1)),
rows AS (
  SELECT event_type, names[e] AS equation, names[e] AS account, 0::BIGINT AS lag,
         c[1] + means[e] - list_sum(list_transform(range(1, 2 * k + 1), lambda i: c[i + 1] * means[(i - 1) % k + 1])) AS v FROM b
  UNION ALL
  SELECT event_type, names[e], names[(i - 1) % k + 1], (i - 1) // k + 1, c[i + 1] FROM (SELECT *, unnest(range(1, 2 * k + 1)) AS i FROM b))
SELECT event_type, equation, account, lag, floor(v * 1e6 + 501e-3) / 1e6 AS coefficient FROM rows""",
    "zero_filled": f"""WITH {_COMPLETE_EVENTS.replace("value AS spon,", "CASE WHEN floor(value) % 5 = 0 THEN 'nan'::DOUBLE ELSE value END AS spon,")}
SELECT event_type, user_id, day, t,
       floor((CASE WHEN isnan(mean_spon) THEN 0 ELSE coalesce(mean_spon, 0) END) * 1e6 + 501e-3) / 1e6 AS mean_spon,
       floor(coalesce(mean_an, 0) * 1e6 + 501e-3) / 1e6 AS mean_an,
       mean_spon IS NULL OR isnan(mean_spon) AS "was_filled_Spon", mean_an IS NULL AS "was_filled_An"
FROM completed""",
    "series_offset": f"""WITH {_COMPLETE_EVENTS}
SELECT event_type, user_id, t, day, 'Spon' AS measure, floor(coalesce(mean_spon, 0) * 1e6 + 501e-3) / 1e6 AS value
FROM completed
UNION ALL
SELECT event_type, user_id, t, day, 'An', floor(coalesce(mean_an, 0) * 1e6 + 501e-3) / 1e6 FROM completed""",
    "series_names": f"""WITH {_COMPLETE_EVENTS}
SELECT event_type || '_' || user_id || '_Spon' AS series, t, day,
       floor(coalesce(mean_spon, 0) * 1e6 + 501e-3) / 1e6 AS value FROM completed
UNION ALL
SELECT event_type || '_' || user_id || '_An', t, day, floor(coalesce(mean_an, 0) * 1e6 + 501e-3) / 1e6
FROM completed""",
    "wide_spon": _wide("Spon", "mean_spon", _NATION_COLUMNS),
    "wide_an": _wide("An", "mean_an", _NATION_COLUMNS),
    "wide_one_panel": _wide(
        "Spon", "mean_spon", _ONE_PANEL_COLUMNS, "WHERE l_returnflag = 'A' AND l_linestatus = 'F'"
    ),
    "loess_curve": _loess(
        f"{_LI}, {_clip('li', 'l_suppkey')}",
        "clip",
        f"{_PANEL}, l_suppkey",
        [("Spon", "spon"), ("An", "an")],
        "",
    ),
    "loess_interpolated": _loess_interpolated(
        f"{_LI}, {_clip('li', 'l_suppkey')}",
        "clip",
        f"{_PANEL}, l_suppkey",
        [("Spon", "spon"), ("An", "an")],
    ),
    "loess_events": _loess(_EV, "ev", "event_type, user_id", [("Spon", "spon")], _EVENT_MONTH),
    "csv_round_trip": _CSV,
    "csv_round_trip_split": _CSV,
    "csv_text_round_trip": _CSV_TEXT,
    "csv_text_by_ranges": _CSV_TEXT,
    "csv_first_seen": """SELECT lang, coalesce(source, 'NA') AS source, row_number() OVER (ORDER BY min(doc_id)) AS place
FROM documents GROUP BY lang, source""",
    "first_seen_values": f"""WITH {_STORED}
SELECT l_returnflag, row_number() OVER (ORDER BY min(pos)) AS place FROM stored GROUP BY l_returnflag""",
    "first_seen_accounts": f"""WITH {_STORED}, named AS (SELECT * REPLACE (NULLIF(l_suppkey, {q.UNNAMED}) AS l_suppkey) FROM stored)
SELECT {_PANEL}, l_suppkey, row_number() OVER (ORDER BY min(pos)) AS place FROM named GROUP BY {_PANEL}, l_suppkey""",
    "panel_numbers": f"""WITH {_STORED},
flags AS (SELECT l_returnflag, row_number() OVER (ORDER BY min(pos)) AS f FROM stored GROUP BY l_returnflag),
states AS (SELECT l_linestatus, row_number() OVER (ORDER BY min(pos)) AS s FROM stored GROUP BY l_linestatus)
SELECT DISTINCT {_PANEL}, (f - 1) * (SELECT count(*) FROM states) + s AS number
FROM stored JOIN flags USING (l_returnflag) JOIN states USING (l_linestatus)""",
    "wide_csv_sink": f"""WITH {_NATION_SERIES}
SELECT t + 1 AS row, 'VARdf_' || l_returnflag || l_linestatus || '_' || measure AS name, {_NATION_CELLS}
FROM series GROUP BY t, l_returnflag, l_linestatus, measure""",
    "wide_csv_uneven": f"""WITH {_NATION_SERIES}, placed AS (
  SELECT *, list_position([{", ".join(f"'{n}'" for n in q.NATION_NAMES)}], n_name) AS pos FROM series)
SELECT t + 1 AS row, 'VARdf_' || l_returnflag || l_linestatus || '_' || measure AS name, {_NATION_CELLS}
FROM placed WHERE {_UNEVEN} GROUP BY t, l_returnflag, l_linestatus, measure""",
    "panel_pipeline": f"""WITH {_CHAIN}
SELECT {_PANEL}, l_suppkey, alias, t, day, 'Spon' AS measure, floor(mean_spon * 1e6 + 501e-3) / 1e6 AS value FROM filled
UNION ALL
SELECT {_PANEL}, l_suppkey, alias, t, day, 'An', floor(mean_an * 1e6 + 501e-3) / 1e6 FROM filled""",
    "daily_sorted": f"""WITH {_LI}, days AS (
  SELECT DISTINCT l_returnflag || l_linestatus AS panel, l_suppkey, day FROM li)
SELECT panel, l_suppkey, day, CAST(row_number() OVER (PARTITION BY panel ORDER BY l_suppkey, day) AS INTEGER) AS place
FROM days""",
}
