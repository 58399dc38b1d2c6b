"""DuckDB SQL for the registered queries: common table expressions and one SELECT per query.

Written from the definitions and independently of the DataFrame code, so that both can be compared.
"""

from __future__ import annotations

import math
import re

from gapgrid.functions.grid import HALF, STEP_Q, STEP_RES, metres_per_degree
from gapgrid.functions.projection import ALPHA, BETA, DELTA, ECC, FALSE_EAST, FALSE_NORTH, RADIUS, SCALE
from gapgrid.operators.zones import MODEL_COLUMNS
from gapgrid.plans.views import FILE_A, FILE_B, FIXTURE_PARAMS as P

KX, KY = metres_per_degree(P)
S3 = math.sqrt(3.0)
T = P.users


# ---- text builders ---------------------------------------------------------

def num(x: float) -> str:
    """Exact double literal."""
    return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)


def celled(src: str, x: str, y: str, name: str, res: int = 8) -> str:
    """Query that adds the hex cell of metres (x, y) to ``src``, by rounding cube coordinates."""
    edge = P.edge_m
    return f"""SELECT * EXCLUDE (_qf,_rf,_q0,_r0,_s0,_dq,_dr,_ds),
      CASE WHEN _qf IS NULL THEN NULL ELSE {res * STEP_RES}
        + (CASE WHEN _dq > _dr AND _dq > _ds THEN -_r0 - _s0 ELSE _q0 END + {HALF}) * {STEP_Q}
        + (CASE WHEN _dq > _dr AND _dq > _ds THEN _r0 WHEN _dr > _ds THEN -_q0 - _s0 ELSE _r0 END + {HALF}) END AS {name}
      FROM (SELECT *, abs(_q0 - _qf) AS _dq, abs(_r0 - _rf) AS _dr, abs(_s0 - (-_qf - _rf)) AS _ds
      FROM (SELECT *, CAST(floor(_qf + 0.5) AS BIGINT) AS _q0, CAST(floor(_rf + 0.5) AS BIGINT) AS _r0,
        CAST(floor((-_qf - _rf) + 0.5) AS BIGINT) AS _s0
      FROM (SELECT *, (({x}) * {num(S3 / 3)} - ({y}) / 3) / {num(edge)} AS _qf, ({y}) * {num(2.0 / 3.0)} / {num(edge)} AS _rf FROM {src})))"""


def pointed(src: str, lat: str, lon: str, name: str) -> str:
    return celled(src, f"(({lon}) - {num(P.centre_lon)}) * {num(KX)}", f"(({lat}) - {num(P.centre_lat)}) * {num(KY)}", name)


def q_of(c: str) -> str:
    return f"((({c}) // {STEP_Q}) % {STEP_Q} - {HALF})"


def r_of(c: str) -> str:
    return f"(({c}) % {STEP_Q} - {HALF})"


def blocked(src: str) -> str:
    """Query that adds the block of each cell: exact cube rounding of the zone position in block units."""
    n = P.block_factor
    return f"""SELECT * EXCLUDE (_q,_r,_q0,_r0,_s0,_dq,_dr,_ds), {P.block_res * STEP_RES}
        + (CASE WHEN _dq > _dr AND _dq > _ds THEN -_r0 - _s0 ELSE _q0 END + {HALF}) * {STEP_Q}
        + (CASE WHEN _dq > _dr AND _dq > _ds THEN _r0 WHEN _dr > _ds THEN -_q0 - _s0 ELSE _r0 END + {HALF}) AS block_id
      FROM (SELECT *, abs({n} * _q0 - _q) AS _dq, abs({n} * _r0 - _r) AS _dr, abs({n} * _s0 + _q + _r) AS _ds
      FROM (SELECT *, CAST(floor((2 * _q + {n}) / {2 * n}) AS BIGINT) AS _q0, CAST(floor((2 * _r + {n}) / {2 * n}) AS BIGINT) AS _r0,
        CAST(floor((2 * (-_q - _r) + {n}) / {2 * n}) AS BIGINT) AS _s0
      FROM (SELECT *, {q_of('cell')} AS _q, {r_of('cell')} AS _r FROM {src})))"""


def cx(c: str) -> str:
    return f"(({q_of(c)} + {r_of(c)} / 2) * {num(S3 * P.edge_m)})"


def cy(c: str) -> str:
    return f"({r_of(c)} * {num(1.5 * P.edge_m)})"


def clat(c: str) -> str:
    return f"({num(P.centre_lat)} + {cy(c)} / {num(KY)})"


def clon(c: str) -> str:
    return f"({num(P.centre_lon)} + {cx(c)} / {num(KX)})"


def ring_of(a: str, b: str) -> str:
    dq, dr = f"({q_of(a)} - {q_of(b)})", f"({r_of(a)} - {r_of(b)})"
    return f"((abs({dq}) + abs({dr}) + abs({dq} + {dr})) // 2)"


def projected(src: str, lat: str, lon: str, x: str = "x", y: str = "y") -> str:
    """Query that adds projected metres to ``src``."""
    xi = "_xi" + "".join(f" + {num(a)} * sin({2 * j} * _xi) * cosh({2 * j} * _eta)" for j, a in enumerate(ALPHA, 1))
    eta = "_eta" + "".join(f" + {num(a)} * cos({2 * j} * _xi) * sinh({2 * j} * _eta)" for j, a in enumerate(ALPHA, 1))
    return f"""SELECT * EXCLUDE (_s,_dl,_t,_xi,_eta), {num(FALSE_EAST)} + {num(SCALE * RADIUS)} * ({eta}) AS {x},
      {num(FALSE_NORTH)} + {num(SCALE * RADIUS)} * ({xi}) AS {y}
      FROM (SELECT *, atan2(_t, cos(_dl)) AS _xi, atanh(sin(_dl) / sqrt(1 + _t * _t)) AS _eta
      FROM (SELECT *, sinh(atanh(_s) - {num(ECC)} * atanh({num(ECC)} * _s)) AS _t
      FROM (SELECT *, sin(radians({lat})) AS _s, radians(({lon}) - ({num(P.utm_central_meridian)})) AS _dl FROM {src})))"""


def unprojected(src: str, x: str, y: str) -> str:
    xi = "_xi" + "".join(f" - {num(b)} * sin({2 * j} * _xi) * cosh({2 * j} * _eta)" for j, b in enumerate(BETA, 1))
    eta = "_eta" + "".join(f" - {num(b)} * cos({2 * j} * _xi) * sinh({2 * j} * _eta)" for j, b in enumerate(BETA, 1))
    lat = "_chi" + "".join(f" + {num(d)} * sin({2 * j} * _chi)" for j, d in enumerate(DELTA, 1))
    return f"""SELECT * EXCLUDE (_xi,_eta,_x2,_e2,_chi), degrees({lat}) AS lat2,
      degrees(atan2(sinh(_e2), cos(_x2))) + ({num(P.utm_central_meridian)}) AS lon2
      FROM (SELECT *, asin(sin(_x2) / cosh(_e2)) AS _chi FROM (SELECT *, {xi} AS _x2, {eta} AS _e2
      FROM (SELECT *, (({y}) - {num(FALSE_NORTH)}) / {num(SCALE * RADIUS)} AS _xi, (({x}) - {num(FALSE_EAST)}) / {num(SCALE * RADIUS)} AS _eta FROM {src})))"""


def haversine(la1, lo1, la2, lo2, radius) -> str:
    a = (f"(pow(sin((radians({la2}) - radians({la1})) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) "
         f"* pow(sin((radians({lo2}) - radians({lo1})) / 2), 2))")
    return f"(2 * {num(float(radius))} * asin(sqrt({a})))"


def inside(src: str, key: str, lat: str, lon: str) -> str:
    """(key, inside): point in the buffered hull."""
    pts = projected(f"(SELECT DISTINCT {key} AS k, {lat} AS la, {lon} AS lo FROM {src} WHERE {lat} IS NOT NULL AND {lon} IS NOT NULL)", "la", "lo")
    t = "greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
    return f"""SELECT k, bool_and((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0) OR
        min(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) < {num(P.buffer_m ** 2)} AS inside
      FROM (SELECT *, {t} AS t FROM ({pts}) p, hull_edge) GROUP BY k"""


def rr(x: str, d: int = 6) -> str:
    return f"round({x}, {d})"


def box(lat: str, lon: str) -> str:
    b = P.bbox
    return f"({lat} BETWEEN {b.lat_min} AND {b.lat_max} AND {lon} BETWEEN {b.lon_min} AND {b.lon_max})"


VALID = f"(lat_orig <> 0 AND lon_orig <> 0 AND {box('lat_orig', 'lon_orig')})"
DATA = "event_id, user_id, ts, lat_orig, lon_orig, lat_dest, lon_dest, dist_m, muni"
BATCH = ("CASE WHEN regexp_extract(source_file, '_(\\d+)-(\\d+)\\.csv$', 1) = '2024' AND "
         "CAST(regexp_extract(source_file, '_(\\d+)-(\\d+)\\.csv$', 2) AS INT) >= 18 THEN 'lote_2024' ELSE 'lote_original' END")

# ---- common tables, in dependency order -------------------------------------

CTE: dict[str, str] = {}

CTE["trips"] = f"""SELECT *, {BATCH} AS source_batch FROM (
  SELECT event_id, CASE WHEN event_id % 103 = 0 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00' THEN ts + INTERVAL 7 DAY ELSE ts END AS ts,
    CASE WHEN event_id % 97 = 0 THEN 0E0 WHEN event_id % 89 = 0 THEN 40E0
         ELSE (-1739358 + hx*40 + jx*25 + CASE WHEN user_id % 50 = 9 THEN 300000 ELSE 0 END) / 1E5 END AS lat_orig,
    CASE WHEN event_id % 97 = 0 THEN 0E0 ELSE (-6615701 + hy*40 + jy*25) / 1E5 END AS lon_orig,
    (-1739358 + hx*40 + dx*60) / 1E5 AS lat_dest, (-6615701 + hy*40 + dy*60) / 1E5 AS lon_dest,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 71 = 0 THEN 60000E0 ELSE value * 100 END AS dist_m,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE coalesce(nullif(CAST((user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 5 AS VARCHAR), '3'),
      CASE WHEN event_id % 3 = 0 THEN 'Chimor\u00c3\u00a9' ELSE 'Chimor\u00e9' END) END AS muni,
    unnest(CASE WHEN event_id % 20 = 0 THEN ['{FILE_A}', '{FILE_B}'] ELSE ['{FILE_A}'] END) AS source_file
  FROM (SELECT *, (user_id*7919) % 401 - 200 AS hx, (user_id*6101) % 401 - 200 AS hy, (event_id*104729) % 41 - 20 AS jx,
    (event_id*7907) % 41 - 20 AS jy, (event_id*15485863) % 61 - 30 AS dx, (event_id*32452843) % 61 - 30 AS dy FROM events))"""
CTE["points"] = """SELECT c_custkey AS point_id, (-1739358 + ((c_custkey*7919) % 401 - 200)*45) / 1E5 AS lat,
    (-6615701 + ((c_custkey*6101) % 401 - 200)*45) / 1E5 AS lon, 1 + (c_custkey*31) % 400 AS people FROM customer"""
CTE["shapes"] = """SELECT DISTINCT l_orderkey AS shape_id, l_linenumber AS seq,
    (-1739358 + ((l_orderkey*613) % 301 - 150)*40 + l_linenumber*300) / 1E5 AS lat,
    (-6615701 + ((l_orderkey*419) % 301 - 150)*40 + (l_linenumber*l_linenumber)*90) / 1E5 AS lon FROM lineitem"""
CTE["base"] = pointed("(" + pointed(
    f"(SELECT user_id, ts, lat_orig, lon_orig, lat_dest, lon_dest FROM trips WHERE {VALID} AND lat_dest <> 0 AND lat_dest BETWEEN -90 AND 90 "
    "AND lon_dest BETWEEN -180 AND 180 AND user_id IS NOT NULL AND ts IS NOT NULL)", "lat_orig", "lon_orig", "cell_orig") + ")",
    "lat_dest", "lon_dest", "cell_dest")
CTE["daily"] = "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM base GROUP BY ALL"
CTE["pairs"] = "SELECT user_id, cell_orig, cell_dest, count(*) AS n FROM base GROUP BY ALL"
CTE["steps_s"] = ("SELECT user_id, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000) AS BIGINT) "
                  "AS seconds FROM base")
CTE["ustats"] = """SELECT a.user_id, a.n_queries, a.active_days, a.max_day, b.n_cells, b.repeated_share, c.median_seconds
  FROM (SELECT user_id, CAST(sum(n) AS BIGINT) AS n_queries, count(*) AS active_days, max(n) AS max_day FROM daily GROUP BY user_id) a
  JOIN (SELECT user_id, count(DISTINCT cell_orig) AS n_cells, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END) AS repeated_share FROM pairs GROUP BY user_id) b USING (user_id)
  LEFT JOIN (SELECT user_id, quantile_cont(seconds, 0.5) AS median_seconds FROM steps_s WHERE seconds IS NOT NULL GROUP BY user_id) c USING (user_id)"""
CTE["signals"] = f"""SELECT *, (s_volume::INT + s_intensity::INT + s_dispersion::INT + s_burst::INT + s_no_routine::INT + s_fast::INT) AS n_signals,
    (s_volume::INT + s_intensity::INT + s_dispersion::INT + s_burst::INT + s_no_routine::INT + s_fast::INT) >= {T.min_signals} AS anomalous
  FROM (SELECT *, n_queries > {T.volume} AS s_volume, n_queries / active_days > {T.per_active_day} AS s_intensity, n_cells > {T.origin_cells} AS s_dispersion,
    max_day > {T.burst} AS s_burst, repeated_share < {T.repeated_share} AND n_queries > {T.repeated_min_queries} AS s_no_routine,
    coalesce(median_seconds < {T.fast_seconds}, false) AS s_fast FROM ustats)"""
CTE["anomalous"] = "SELECT user_id, n_queries, n_signals FROM signals WHERE anomalous"
CTE["origins"] = pointed(f"(SELECT DISTINCT lat_orig AS lat, lon_orig AS lon FROM trips WHERE {VALID} AND user_id IS NOT NULL "
                         "AND user_id NOT IN (SELECT user_id FROM anomalous))", "lat", "lon", "cell")
CTE["ocells"] = "SELECT DISTINCT cell FROM origins"
CTE["offs"] = f"SELECT q * {STEP_Q} + r AS d, (abs(q) + abs(r) + abs(q + r)) // 2 AS ring FROM range(-30, 31) a(q), range(-30, 31) b(r) WHERE (abs(q) + abs(r) + abs(q + r)) // 2 <= 30"


def component(k: int) -> tuple[str, str]:
    reach = (f"SELECT cell AS root, cell FROM ocells UNION SELECT r.root, o.cell FROM reach{k} r JOIN offs f ON f.ring BETWEEN 1 AND {k} "
             "JOIN ocells o ON o.cell = r.cell + f.d")
    main = (f"SELECT cell FROM reach{k} WHERE root = (SELECT root FROM (SELECT root, count(*) AS n FROM reach{k} GROUP BY root) ORDER BY n DESC, root LIMIT 1)")
    return reach, main


for _k in (1, 2, 3):
    CTE[f"reach{_k}"], CTE[f"main{_k}"] = component(_k)
CTE["main0"] = "SELECT cell FROM ocells"


def hull(k: int) -> None:
    """Exact integer hull of the origins of component ``k``: lower and upper chain by slope."""
    CTE[f"hp{k}"] = f"SELECT DISTINCT CAST(round(lon * 1E5) AS BIGINT) AS x, CAST(round(lat * 1E5) AS BIGINT) AS y FROM origins JOIN main{k} USING (cell)"
    for side, sign, pick in (("lo", "", "min"), ("up", "-", "max")):
        CTE[f"{side}{k}"] = f"""SELECT x, {pick}(y) AS y, 0 AS i FROM hp{k} WHERE x = (SELECT min(x) FROM hp{k}) GROUP BY x
          UNION ALL SELECT -m.nx, m.y, i + 1 FROM (SELECT min({{'s': {sign}((p.y - c.y) / (p.x - c.x)::DOUBLE), 'nx': -p.x, 'y': p.y}}) AS m, max(c.i) AS i
          FROM {side}{k} c JOIN hp{k} p ON p.x > c.x) WHERE m IS NOT NULL"""
    CTE[f"ring{k}"] = f"""SELECT x / 1E5 AS lon, y / 1E5 AS lat, row_number() OVER (ORDER BY o) - 1 AS vertex FROM (
        SELECT x, y, i AS o FROM lo{k} UNION ALL SELECT x, y, 100000 - i AS o FROM up{k} WHERE (x, y) NOT IN (SELECT (x, y) FROM lo{k}))"""
    CTE[f"edge{k}"] = ("SELECT x AS x1, y AS y1, coalesce(lead(x) OVER (ORDER BY vertex), first(x) OVER (ORDER BY vertex)) AS x2, "
                       "coalesce(lead(y) OVER (ORDER BY vertex), first(y) OVER (ORDER BY vertex)) AS y2 FROM (" + projected(f"ring{k}", "lat", "lon") + ")")
    CTE[f"km{k}"] = (f"SELECT (sum(x1*y2 - x2*y1) / 2 + sum(sqrt(pow(x2-x1,2) + pow(y2-y1,2))) * {num(P.buffer_m)} + {num(math.pi * P.buffer_m ** 2)}) / 1E6 AS km2 FROM edge{k}")


for _k in (0, 1, 2, 3):
    hull(_k)
B = num(P.buffer_m)
CTE["turns"] = ("SELECT x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2, vertex FROM ("
                "SELECT vertex, x - first(x) OVER (ORDER BY vertex) AS x, y - first(y) OVER (ORDER BY vertex) AS y FROM (" + projected("ring1", "lat", "lon") + ")) WINDOW w AS (ORDER BY vertex)")
CTE["angles"] = f"""SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS len, a - pa - floor((a - pa) / {num(2 * math.pi)}) * {num(2 * math.pi)} AS sweep, pa - {num(math.pi / 2)} AS a0 FROM (
    SELECT *, coalesce(lag(a) OVER (ORDER BY vertex), last(a) OVER (ORDER BY vertex ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS pa FROM (SELECT *, atan2(y2 - y, x2 - x) AS a FROM turns))"""
CTE["moments"] = f"""SELECT sum((x*y2 - x2*y) / 2 + len*{B} + sweep*{B}*{B} / 2) AS m0,
    sum((x + x2)*(x*y2 - x2*y) / 6 + len*{B}*((x + x2) / 2 + (y2 - y) / len*{B} / 2) + x*sweep*{B}*{B} / 2 + pow({B}, 3) / 3*(sin(a0 + sweep) - sin(a0))) AS mx,
    sum((y + y2)*(x*y2 - x2*y) / 6 + len*{B}*((y + y2) / 2 - (x2 - x) / len*{B} / 2) + y*sweep*{B}*{B} / 2 - pow({B}, 3) / 3*(cos(a0 + sweep) - cos(a0))) AS my FROM angles"""
CTE["centroid"] = "SELECT lat2 AS clat, lon2 AS clon FROM (" + unprojected(
    "(SELECT x + mx / m0 AS gx, y + my / m0 AS gy FROM moments, (SELECT x, y FROM (" + projected("ring1", "lat", "lon") + ") ORDER BY vertex LIMIT 1))", "gx", "gy") + ")"
CTE["hull_edge"] = "SELECT * FROM edge1"
CTE["uniq"] = f"SELECT {DATA}, min(source_file) AS source_file, count(*) AS copies FROM trips GROUP BY {DATA}"
CTE["origin_in"] = "SELECT k.la AS lat_orig, k.lo AS lon_orig, inside FROM (" + inside(
    "(SELECT DISTINCT lat_orig, lon_orig FROM uniq)", "{'la': lat_orig, 'lo': lon_orig}", "lat_orig", "lon_orig") + ")"
CTE["steps"] = f"""SELECT u.*, CASE WHEN coalesce(lat_orig = 0 OR lon_orig = 0, true) THEN 1 WHEN NOT coalesce({box('lat_orig', 'lon_orig')}, false) THEN 2
    WHEN NOT inside THEN 4 WHEN coalesce(dist_m > {P.dist_max_m}, true) THEN 5
    WHEN u.user_id IS NULL OR u.user_id IN (SELECT user_id FROM anomalous) THEN 6 ELSE 0 END AS drop_step
  FROM uniq u JOIN origin_in USING (lat_orig, lon_orig)"""
CTE["clean"] = pointed(f"(SELECT {DATA}, source_file FROM steps WHERE drop_step = 0)", "lat_orig", "lon_orig", "cell")
CTE["weeks"] = """SELECT CAST(isoyear(start) AS INT) AS year, CAST(week(start) AS INT) AS week, start, coalesce(queries, 0) AS queries, coalesce(days, 0) AS days_with_data,
    coalesce(queries, 0) > 0 AS observed, coalesce(days, 0) = 7 AS complete
  FROM (SELECT CAST(unnest(generate_series((SELECT min(date_trunc('week', ts)) FROM clean), (SELECT max(date_trunc('week', ts)) FROM clean), INTERVAL 7 DAY)) AS DATE) AS start)
  LEFT JOIN (SELECT CAST(date_trunc('week', ts) AS DATE) AS start, count(*) AS queries, count(DISTINCT CAST(ts AS DATE)) AS days FROM clean GROUP BY 1) USING (start)"""
CTE["gap"] = "SELECT min(start) AS gap_start, max(start) + 7 AS gap_end FROM weeks WHERE NOT observed"
CTE["wobs"] = "SELECT sum(days_with_data) / 7 AS w FROM weeks"
CTE["population"] = "SELECT cell, CAST(sum(people) AS BIGINT) AS population FROM (" + pointed("points", "lat", "lon", "cell") + ") GROUP BY cell"
CTE["pop_in"] = "SELECT k AS cell, inside FROM (" + inside("population", "cell", clat("cell"), clon("cell")) + ")"
CTE["zcount"] = "SELECT cell, count(*) AS query_count, count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS user_count FROM clean GROUP BY cell"
CTE["period"] = ("SELECT cell, count(*) FILTER (CAST(ts AS DATE) < (SELECT gap_start FROM gap)) AS query_count_before_gap, "
                 "count(*) FILTER (CAST(ts AS DATE) >= (SELECT gap_end FROM gap)) AS query_count_after_gap FROM clean GROUP BY cell")
CTE["zones"] = """SELECT z.cell, coalesce(query_count, 0) AS query_count, coalesce(user_count, 0) AS user_count, coalesce(population, 0) AS population,
    coalesce(query_count_before_gap, 0) AS query_count_before_gap, coalesce(query_count_after_gap, 0) AS query_count_after_gap
  FROM (SELECT cell FROM pop_in WHERE inside UNION SELECT cell FROM zcount) z LEFT JOIN zcount USING (cell) LEFT JOIN population USING (cell) LEFT JOIN period USING (cell)"""
CTE["feat"] = blocked(f"""(SELECT z.*, {clat('z.cell')} AS lat, {clon('z.cell')} AS lon,
    coalesce((SELECT sum(population) FROM offs JOIN population p ON p.cell = z.cell + d WHERE ring = 1), 0)::BIGINT AS pop_ring1,
    coalesce((SELECT sum(population) FROM offs JOIN population p ON p.cell = z.cell + d WHERE ring = 2), 0)::BIGINT AS pop_ring2 FROM zones z)""")
CTE["sxy"] = projected("shapes", "lat", "lon")
CTE["sseg"] = """SELECT shape_id, seq, x, y, x0, y0, len, sum(len) OVER (PARTITION BY shape_id ORDER BY seq) AS upto FROM (
    SELECT *, coalesce(sqrt(pow(x - x0, 2) + pow(y - y0, 2)), 0.0) AS len FROM (
    SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM sxy WINDOW w AS (PARTITION BY shape_id ORDER BY seq)))"""
CTE["sample_at"] = f"""SELECT shape_id, total, n, unnest(generate_series(0, n - 1)) AS i FROM (
    SELECT shape_id, max(upto) AS total, greatest(2, CAST(floor(max(upto) / {P.network_step_m}) AS BIGINT)) AS n FROM sseg GROUP BY shape_id HAVING count(*) > 1)"""
CTE["dense"] = """SELECT shape_id, i, x0 + t * (x - x0) AS x, y0 + t * (y - y0) AS y FROM (
    SELECT a.shape_id, a.i, s.x, s.y, s.x0, s.y0, least(1.0, greatest(0.0, (a.d - (s.upto - s.len)) / s.len)) AS t
    FROM (SELECT *, CASE WHEN i = n - 1 THEN total ELSE i * (total / (n - 1)) END AS d FROM sample_at) a
    ASOF JOIN (SELECT * FROM sseg WHERE x0 IS NOT NULL) s ON a.shape_id = s.shape_id AND a.d <= s.upto)"""
CTE["net"] = "SELECT DISTINCT CAST(floor(x / 500) AS BIGINT) AS nx, CAST(floor(y / 500) AS BIGINT) AS ny, x, y FROM dense"


def nearest(src: str, key: str) -> str:
    """(key, distance): boxes of 500 m within a radius that must hold the nearest point."""
    pts = f"(SELECT {key} AS k, x, y, CAST(floor(x / 500) AS BIGINT) AS nx, CAST(floor(y / 500) AS BIGINT) AS ny FROM ({src}))"
    boxes = "(SELECT DISTINCT nx, ny FROM net)"
    return f"""SELECT k, min(sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2))) AS distance FROM
      (SELECT p.k, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.nx) AS nx, any_value(p.ny) AS ny,
         min(greatest(abs(p.nx - o.nx), abs(p.ny - o.ny))) AS m FROM {pts} p, {boxes} o GROUP BY p.k) p
      JOIN {boxes} o ON greatest(abs(p.nx - o.nx), abs(p.ny - o.ny)) <= CAST(ceil((p.m + 1) * 1.4143) AS BIGINT)
      JOIN net n ON n.nx = o.nx AND n.ny = o.ny GROUP BY k"""


CTE["znet"] = "SELECT k AS cell, distance FROM (" + nearest(projected("(SELECT cell, lat, lon FROM feat)", "lat", "lon"), "cell") + ")"
CTE["modal"] = """SELECT cell, label, n AS modal_queries, total AS total_queries FROM (SELECT *, sum(n) OVER (PARTITION BY cell)::BIGINT AS total,
    row_number() OVER (PARTITION BY cell ORDER BY n DESC, label ASC NULLS FIRST) AS rn FROM (SELECT cell, replace(muni, '\u00c3\u00a9', '\u00e9') AS label, count(*) AS n FROM clean GROUP BY ALL)) WHERE rn = 1"""
CTE["near_label"] = """SELECT cell, label FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ring, n DESC, label) AS rn FROM (
    SELECT z.cell, ring, m.label, count(*) AS n FROM zones z JOIN offs ON ring >= 1 JOIN modal m ON m.cell = z.cell + d AND m.label IS NOT NULL
    WHERE z.cell NOT IN (SELECT cell FROM modal WHERE label IS NOT NULL) GROUP BY ALL)) WHERE rn = 1"""
CTE["zmuni"] = "SELECT z.cell, coalesce(m.label, n.label, 'desconocido') AS municipality FROM zones z LEFT JOIN modal m USING (cell) LEFT JOIN near_label n USING (cell)"
CTE["full0"] = f"""SELECT f.*, round({haversine(num(P.centre_lat), num(P.centre_lon), 'lat', 'lon', 6371)}, 4) AS dist_centre_km, round(distance, 1) AS dist_network_m,
    CASE WHEN distance <= {P.coverage_m} THEN 1 ELSE 0 END AS covered, municipality, population >= {P.pop_min} AS in_model FROM feat f JOIN znet USING (cell) JOIN zmuni USING (cell)"""
CTE["bdist"] = "SELECT block_id, coalesce(avg(dist_centre_km) FILTER (in_model), avg(dist_centre_km)) AS block_dist_km, bool_or(in_model) AS has_model FROM full0 GROUP BY block_id"
CTE["cuts"] = "SELECT quantile_cont(block_dist_km, [0.25, 0.5, 0.75]) AS c FROM bdist WHERE has_model"
CTE["ringed"] = """SELECT f.*, CASE WHEN block_dist_km <= c[1] THEN 'A1' WHEN block_dist_km <= c[2] THEN 'A2' WHEN block_dist_km <= c[3] THEN 'A3' ELSE 'A4' END AS distance_ring
  FROM full0 f JOIN bdist USING (block_id), cuts"""
CTE["blocks"] = "SELECT block_id, round(avg(dist_centre_km), 3) AS block_dist_km, count(*) AS n_cells, min(distance_ring) AS distance_ring FROM ringed WHERE in_model GROUP BY block_id"
CTE["drawn"] = f"""SELECT block_id, distance_ring FROM (SELECT *, row_number() OVER (PARTITION BY distance_ring ORDER BY md5(block_id::VARCHAR || '|{P.seed}'), block_id) AS rn,
    count(*) OVER (PARTITION BY distance_ring) AS n FROM blocks) WHERE rn <= greatest(1, CAST(round_even(n * {P.test_fraction}, 0) AS BIGINT))"""
CTE["tab"] = "SELECT *, block_id IN (SELECT block_id FROM drawn) AS in_test FROM ringed"
CTE["model"] = "SELECT * FROM tab WHERE in_model"
CTE["test"] = "SELECT * FROM model WHERE in_test"


def folds(src: str, name: str, n: int) -> None:
    """Largest blocks first into the lightest fold, one block per step."""
    CTE[f"{name}_b"] = f"SELECT block_id, size, row_number() OVER (ORDER BY size DESC, block_id DESC) AS i FROM (SELECT block_id, count(*) AS size FROM {src} GROUP BY block_id)"
    CTE[f"{name}_r"] = f"""SELECT 0::BIGINT AS i, CAST(NULL AS BIGINT) AS block_id, 0::BIGINT AS fold, list_resize([0::BIGINT], {n}, 0::BIGINT) AS load
      UNION ALL SELECT b.i, b.block_id, list_position(r.load, list_min(r.load))::BIGINT - 1,
        list_transform(r.load, lambda x, j: CASE WHEN j = list_position(r.load, list_min(r.load)) THEN x + b.size ELSE x END)
      FROM {name}_r r JOIN {name}_b b ON b.i = r.i + 1"""
    CTE[f"{name}_f"] = f"SELECT block_id, fold FROM {name}_r WHERE i > 0"


folds("(SELECT * FROM model WHERE NOT in_test)", "tr", P.folds)
CTE["train"] = "SELECT m.*, fold FROM model m JOIN tr_f USING (block_id) WHERE NOT in_test"
CTE["grate"] = "SELECT fold, (SELECT sum(query_count) FROM train t WHERE t.fold <> f.fold) / (SELECT sum(population) FROM train t WHERE t.fold <> f.fold) AS g FROM (SELECT DISTINCT fold FROM train) f"


def group_oof(g: str) -> str:
    return (f"SELECT t.cell, t.block_id, t.fold, t.query_count AS observed, coalesce((SELECT sum(o.query_count) / sum(o.population) FROM train o "
            f"WHERE o.{g} = t.{g} AND o.fold <> t.fold), g) * t.population AS expected FROM train t JOIN grate USING (fold)")


def disk_rate(src: str, train: str, cond: str, target: str = "query_count") -> str:
    """(cell, rate) over the smallest disk with enough training neighbours."""
    return f"""SELECT cell, arg_min(y / pop, ring) AS rate FROM (SELECT cell, ring, sum(n) OVER w AS n, sum(y) OVER w AS y, sum(pop) OVER w AS pop FROM (
      SELECT s.cell, ring, count(*) AS n, sum(o.{target})::DOUBLE AS y, sum(o.population)::DOUBLE AS pop FROM {src} s JOIN offs ON ring BETWEEN 1 AND {P.neighbours_k_max}
      JOIN {train} o ON o.cell = s.cell + d {cond} GROUP BY ALL) WINDOW w AS (PARTITION BY cell ORDER BY ring)) WHERE n >= {P.neighbours_min} GROUP BY cell"""


CTE["oof0"] = "SELECT cell, block_id, fold, query_count AS observed, g * population AS expected FROM train JOIN grate USING (fold)"
CTE["oof1"], CTE["oof2"] = group_oof("municipality"), group_oof("distance_ring")
CTE["disk3"] = disk_rate("train", "train", "AND o.fold <> s.fold")
CTE["oof3"] = "SELECT t.cell, block_id, fold, query_count AS observed, coalesce(rate, g) * population AS expected FROM train t JOIN grate USING (fold) LEFT JOIN disk3 USING (cell)"
CTE["oof"] = " UNION ALL ".join(f"SELECT cell, block_id, fold, 'B{i}' AS technique, observed, greatest(expected, 1E-6) AS expected FROM oof{i}" for i in range(4))


def final(g: str | None, target: str = "query_count", train: str = "train", test: str = "test") -> str:
    rate = f"(SELECT sum({target}) / sum(population) FROM {train})"
    if g:
        rate = f"coalesce((SELECT sum(o.{target}) / sum(o.population) FROM {train} o WHERE o.{g} = t.{g}), {rate})"
    return f"SELECT t.cell, greatest({rate} * t.population, 1E-6) AS expected FROM {test} t"


CTE["fin0"], CTE["fin1"], CTE["fin2"] = final(None), final("municipality"), final("distance_ring")
CTE["disk3f"] = disk_rate("test", "train", "")
CTE["fin3"] = "SELECT t.cell, greatest(coalesce(rate, (SELECT sum(query_count) / sum(population) FROM train)) * t.population, 1E-6) AS expected FROM test t LEFT JOIN disk3f USING (cell)"
for _i in range(4):
    CTE[f"exp{_i}"] = (f"SELECT cell, expected, 'entrenamiento' AS partition FROM oof WHERE technique = 'B{_i}' UNION ALL "
                       f"SELECT cell, expected, 'prueba' FROM fin{_i}")


def gaps(o: str, e: str) -> str:
    return f"({o} - {e}) / sqrt({e}) AS gap_pearson, ({o} + 1) / ({e} + 1) AS ratio_obs_exp, greatest({e} - {o}, 0) AS unmet_demand"


CTE["gapz"] = f"""SELECT m.cell, municipality, population, query_count AS observed, dist_centre_km, dist_network_m, covered, lat, lon, e.expected, e.partition,
    e.expected / (SELECT w FROM wobs) AS expected_week, {gaps('query_count', 'e.expected')}, (query_count - g.expected) / sqrt(g.expected) AS gap_pearson_global
  FROM model m JOIN exp2 e USING (cell) JOIN exp0 g USING (cell)"""
CTE["acted"] = """SELECT g.*, CASE WHEN gap_pearson < 0 AND covered <> 1 THEN 'mapear' WHEN gap_pearson < 0 THEN 'revisar' ELSE 'sin_brecha' END AS action FROM gapz g"""
CTE["prior"] = f"""SELECT a.*, priority_rank FROM acted a LEFT JOIN (SELECT cell, row_number() OVER (ORDER BY gap_pearson, cell) AS priority_rank FROM acted WHERE action = 'mapear'
    ORDER BY gap_pearson, cell LIMIT {P.top_k}) USING (cell)"""
CTE["pred"] = """SELECT cell, round_even(lat, 4) AS lat, round_even(lon, 4) AS lon, municipality, population, observed, round_even(expected, 4) AS expected,
    round_even(observed / (SELECT w FROM wobs), 4) AS observed_week, round_even(expected_week, 4) AS expected_week, round_even(gap_pearson, 4) AS gap_pearson,
    round_even(ratio_obs_exp, 4) AS ratio_obs_exp, round_even(unmet_demand, 4) AS unmet_demand, covered, dist_network_m, partition, action, priority_rank FROM prior"""

ORDER = list(CTE)


def compose(select: str) -> str:
    """The SELECT behind exactly the common tables it needs."""
    need: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", todo.pop()))
        for n in words & CTE.keys() - need:
            need.add(n)
            todo.append(CTE[n])
    if not need:
        return select
    rec = {n for n in need if re.search(rf"\b(FROM|JOIN) {n}\b", CTE[n])}
    parts = [f"{n} AS {'' if n in rec else 'MATERIALIZED '}({CTE[n]})" for n in ORDER if n in need]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


SELECTS: dict[str, str] = {}


def sel(name: str, sql: str) -> None:
    SELECTS[name] = sql


# ---- sources and expressions -----------------------------------------------

CENTRE = (num(P.centre_lat), num(P.centre_lon))
sel("priority_zones", f"""SELECT cell, population, query_count, {rr('expected')} AS expected, {rr('gap_pearson')} AS gap_pearson, {rr('ratio_obs_exp')} AS ratio_obs_exp,
    {rr('unmet_demand')} AS unmet_demand FROM (SELECT cell, population, query_count, expected, {gaps('query_count', 'expected')} FROM (
    SELECT cell, population, query_count, population * (sum(query_count) OVER () / sum(population) OVER ()) AS expected FROM (
    SELECT cell, population, coalesce(n, 0) AS query_count FROM population LEFT JOIN (SELECT cell, count(*) AS n FROM (
    {pointed(f"(SELECT lat_orig, lon_orig FROM trips WHERE {VALID})", 'lat_orig', 'lon_orig', 'cell')}) GROUP BY cell) USING (cell)))) ORDER BY gap_pearson, cell LIMIT {P.top_k}""")
sel("read_trip_exports", """SELECT count(*) AS n, count(user_id) AS users, count(ts) AS times, count(dist_m) AS distances, round(sum(lat_orig), 4) AS sum_lat,
    round(sum(dist_m), 2) AS sum_dist, date_trunc('second', min(ts)) AS first_ts, date_trunc('second', max(ts)) AS last_ts, CAST(sum(week(ts)) AS BIGINT) AS sum_week,
    count(*) FILTER (muni = 'Chimor\u00e9') AS named, count(*) FILTER (source_file = '%s') AS notes,
    CAST(sum(event_id) FILTER (source_file = '%s') AS BIGINT) AS sum_notes FROM trips""" % (FILE_B, FILE_B))
sel("detect_encoding", f"""SELECT DISTINCT CASE WHEN source_file = '{FILE_B}' THEN 'b' ELSE 'a' END AS folder, CASE WHEN source_file = '{FILE_B}' THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM trips
    UNION ALL SELECT 'c', 'utf-8'""")
sel("batch_of_file", f"SELECT source_file, {BATCH} AS batch, count(*) AS n FROM trips GROUP BY ALL")
sel("file_registry", f"""SELECT CASE WHEN source_file = '{FILE_B}' THEN 'latin-1' ELSE 'utf-8' END AS source_encoding, CASE WHEN source_file = '{FILE_B}' THEN 10 ELSE 9 END AS columns, count(*) AS rows
    FROM trips GROUP BY ALL UNION ALL SELECT 'utf-8', 2, 0""")
_cols = [c.strip() for c in DATA.split(",")]
sel("schema_groups", "SELECT file, dense_rank() OVER (ORDER BY first) - 1 AS schema_id FROM (SELECT file, cols, min(file) OVER (PARTITION BY cols) AS first FROM (SELECT source_file AS file, "
    + " || ".join(f"CASE WHEN count({c}) > 0 THEN '{c},' ELSE '' END" for c in sorted(_cols)) + " AS cols FROM trips GROUP BY source_file))")
sel("read_feed_tables", """SELECT count(*) AS n, count(DISTINCT shape_id) AS shapes, round(sum(lat), 4) AS sum_lat, round(sum(lon), 4) AS sum_lon,
    CAST(sum(seq) AS BIGINT) AS sum_seq FROM shapes""")
sel("read_population", "SELECT cell, population FROM population")
sel("read_columns", "SELECT event_id, user_id FROM events")
sel("write_table", "SELECT event_id, cell, source_file FROM clean")
sel("write_report_csv", "SELECT cell::VARCHAR AS cell, observed::VARCHAR AS observed, CAST(round(lat, 4) AS VARCHAR) AS lat FROM gapz")
_counters = f"""(SELECT count(*) AS zones, count(*) FILTER (query_count > 0) AS with_queries, count(*) FILTER (population > 0 AND query_count = 0) AS populated_without_queries,
    count(*) FILTER (population >= {P.pop_min}) AS above_minimum, CAST(sum(population) AS BIGINT) AS population FROM zones)"""
_names = ["above_minimum", "populated_without_queries", "population", "with_queries", "zones"]
sel("write_metrics", "SELECT '{' || " + " || ',' || ".join(f"'\"{n}\":' || {n}" for n in _names) + " || '}' AS value FROM " + _counters)
sel("read_metrics", " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::VARCHAR AS value FROM {_counters}" for n in _names))


def vertex(i: int) -> tuple[str, str]:
    a = math.radians((i % 6) * 60.0 - 30.0)
    return (f"({num(P.centre_lon)} + ({cx('cell')} + {num(P.edge_m)} * {num(math.cos(a))}) / {num(KX)})",
            f"({num(P.centre_lat)} + ({cy('cell')} + {num(P.edge_m)} * {num(math.sin(a))}) / {num(KY)})")


def f6(x: str) -> str:
    return f"printf('%.6f', {x})"


GEO = "'{\"type\":\"Polygon\",\"coordinates\":[[' || " + " || ',' || ".join(
    f"'[' || {f6(a)} || ',' || {f6(b)} || ']'" for a, b in map(vertex, range(7))) + " || ']]}'"
WKT = "'POLYGON ((' || " + " || ', ' || ".join(f"{f6(a)} || ' ' || {f6(b)}" for a, b in map(vertex, range(7))) + " || '))'"
sel("write_zone_features", "SELECT '{\"type\":\"Feature\",\"properties\":{\"cell\":' || cell || ',\"query_count\":' || query_count || ',\"population\":' || population "
    f"|| '}},\"geometry\":' || {GEO} || '}}' AS value FROM zones")
sel("read_zone_features", "SELECT cell, query_count, 'Polygon' AS kind, 7 AS vertices FROM zones")
sel("declared_period", "SELECT min(regexp_extract(source_file, '^(\\d{4}-\\d{2}-\\d{2})', 1)) AS period_start, max(regexp_extract(source_file, '_to_(\\d{4}-\\d{2}-\\d{2})', 1)) AS period_end, "
    "CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_query FROM trips")
sel("valid_origin", f"SELECT {VALID} AS valid, count(*) AS n FROM trips GROUP BY ALL")
sel("valid_destination", "SELECT (lat_dest <> 0 AND lat_dest BETWEEN -90 AND 90 AND lon_dest BETWEEN -180 AND 180) AS valid, count(*) AS n FROM trips GROUP BY ALL")
sel("parse_ts_lenient", "SELECT event_id, source_file, CASE WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM trips")
sel("iso_year_week", "SELECT CAST(isoyear(d) AS INT) AS iso_year, CAST(week(d) AS INT) AS iso_week, count(*) AS n FROM (SELECT CAST(ts AS DATE) + CAST(event_id % 2000 AS INT) AS d FROM trips) GROUP BY ALL")
sel("ts_parts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) AS INT) AS weekday, count(*) AS n FROM trips GROUP BY ALL")
sel("repair_mojibake", "SELECT doc_id, md5(text) AS repaired FROM documents")
sel("haversine_km", f"SELECT point_id, {rr(haversine(*CENTRE, 'lat', 'lon', 6371))} AS km FROM points")
sel("haversine_m", f"SELECT event_id, source_file, {rr(haversine('lat_orig', 'lon_orig', 'lat_dest', 'lon_dest', 6371000), 3)} AS m FROM trips")
sel("project_xy", f"SELECT point_id, round(x, 3) AS x, round(y, 3) AS y FROM ({projected('points', 'lat', 'lon')})")
sel("unproject_xy", f"SELECT point_id, round(lat2, 7) AS lat, round(lon2, 7) AS lon FROM ({unprojected('(' + projected('points', 'lat', 'lon') + ')', 'x', 'y')})")
sel("log1p_design", "SELECT cell, round(ln(1 + pop_ring1), 9) AS x_ring, round(dist_centre_km, 9) AS x_dist FROM tab")
sel("log_offset", "SELECT cell, round(ln(population), 9) AS off FROM tab WHERE population > 0")
CLASS = f"CASE WHEN population >= {P.pop_min} THEN 'population >= {P.pop_min}' WHEN population > 0 THEN '1 <= population < {P.pop_min}' ELSE 'population = 0' END"
sel("population_class", f"SELECT cell, {CLASS} AS class FROM tab")
sel("coverage_flag", f"SELECT cell, CASE WHEN dist_network_m <= {P.coverage_m} THEN 1 ELSE 0 END AS covered FROM tab")
sel("in_model_flag", f"SELECT cell, population >= {P.pop_min} AS in_model FROM zones")
sel("rate_per_1000", "SELECT cell, round(CASE WHEN population = 0 THEN NULL ELSE query_count / population * 1000 END, 6) AS rate FROM zones")
sel("gap_metrics", "SELECT cell, round(gap_pearson, 6) AS gap_pearson, round(ratio_obs_exp, 6) AS ratio_obs_exp, round(unmet_demand, 6) AS unmet_demand FROM gapz")
sel("per_observed_week", "SELECT cell, round(observed / (SELECT w FROM wobs), 6) AS observed_week FROM gapz")
sel("cut_right_closed", "SELECT cell, CASE WHEN population <= 100 THEN 'a' WHEN population <= 300 THEN 'b' WHEN population <= 500 THEN 'c' ELSE 'd' END AS band FROM zones")
sel("log_histogram", f"""SELECT CAST(least(floor((log10(km) + 1) / (hi + 1) * 80) + 1, 80) AS INT) AS bin, count(*) AS n FROM (SELECT dist_m / 1000 AS km, max(log10(dist_m / 1000)) OVER () AS hi
    FROM trips WHERE {VALID} AND dist_m > 0) WHERE log10(km) >= -1 GROUP BY ALL""")
sel("priority_action", "SELECT cell, action FROM acted")
sel("map_link", "SELECT point_id, 'https://www.openstreetmap.org/?mlat=' || printf('%.5f', lat) || '&mlon=' || printf('%.5f', lon) || '#map=16/' || printf('%.5f', lat) || '/' || printf('%.5f', lon) AS url FROM points")
sel("field_template", "SELECT cell, 'sin_visitar' AS field_result, '' AS field_notes FROM zones")
sel("null_to_false_signals", "SELECT user_id, s_volume, s_fast, s_volume::INT + s_fast::INT AS n_signals FROM signals")
sel("clamped_gap_scale", "SELECT cell, round(l, 6) AS \"limit\", round(greatest(least(gap_pearson, l), -l), 6) AS clamped FROM gapz, (SELECT quantile_cont(abs(gap_pearson), 0.95) AS l FROM gapz)")
sel("gap_as_null", "SELECT start, CASE WHEN observed THEN queries END AS queries FROM weeks")
sel("round_all", "SELECT cell, CAST(round_even(query_count * CAST(0.1234567 AS DOUBLE) + CAST(0.0000321 AS DOUBLE), 4) AS DOUBLE) AS v FROM zones")

# ---- grid and geometry -----------------------------------------------------

sel("point_to_cell", f"SELECT event_id, source_file, cell FROM ({pointed('trips', 'lat_orig', 'lon_orig', 'cell')})")
sel("cell_centroid", f"SELECT cell, round({clat('cell')}, 9) AS lat, round({clon('cell')}, 9) AS lon FROM population")
sel("cell_polygon", f"SELECT cell, {WKT} AS wkt, {GEO} AS geojson FROM population")
sel("grid_ring", "SELECT cell, cell + d AS dst FROM population, offs WHERE ring = 2")
sel("grid_disk", "SELECT cell, CAST(ring AS INT) AS ring, cell + d AS dst FROM population, offs WHERE ring <= 2")
sel("grid_distance", f"SELECT {ring_of('a', 'b')} AS rings, count(*) AS n FROM ({pointed('(' + pointed('trips', 'lat_orig', 'lon_orig', 'a') + ')', 'lat_dest', 'lon_dest', 'b')}) GROUP BY ALL")
sel("cell_parent", f"SELECT cell, block_id FROM ({blocked('population')})")
sel("check_resolution", f"SELECT count(*) FILTER (cell // {STEP_RES} <> {P.zone_res}) AS wrong, count(*) AS cells FROM population")
sel("largest_component", "SELECT cell FROM main1")
sel("convex_hull", "SELECT lon, lat FROM ring1")
sel("study_area", "SELECT (SELECT count(*) FROM main1) AS cells, (SELECT count(*) FROM ring1) AS vertices, round(km2, 3) AS area_km2 FROM km1")
sel("within_area", f"SELECT k AS point_id, inside FROM ({inside('points', 'point_id', 'lat', 'lon')})")
sel("read_study_area", f"SELECT k AS cell, inside FROM ({inside('(SELECT cell, ' + clat('cell') + ' AS lat, ' + clon('cell') + ' AS lon FROM population)', 'cell', 'lat', 'lon')})")
sel("add_inside", "SELECT inside, count(*) AS n FROM trips JOIN origin_in USING (lat_orig, lon_orig) GROUP BY inside")
sel("area_km2", "SELECT (SELECT count(*) FROM origins) AS origins, round(km2, 3) AS area_km2 FROM km1")
sel("area_centroid", "SELECT (SELECT count(*) FROM origins) AS origins, round(clat, 5) AS lat, round(clon, 5) AS lon FROM centroid")
sel("area_bounds", "SELECT min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max FROM origins JOIN main1 USING (cell)")
sel("area_variants", " UNION ALL ".join(f"SELECT '{n}' AS variant, (SELECT count(*) FROM main{k}) AS cells, round(km2, 1) AS area_km2 FROM km{k}"
                                        for k, n in ((0, "all cells"), (1, "component k=1"), (2, "component k=2"), (3, "component k=3"))))
sel("densify_polyline", "SELECT shape_id, count(*) AS n, round(sum(x), 2) AS sx, round(sum(y), 2) AS sy FROM dense GROUP BY shape_id")
sel("nearest_distance", f"SELECT k AS point_id, round(distance, 3) AS distance FROM ({nearest(projected('points', 'lat', 'lon'), 'point_id')})")
sel("polyline_length_km", "SELECT shape_id, round(sum(len) / 1000, 6) AS length_km FROM sseg GROUP BY shape_id")
sel("polyline_rings", "SELECT shape_id, string_agg(printf('%.5f', lon) || ' ' || printf('%.5f', lat), ',' ORDER BY seq) AS line FROM shapes GROUP BY shape_id")
_km = "(SELECT shape_id, sum(len) / 1000 AS km FROM sseg GROUP BY shape_id)"
sel("feed_summary", f"""SELECT 'rows_frequencies' AS measure, count(*)::DOUBLE AS value FROM points UNION ALL SELECT 'rows_points', count(*)::DOUBLE FROM points
    UNION ALL SELECT 'rows_shapes', count(*)::DOUBLE FROM shapes UNION ALL SELECT 'shapes', count(*)::DOUBLE FROM {_km} UNION ALL SELECT 'shape_median_km', round(median(km), 2) FROM {_km}
    UNION ALL SELECT 'shapes_total_km', round(sum(km), 1) FROM {_km} UNION ALL SELECT 'headway_median_min', round(median(people * 10 / 60), 1) FROM points""")
_near = "(SELECT lat_orig AS lat, lon_orig AS lon, count(*) AS n, {'la': lat_orig, 'lo': lon_orig} AS pt FROM trips JOIN origin_in USING (lat_orig, lon_orig) WHERE inside AND " + VALID + " GROUP BY ALL)"
sel("share_near_network", f"SELECT round(sum(CASE WHEN distance <= {P.coverage_m} THEN n ELSE 0 END) / sum(n) * 100, 4) AS pct_near FROM {_near} a JOIN ({nearest(projected(_near, 'lat', 'lon'), 'pt')}) b ON a.pt = b.k")

# ---- joins -----------------------------------------------------------------

sel("join_inner_stats", "SELECT user_id, max_day, round(r, 6) AS repeated_share FROM (SELECT user_id, max(n) AS max_day FROM daily GROUP BY user_id) JOIN (SELECT user_id, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END) AS r FROM pairs GROUP BY user_id) USING (user_id)")
sel("join_left_fill", "SELECT cell, query_count, query_count_before_gap, query_count_after_gap FROM zones")
sel("zone_union_join", "SELECT cell, coalesce(query_count, 0) AS query_count, coalesce(user_count, 0) AS user_count, coalesce(population, 0) AS population FROM population FULL JOIN zcount USING (cell)")
sel("join_right_summary", "SELECT municipality, pure_zones, zones FROM (SELECT label AS municipality, count(*) AS pure_zones FROM modal WHERE modal_queries = total_queries GROUP BY label) RIGHT JOIN (SELECT municipality, count(*) AS zones FROM model GROUP BY municipality) USING (municipality)")
sel("semi_cells", "SELECT cell, population FROM population WHERE cell IN (SELECT cell FROM main1)")
sel("anti_users", "SELECT event_id, user_id, source_file FROM trips WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM anomalous)")
sel("anti_test_blocks", "SELECT cell, block_id FROM model WHERE block_id NOT IN (SELECT block_id FROM drawn)")
sel("ring_neighbor_join", "SELECT z.cell AS src, p.cell AS dst, CAST(ring AS INT) AS ring, p.population FROM zones z JOIN offs ON ring BETWEEN 1 AND 2 JOIN population p ON p.cell = z.cell + d")
sel("nearest_ring_join", "SELECT cell, label FROM near_label")
sel("lookup_with_default", "SELECT cell, round(coalesce(rate, 0.5), 9) AS rate FROM model LEFT JOIN (SELECT municipality, sum(query_count) / sum(population) AS rate FROM train GROUP BY municipality) USING (municipality)")
sel("gap_join", "SELECT cell, query_count, round(a.expected, 6) AS expected, round(b.expected, 6) AS expected_global FROM test JOIN fin2 a USING (cell) JOIN fin0 b USING (cell)")
sel("ranking_self_join", "SELECT cell, round(gap_pearson, 6) AS gap_x, round(gap_pearson_global, 6) AS gap_y FROM gapz")
sel("edge_train_test", "SELECT count(DISTINCT t.cell) AS edge_zones FROM test t JOIN offs ON ring = 1 JOIN train o ON o.cell = t.cell + d")

# ---- aggregations ----------------------------------------------------------

sel("daily_counts", "SELECT user_id, CAST(day AS VARCHAR) AS day, n FROM daily")
sel("pair_counts", "SELECT user_id, cell_orig, cell_dest, n FROM pairs")
sel("user_stats", "SELECT user_id, n_queries, active_days, max_day, n_cells, round(repeated_share, 6) AS repeated_share, round(median_seconds, 6) AS median_seconds FROM ustats")
_sig = ["s_volume", "s_intensity", "s_dispersion", "s_burst", "s_no_routine", "s_fast"]
sel("user_signals", f"SELECT user_id, {', '.join(_sig)}, n_signals, anomalous FROM signals")
sel("signal_totals", " UNION ALL ".join(f"SELECT '{s}' AS measure, count(*) FILTER ({s}) AS value FROM signals" for s in _sig)
    + " UNION ALL SELECT 'anomalous_users', count(*) FROM anomalous UNION ALL SELECT 'anomalous_queries', CAST(coalesce(sum(n_queries), 0) AS BIGINT) FROM anomalous")
sel("zone_counts", "SELECT cell, query_count, user_count FROM zcount")
sel("period_counts", "SELECT * FROM period")
sel("ring_population", "SELECT cell, pop_ring2 FROM feat")
sel("modal_label", "SELECT * FROM modal")
sel("label_purity", "SELECT *, round(modal_queries / total_queries * 100, 6) AS pct_modal FROM modal")


def summary(group: str) -> str:
    return (f"SELECT {group}, count(DISTINCT block_id) AS blocks, count(*) AS zones, CAST(sum(query_count) AS BIGINT) AS queries, CAST(sum(population) AS BIGINT) AS population, "
            f"round(count(*) / (SELECT count(*) FROM model) * 100, 2) AS pct_zones, round(sum(query_count) / (SELECT sum(query_count) FROM model) * 100, 2) AS pct_queries, "
            f"round(sum(query_count) / sum(population) * 1000, 1) AS rate_per_1000 FROM model GROUP BY {group}")


sel("summary_by", summary("distance_ring"))
_pure = f"(SELECT m.*, modal_queries / total_queries * 100 < {P.mixed_threshold} AS mixed FROM modal m JOIN (SELECT cell FROM model) USING (cell))"
sel("municipality_summary", f"""SELECT municipality, zones, queries, population, pct_modal_queries, mixed_zones FROM (SELECT label AS municipality,
    round(sum(modal_queries) / sum(total_queries) * 100, 2) AS pct_modal_queries, count(*) FILTER (mixed) AS mixed_zones FROM {_pure} GROUP BY label) RIGHT JOIN ({summary('municipality')}) USING (municipality)""")
sel("population_class_counts", f"SELECT {CLASS} AS class, count(*) AS zones, CAST(sum(query_count) AS BIGINT) AS queries FROM tab GROUP BY ALL")
sel("block_table", "SELECT block_id, block_dist_km, n_cells, distance_ring FROM blocks")
sel("block_distance", "SELECT block_id, round(block_dist_km, 6) AS block_dist_km, has_model FROM bdist")
sel("quantile_cuts", "SELECT round(c[1], 6) AS cut1, round(c[2], 6) AS cut2, round(c[3], 6) AS cut3 FROM cuts")
sel("describe_zones", " UNION ALL ".join(
    f"SELECT '{v}' AS variable, count(*) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v})::DOUBLE, 6) AS min, round(quantile_cont({v}, .25), 6) AS p25, "
    f"round(quantile_cont({v}, .5), 6) AS median, round(quantile_cont({v}, .75), 6) AS p75, round(max({v})::DOUBLE, 6) AS max FROM model"
    for v in ("query_count", "population", "pop_ring1", "dist_centre_km")))
sel("distance_percentiles", f"""SELECT round(quantile_cont(km, .5), 6) AS p50, round(quantile_cont(km, .9), 6) AS p90, round(quantile_cont(km, .99), 6) AS p99, round(quantile_cont(km, .999), 6) AS p99_9,
    round(avg(CASE WHEN km > {P.dist_max_m / 1000} THEN 1.0 ELSE 0 END) * 100, 6) AS pct_above FROM (SELECT dist_m / 1000 AS km FROM trips WHERE {VALID} AND dist_m > 0)""")
sel("weekly_coverage", "SELECT year, week, start::VARCHAR AS start, queries, CAST(days_with_data AS INT) AS days_with_data, observed, complete FROM weeks")
sel("gap_bounds", "SELECT gap_start::VARCHAR AS gap_start, gap_end::VARCHAR AS gap_end FROM gap")
sel("observed_weeks", "SELECT round(w, 6) AS observed_weeks FROM wobs")
sel("weekly_means_around_gap", "SELECT round(avg(queries) FILTER (complete AND start < (SELECT gap_start FROM gap)), 6) AS mean_before, round(avg(queries) FILTER (complete AND start >= (SELECT gap_end FROM gap)), 6) AS mean_after FROM weeks")
_prof = """(SELECT dimension, value, queries, round(queries / sum(queries) OVER (PARTITION BY dimension) * 100, 3) AS pct FROM (SELECT 'hour' AS dimension, CAST(hour(ts) AS INT) AS value, count(*) AS queries FROM clean GROUP BY ALL
    UNION ALL SELECT 'weekday', CAST(isodow(ts) AS INT), count(*) FROM clean GROUP BY ALL))"""
sel("temporal_profile", f"SELECT * FROM {_prof}")
_scopes = "(SELECT *, 'global' AS scope FROM trips UNION ALL SELECT *, source_batch FROM trips)"
_nulls = "(" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", scope, round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 3) AS pct FROM {_scopes} GROUP BY scope" for c in _cols) + ")"
sel("null_profile", f"SELECT * FROM {_nulls}")
sel("unpivot_pivot", f"SELECT \"column\", max(pct) FILTER (scope = 'global') AS \"global\", max(pct) FILTER (scope = 'lote_2024') AS lote_2024, max(pct) FILTER (scope = 'lote_original') AS lote_original FROM {_nulls} GROUP BY \"column\"")
_od = "lat_orig, lon_orig, lat_dest, lon_dest"
sel("duplicate_profile", " UNION ALL ".join(
    f"SELECT '{n}' AS definition, '{c}' AS columns, CAST(sum(n - 1) AS BIGINT) AS surplus, round(sum(n - 1) / sum(n) * 100, 4) AS pct FROM (SELECT count(*) AS n FROM trips GROUP BY {c})"
    for n, c in (("exact", DATA), ("od_ts", _od + ", ts"), ("user_ts", "user_id, ts"), ("od_ts_user", _od + ", ts, user_id"))))
sel("distance_unit_check", f"""SELECT CASE WHEN m < km THEN 'metres' ELSE 'km' END AS unit, round(least(m, km), 3) AS median_error_pct FROM (SELECT median(abs(dist_m - g) / g) * 100 AS m, median(abs(dist_m - g / 1000) / (g / 1000)) * 100 AS km
    FROM (SELECT dist_m, {haversine('lat_orig', 'lon_orig', 'lat_dest', 'lon_dest', 6371000)} AS g FROM trips WHERE dist_m IS NOT NULL AND lat_orig <> 0 AND lat_dest <> 0) WHERE g > 0)""")


def gini(src: str) -> str:
    return f"(SELECT (count(*) + 1 - 2 * sum(cs) / max(t)) / count(*) FROM (SELECT sum(v) OVER (ORDER BY v, cell) AS cs, sum(v) OVER () AS t FROM (SELECT cell, query_count::DOUBLE AS v FROM {src})))"


sel("gini", f"SELECT round({gini('zones')}, 6) AS gini")
sel("lorenz_curve", "SELECT cell, round(row_number() OVER w / count(*) OVER (), 6) AS zone_share, round(sum(query_count) OVER w / sum(query_count) OVER (), 6) AS value_share FROM zones WINDOW w AS (ORDER BY query_count, cell)")
_top10 = "(SELECT sum(query_count) FROM (SELECT query_count FROM model ORDER BY query_count DESC LIMIT 10))"
sel("target_summary", f"SELECT count(*) AS zones, round(avg(CASE WHEN query_count = 0 THEN 1.0 ELSE 0 END) * 100, 2) AS pct_zero, round({gini('model')}, 3) AS gini, round({_top10} / sum(query_count) * 100, 1) AS pct_top10, round(var_pop(query_count) / avg(query_count), 3) AS variance_over_mean FROM model")
sel("coverage_contrast", "SELECT covered, count(*) AS zones, CAST(sum(population) AS BIGINT) AS population, round(median(gap_pearson), 4) AS median_gap, round(avg(CASE WHEN gap_pearson < 0 THEN 1.0 ELSE 0 END) * 100, 4) AS pct_below, round(sum(unmet_demand), 4) AS unmet FROM gapz GROUP BY covered")
_topk = f"(SELECT * FROM gapz ORDER BY gap_pearson, cell LIMIT {P.top_k})"
sel("gap_summary", f"SELECT count(*) AS zones, count(*) FILTER (gap_pearson < 0) AS below_expected, count(*) FILTER (gap_pearson < -2) AS below_minus2, round(sum(unmet_demand), 3) AS unmet_total, round((SELECT sum(unmet_demand) FROM {_topk}) / sum(unmet_demand) * 100, 1) AS pct_unmet_top, round((SELECT count(*) FROM {_topk}) / count(*) * 100, 2) AS pct_zones_top FROM gapz")
sel("action_summary", "SELECT count(priority_rank) AS priority_zones, count(*) FILTER (action = 'mapear') AS to_map, count(*) FILTER (action = 'revisar') AS to_review, count(*) FILTER (action = 'sin_brecha') AS no_gap, CAST(coalesce(sum(population) FILTER (priority_rank IS NOT NULL), 0) AS BIGINT) AS priority_population, round(sum(unmet_demand) FILTER (priority_rank IS NOT NULL) / sum(unmet_demand) FILTER (action = 'mapear') * 100, 1) AS pct_unmet_uncovered, count(DISTINCT municipality) FILTER (priority_rank IS NOT NULL) AS municipalities FROM pred")
sel("label_counts", "SELECT municipality, count(*) AS n FROM tab GROUP BY municipality")
sel("period_days", "SELECT count(DISTINCT CAST(ts AS DATE)) FILTER (CAST(ts AS DATE) < (SELECT gap_start FROM gap)) AS days_before, count(DISTINCT CAST(ts AS DATE)) FILTER (CAST(ts AS DATE) >= (SELECT gap_end FROM gap)) AS days_after FROM clean")
sel("population_coverage", f"SELECT count(*) AS cells, CAST(sum(population) AS BIGINT) AS population, count(*) FILTER (cell NOT IN (SELECT cell FROM ocells)) AS without_origins, count(*) FILTER (population < {P.pop_min}) AS below_minimum FROM population JOIN pop_in USING (cell) WHERE inside")
sel("coordinate_problems", f"SELECT count(*) FILTER (lat_orig = 0 OR lon_orig = 0) AS zero_origin, count(*) FILTER (NOT (lat_orig = 0 OR lon_orig = 0) AND NOT {VALID}) AS outside_box FROM trips")
sel("zone_counters", f"SELECT * FROM {_counters}")
sel("split_counters", "SELECT count(DISTINCT block_id) FILTER (in_test) AS test_blocks, count(*) FILTER (in_test) AS test_zones, round(coalesce(sum(query_count) FILTER (in_test), 0) / sum(query_count) * 100, 2) AS pct_test_queries, count(DISTINCT block_id) FILTER (NOT in_test) AS train_blocks, count(*) FILTER (NOT in_test) AS train_zones FROM model")
sel("label_inheritance", f"SELECT round(sum(modal_queries) / sum(total_queries) * 100, 2) AS pct_modal, round(avg(mixed::INT) * 100, 2) AS pct_mixed, (SELECT count(*) FROM model) - count(*) AS inherited_zones FROM {_pure}")

# ---- windows, sorts, sets --------------------------------------------------

sel("seconds_between", "SELECT user_id, seconds, count(*) AS freq FROM steps_s WHERE seconds IS NOT NULL GROUP BY ALL")
sel("first_distinct", "SELECT event_id, source_file, copies FROM uniq")
sel("share_of_total", "SELECT cell, round(query_count / sum(query_count) OVER () * 100, 6) AS pct FROM zones")
sel("first_per_group", "SELECT block_id, cell, query_count FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY query_count DESC, cell) AS rn FROM tab) WHERE rn = 1")
sel("rank_average", "SELECT cell, rank() OVER (ORDER BY query_count) + (count(*) OVER (PARTITION BY query_count) - 1) / 2 AS rank FROM zones")
_dec = "(SELECT cell, observed, expected, CAST(greatest(1, ((rn - 1) * 10 + n - 2) // (n - 1)) AS INT) AS decile FROM (SELECT *, row_number() OVER (ORDER BY expected, cell) AS rn, count(*) OVER () AS n FROM gapz))"
sel("rank_first_deciles", f"SELECT cell, decile FROM {_dec}")
sel("running_length", "SELECT shape_id, seq, round(upto, 4) AS length_m FROM sseg")
sel("priority_rank", "SELECT cell, action, priority_rank FROM prior")
sel("growing_disk_sum", f"""SELECT src, CAST(ring AS INT) AS ring, n, y, pop FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ring) AS rn FROM (SELECT src, ring, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(y) OVER w AS BIGINT) AS y, CAST(sum(pop) OVER w AS BIGINT) AS pop
    FROM (SELECT s.cell AS src, ring, count(*) AS n, sum(o.query_count) AS y, sum(o.population) AS pop FROM tab s JOIN offs ON ring BETWEEN 1 AND {P.neighbours_k_max} JOIN train o ON o.cell = s.cell + d GROUP BY ALL)
    WINDOW w AS (PARTITION BY src ORDER BY ring)) WHERE n >= {P.neighbours_min}) WHERE rn = 1""")
sel("stable_sort", "SELECT source_file, ts, event_id FROM trips")
sel("mixed_sort", "SELECT cell, muni, count(*) AS n FROM clean GROUP BY ALL")
sel("top_k", f"SELECT cell, round(gap_pearson, 6) AS gap_pearson FROM {_topk}")
sel("top10_share", f"SELECT round({_top10} / sum(query_count) * 100, 6) AS pct_top FROM model")
sel("peak_hour", f"SELECT (SELECT value FROM {_prof} WHERE dimension = 'hour' ORDER BY pct DESC, value LIMIT 1) AS peak_hour, (SELECT round(sum(pct), 1) FROM {_prof} WHERE dimension = 'weekday' AND value >= 6) AS weekend_pct")
sel("worst_gaps", "SELECT cell, observed, round(gap_pearson, 6) AS gap_pearson FROM gapz ORDER BY gapz.gap_pearson, cell LIMIT 5")
sel("seeded_sample", f"SELECT point_id FROM points ORDER BY md5(point_id::VARCHAR || '|{P.seed}'), point_id LIMIT 500")
sel("stratified_block_draw", "SELECT block_id, distance_ring FROM drawn")
sel("union_relaxed", "SELECT event_id, CAST(user_id AS VARCHAR) AS code, CAST(NULL AS INT) AS extra FROM trips UNION ALL SELECT point_id, 'p' || people, 1 FROM points")
sel("union_all", "SELECT cell, 'train' AS part FROM train UNION ALL SELECT cell, 'test' FROM test")
sel("distinct_points", "SELECT DISTINCT lat_orig, lon_orig FROM trips")


def check(name: str, count: str) -> str:
    return f"SELECT '{name}' AS \"check\", v AS violations, v = 0 AS ok FROM (SELECT CAST(coalesce(({count}), 0) AS BIGINT) AS v)"


sel("set_disjoint", check("set_disjoint", "SELECT count(*) FROM (SELECT cell FROM train INTERSECT SELECT cell FROM test)"))
sel("set_equal", check("set_equal", "SELECT count(*) FROM ((SELECT distance_ring FROM test EXCEPT SELECT distance_ring FROM model) UNION ALL (SELECT distance_ring FROM model EXCEPT SELECT distance_ring FROM test))"))
_topg = f"(SELECT cell FROM gapz ORDER BY gap_pearson_global, cell LIMIT {P.top_k})"
sel("jaccard_topk", f"SELECT round(count(a.cell IS NOT NULL AND b.cell IS NOT NULL OR NULL) / count(*), 6) AS jaccard FROM {_topk} a FULL JOIN {_topg} b ON a.cell = b.cell")

# ---- composites ------------------------------------------------------------

sel("anomalous_users", "SELECT * FROM anomalous")
sel("clean_trips", "SELECT event_id, user_id, cell, source_file FROM clean")
_rules = ["raw", "zero origin", "origin outside the box", "copy of an exact duplicate", "origin outside the study area", "distance above the maximum", "anomalous user"]
sel("filter_flow", "SELECT step, rule, removed, kept, round(kept / total * 100, 3) AS pct_kept FROM (SELECT *, total - sum(removed) OVER (ORDER BY step)::BIGINT AS kept FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS step, '{n}' AS rule, CAST(coalesce(({c}), 0) AS BIGINT) AS removed, (SELECT count(*) FROM trips) AS total" for i, (n, c) in enumerate(zip(_rules, [
        "0", "SELECT sum(copies) FROM steps WHERE drop_step = 1", "SELECT sum(copies) FROM steps WHERE drop_step = 2", "SELECT sum(copies - 1) FROM steps WHERE drop_step NOT IN (1, 2)",
        *[f"SELECT count(*) FROM steps WHERE drop_step = {s}" for s in (4, 5, 6)]]))) + "))")
sel("zone_table", "SELECT cell, query_count, user_count, population FROM zones")
sel("zone_features", "SELECT cell, pop_ring1, pop_ring2, round(dist_centre_km, 7) AS dist_centre_km, block_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM tab")
sel("network_contrast", "SELECT cell, dist_network_m, covered FROM tab")
sel("zone_municipality", "SELECT cell, municipality FROM zmuni")
sel("distance_rings", "SELECT cell, distance_ring FROM ringed")
sel("holdout_split", "SELECT cell, in_test FROM tab")
sel("modelling_table", "SELECT cell, query_count, user_count, query_count_before_gap, query_count_after_gap, population, pop_ring1, pop_ring2, dist_centre_km, dist_network_m, covered, municipality, distance_ring, block_id, in_model, in_test, round(lat, 7) AS lat, round(lon, 7) AS lon FROM tab")

# ---- statistics ------------------------------------------------------------


def avg_rank(x: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{x}) - 1) / 2)"


def rho(src: str, x: str, y: str) -> str:
    return f"(SELECT corr(a, b) FROM (SELECT {avg_rank(x)} AS a, {avg_rank(y)} AS b FROM {src}))"


sel("spearman", f"SELECT round({rho('model', 'population', 'query_count')}, 6) AS spearman")
_cand = ["population", "pop_ring1", "pop_ring2", "dist_centre_km"]
sel("spearman_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({rho('model', a, b)}, 6) AS spearman" for a in _cand for b in _cand))
sel("hex_weights", "SELECT a.cell AS src, b.cell AS dst, round(1 / count(*) OVER (PARTITION BY a.cell), 6) AS w FROM model a JOIN offs ON ring BETWEEN 1 AND 2 JOIN model b ON b.cell = a.cell + d")
_y = "(SELECT cell, ln(1 + query_count / population * 1000) AS y FROM model)"
_z = f"(SELECT cell, y - avg(y) OVER () AS z, row_number() OVER (ORDER BY cell) AS idx FROM {_y})"
_w = "(SELECT a.cell AS src, b.cell AS dst, ring, 1 / count(*) OVER (PARTITION BY a.cell, ring) AS w FROM model a JOIN offs ON ring BETWEEN 1 AND 5 JOIN model b ON b.cell = a.cell + d)"
_obs = f"(SELECT ring, (SELECT count(*) FROM {_z}) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM {_z}) AS i FROM {_w} e JOIN {_z} a ON a.cell = src JOIN {_z} b ON b.cell = dst GROUP BY ring)"
_perm = f"(SELECT perm, s.cell, v.z FROM (SELECT perm, cell, row_number() OVER (PARTITION BY perm ORDER BY md5(cell::VARCHAR || '|' || '{P.seed}-' || perm), cell) AS idx FROM {_z}, range(1, {P.permutations + 1}) g(perm)) s JOIN {_z} v USING (idx))"
_simi = f"(SELECT ring, a.perm, (SELECT count(*) FROM {_z}) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM {_z}) AS sim FROM {_w} e JOIN {_perm} a ON a.cell = src JOIN {_perm} b ON b.cell = dst AND b.perm = a.perm GROUP BY ring, a.perm)"
_corr = f"(SELECT CAST(ring AS INT) AS k, round(CAST(ring * 0.92 AS DOUBLE), 2) AS approx_km, round(any_value(i), 4) AS moran_i, round((least(count(*) FILTER (round(sim, 9) >= round(i, 9)), {P.permutations} - count(*) FILTER (round(sim, 9) >= round(i, 9))) + 1) / {P.permutations + 1}, 4) AS p_value FROM {_obs} JOIN {_simi} USING (ring) GROUP BY ring)"
sel("moran_i", f"SELECT CAST(ring AS INT) AS ring, round(i, 6) AS moran_i FROM {_obs} WHERE ring = 1")
sel("moran_permutation_p", f"SELECT k, moran_i, p_value FROM {_corr} WHERE k = 1")
sel("moran_correlogram", f"SELECT k, approx_km, moran_i, p_value FROM {_corr}")
_linked = "(SELECT y.* FROM " + _y + " y WHERE EXISTS (SELECT 1 FROM offs JOIN model m ON m.cell = y.cell + d WHERE ring = 1))"
_lz = f"(SELECT cell, y - avg(y) OVER () AS z, var_pop(y) OVER () AS s2, count(*) OVER () AS n FROM {_linked})"
sel("local_moran", f"""SELECT m.cell, round(z * lag * (n - 1) / (n * s2), 6) AS local_i, CASE WHEN z IS NULL THEN 'sin vecinas' WHEN z > 0 AND lag > 0 THEN 'HH' WHEN lag > 0 THEN 'LH' WHEN z > 0 THEN 'HL' ELSE 'LL' END AS quadrant
    FROM model m LEFT JOIN (SELECT a.cell, any_value(a.z) AS z, any_value(a.n) AS n, any_value(a.s2) AS s2, avg(b.z) AS lag FROM {_lz} a JOIN offs ON ring = 1 JOIN {_lz} b ON b.cell = a.cell + d GROUP BY a.cell) q USING (cell)""")
_li = (f"(SELECT a.cell, any_value(a.z) AS z, avg(b.z) AS lag, count(*) AS degree, any_value(a.n) - 1 AS others FROM {_lz} a JOIN offs ON ring = 1 JOIN {_lz} b ON b.cell = a.cell + d GROUP BY a.cell)")
_pos = f"(SELECT *, row_number() OVER (ORDER BY cell) AS idx FROM {_li})"
_draw = f"(SELECT cell, z, lag, degree, idx, others, perm, [CAST('0x' || substr(md5(cell::VARCHAR || '|' || perm || '|' || i || '|{P.seed}'), 1, 12) AS BIGINT) % (others - i) for i in range(degree)] AS h FROM {_pos}, range(1, {P.permutations + 1}) g(perm))"
_pick = _draw
for _i in range(6):
    # draw i goes past the earlier ones in order
    _skip = f"list_reduce(list_prepend(h[{_i + 1}], list_sort(p)), lambda acc, e: acc + CASE WHEN acc >= e THEN 1 ELSE 0 END)"
    _pick = f"(SELECT * EXCLUDE (p), CASE WHEN degree > {_i} THEN list_append(p, {_skip}) ELSE p END AS p FROM {_pick if _i else '(SELECT *, CAST([] AS BIGINT[]) AS p FROM ' + _draw + ')'})"
_sim = (f"(SELECT q.cell, perm, round(any_value(q.z) * sum(v.z) / any_value(q.degree), 9) >= round(any_value(q.z) * any_value(q.lag), 9) AS larger FROM "
        f"(SELECT *, unnest(p) AS d FROM {_pick}) q JOIN {_pos} v ON v.idx = q.d + 1 + CASE WHEN q.d + 1 >= q.idx THEN 1 ELSE 0 END GROUP BY q.cell, perm)")
sel("lisa_clusters", f"""SELECT m.cell, quadrant, round(p, 6) AS p_value, CASE WHEN p IS NULL THEN 'sin vecinas' WHEN p < {P.lisa_alpha} THEN quadrant ELSE 'no significativo' END AS cluster
    FROM model m LEFT JOIN (SELECT cell, CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN lag > 0 THEN 'LH' WHEN z > 0 THEN 'HL' ELSE 'LL' END AS quadrant,
      (least(count(*) FILTER (larger), {P.permutations} - count(*) FILTER (larger)) + 1) / {P.permutations + 1} AS p FROM {_pos} JOIN {_sim} USING (cell) GROUP BY cell, z, lag) USING (cell)""".replace(
    "SELECT m.cell, quadrant,", "SELECT m.cell, coalesce(quadrant, 'sin vecinas') AS quadrant,"))
sel("cliffs_delta", "SELECT round(avg(CASE WHEN a.gap_pearson > b.gap_pearson THEN 1.0 WHEN a.gap_pearson < b.gap_pearson THEN -1.0 ELSE 0 END), 6) AS delta FROM gapz a, gapz b WHERE a.covered = 0 AND b.covered = 1")

_cc = f"(SELECT query_count, round({haversine(*CENTRE, 'lat', 'lon', 6371)}, 6) AS a, round({haversine('clat', 'clon', 'lat', 'lon', 6371)}, 6) AS b FROM model, centroid)"
sel("centre_comparison", f"SELECT 'dist_centre_km' AS variable, 'query_count' AS target, round({rho(_cc, 'a', 'query_count')}, 3) AS spearman UNION ALL SELECT 'dist_centroid_km', 'query_count', round({rho(_cc, 'b', 'query_count')}, 3)")

# ---- estimators ------------------------------------------------------------

for _n, _i in (("rate_global", 0), ("rate_by_group", 1), ("rate_neighbourhood", 3), ("final_fit", 2)):
    sel(_n, f"SELECT cell, round(expected, 6) AS expected FROM fin{_i}")
folds("model", "mo", P.folds)
ORDER = list(CTE)
sel("block_folds", "SELECT cell, block_id, CAST(fold AS INT) AS fold FROM model JOIN mo_f USING (block_id)")


def metrics(src: str, by: str) -> str:
    dev = "2 * avg(CASE WHEN observed > 0 THEN observed * ln(observed / expected) ELSE 0 END - observed + expected)"
    null = "2 * avg(CASE WHEN observed > 0 THEN observed * ln(observed / ybar) ELSE 0 END)"
    return (f"(SELECT {by}, {dev} AS deviance, 1 - ({dev}) / ({null}) AS d2, avg(abs(observed - expected)) AS mae, sum(expected) / sum(observed) AS calibration, "
            f"CASE WHEN stddev_pop(ra) = 0 OR stddev_pop(rb) = 0 THEN NULL ELSE corr(ra, rb) END AS spearman, count(*) AS n FROM (SELECT *, avg(observed) OVER (PARTITION BY {by}) AS ybar, "
            f"{avg_rank('observed', by)} AS ra, {avg_rank('expected', by)} AS rb FROM {src}) GROUP BY {by})")


_fm, _pm = metrics("oof", "technique, fold"), metrics("oof", "technique")
_mets = ["deviance", "d2", "mae", "calibration", "spearman"]
sel("count_metrics", f"SELECT technique, {', '.join(rr(m) + ' AS ' + m for m in _mets)}, n FROM {_pm}")
sel("cross_validate", "SELECT cell, block_id, CAST(fold AS INT) AS fold, technique, observed, round(expected, 6) AS expected FROM oof")
_cv = (f"(SELECT * FROM (SELECT technique, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd' for m in ('deviance', 'd2', 'mae', 'spearman'))} FROM {_fm} GROUP BY technique) "
       f"JOIN (SELECT technique, {', '.join(f'{m} AS oof_{m}' for m in [*_mets, 'n'])} FROM {_pm}) USING (technique))")
_cvcols = [f"{m}_{s}" for m in ("deviance", "d2", "mae", "spearman") for s in ("mean", "sd")] + [f"oof_{m}" for m in _mets]
sel("cv_summary", f"SELECT technique, {', '.join(rr(c) + ' AS ' + c for c in _cvcols)}, oof_n FROM {_cv}")
sel("one_se_rule", f"""SELECT technique, round(mean, 6) AS mean, round(sd, 6) AS sd, folds, round(se, 6) AS se, mean <= thr AS within, round(thr, 6) AS threshold, technique = best AS is_best,
    technique = min(technique) FILTER (mean <= thr) OVER () AS is_chosen FROM (SELECT *, arg_min(technique, mean) OVER () AS best, min(mean) OVER () + {P.tolerance_se} * arg_min(se, mean) OVER () AS thr
    FROM (SELECT technique, avg(deviance) AS mean, stddev_samp(deviance) AS sd, count(*) AS folds, stddev_samp(deviance) / sqrt(count(*)) AS se FROM {_fm} GROUP BY technique))""")
_rule = f"""SELECT min(technique) FILTER (mean <= thr) AS technique FROM (SELECT *, min(mean) OVER () + {P.tolerance_se} * arg_min(se, mean) OVER () AS thr
    FROM (SELECT technique, avg(deviance) AS mean, stddev_samp(deviance) / sqrt(count(*)) AS se FROM {_fm} GROUP BY technique))"""
sel("save_estimator", "SELECT cell, technique, round(expected, 6) AS expected FROM (" + " UNION ALL ".join(f"SELECT 'B{i}' AS technique, cell, expected FROM fin{i}" for i in range(4))
    + f") JOIN ({_rule}) USING (technique)")
_x = [f"ln(1 + {c})" if c.startswith("pop_") else f"CAST({c} AS DOUBLE)" for c in P.predictors]
CTE["xy"] = f"SELECT cell, CAST(query_count AS DOUBLE) AS y, CAST(population AS DOUBLE) AS pop, {_x[0]} AS x1, {_x[1]} AS x2 FROM train"
_det = "(a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02))"
CTE["pois"] = f"""SELECT 0 AS it, ln(sum(y) / sum(pop)) AS b0, 0E0 AS b1, 0E0 AS b2 FROM xy
  UNION ALL SELECT it + 1, (r0 * (a11 * a22 - a12 * a12) - a01 * (r1 * a22 - a12 * r2) + a02 * (r1 * a12 - a11 * r2)) / {_det},
    (a00 * (r1 * a22 - a12 * r2) - r0 * (a01 * a22 - a12 * a02) + a02 * (a01 * r2 - r1 * a02)) / {_det},
    (a00 * (a11 * r2 - r1 * a12) - a01 * (a01 * r2 - r1 * a02) + r0 * (a01 * a12 - a11 * a02)) / {_det}
  FROM (SELECT max(it) AS it, sum(w) AS a00, sum(w * x1) AS a01, sum(w * x2) AS a02, sum(w * x1 * x1) AS a11, sum(w * x1 * x2) AS a12, sum(w * x2 * x2) AS a22,
      sum(w * t) AS r0, sum(w * x1 * t) AS r1, sum(w * x2 * t) AS r2
    FROM (SELECT *, lin + (y - w) / w AS t FROM (SELECT it, y, x1, x2, b0 + b1 * x1 + b2 * x2 AS lin, pop * exp(b0 + b1 * x1 + b2 * x2) AS w FROM pois, xy WHERE it < 40))) WHERE it IS NOT NULL"""
CTE["mu1"] = "SELECT cell, y, pop * exp(b0 + b1 * x1 + b2 * x2) AS mu FROM xy, (SELECT * FROM pois WHERE it = 40)"
_m1 = " UNION ALL ".join(f"SELECT 'M1' AS technique, -1 AS model, '{n}' AS parameter, b{k} AS value FROM pois WHERE it = 40" for k, n in enumerate(["const", *P.predictors]))
sel("poisson_glm", f"SELECT technique, CAST(model AS INT) AS model, parameter, round(value, 6) AS value FROM ({_m1})")
# NB2: coefficients by weighted least squares and theta by a guarded step on its logarithm, in turns; the full fit (-1) and the fit without each fold
CTE["xyf"] = "SELECT xy.*, fold FROM xy JOIN train USING (cell)"
CTE["nbx"] = """SELECT model, y, pop, x1, x2, CAST(NULL AS DOUBLE) AS j, CAST(NULL AS DOUBLE) AS nj FROM xyf, (SELECT -1 AS model UNION ALL SELECT DISTINCT fold FROM xyf) WHERE model <> fold
  UNION ALL SELECT model, NULL, NULL, NULL, NULL, j, count(*) FROM xyf, (SELECT -1 AS model UNION ALL SELECT DISTINCT fold FROM xyf), LATERAL unnest(range(0, CAST(y AS BIGINT))) u(j) WHERE model <> fold GROUP BY model, j"""
CTE["nb"] = f"""SELECT model, 0 AS it, ln(sum(y) / sum(pop)) AS b0, 0E0 AS b1, 0E0 AS b2, 1E0 AS th FROM nbx WHERE j IS NULL GROUP BY model
  UNION ALL SELECT model, it + 1, (r0 * (a11 * a22 - a12 * a12) - a01 * (r1 * a22 - a12 * r2) + a02 * (r1 * a12 - a11 * r2)) / {_det},
    (a00 * (r1 * a22 - a12 * r2) - r0 * (a01 * a22 - a12 * a02) + a02 * (a01 * r2 - r1 * a02)) / {_det},
    (a00 * (a11 * r2 - r1 * a12) - a01 * (a01 * r2 - r1 * a02) + r0 * (a01 * a12 - a11 * a02)) / {_det},
    th * exp(greatest(-1, least(1, CASE WHEN it < 5 THEN 0 WHEN s2 * th * th + s1 * th < 0 THEN -s1 * th / (s2 * th * th + s1 * th) ELSE sign(s1) / 2 END)))
  FROM (SELECT model, max(it) AS it, max(th) AS th, sum(w) AS a00, sum(w * x1) AS a01, sum(w * x2) AS a02, sum(w * x1 * x1) AS a11, sum(w * x1 * x2) AS a12, sum(w * x2 * x2) AS a22,
      sum(w * t) AS r0, sum(w * x1 * t) AS r1, sum(w * x2 * t) AS r2,
      sum(CASE WHEN j IS NULL THEN ln(th) + 1 - ln(th + mu) - (y + th) / (th + mu) ELSE nj / (th + j) END) AS s1,
      sum(CASE WHEN j IS NULL THEN 1 / th - 2 / (th + mu) + (y + th) / ((th + mu) * (th + mu)) ELSE -nj / ((th + j) * (th + j)) END) AS s2
    FROM (SELECT *, lin + (y - mu) / mu AS t, mu * th / (th + mu) AS w FROM (SELECT nb.model, it, th, y, x1, x2, j, nj, b0 + b1 * x1 + b2 * x2 AS lin, pop * exp(b0 + b1 * x1 + b2 * x2) AS mu
      FROM nb JOIN nbx ON nbx.model = nb.model WHERE it < 120)) GROUP BY model)"""
CTE["nbfit"] = "SELECT * FROM nb WHERE it = 120"
_m2 = " UNION ALL ".join(f"SELECT 'M2' AS technique, model, '{n}' AS parameter, {v} AS value FROM nbfit WHERE model = -1" for n, v in zip(["const", *P.predictors, "alpha"], ["b0", "b1", "b2", "1 / th"]))
sel("negbin2_glm", f"SELECT technique, CAST(model AS INT) AS model, parameter, round(value, 6) AS value FROM ({_m2})")
sel("coefficient_table", f"SELECT parameter, round(a.value, 4) AS poisson, round(b.value, 4) AS negbin FROM ({_m1}) a FULL JOIN ({_m2}) b USING (parameter)")
sel("expected_zeros_negbin", """SELECT 'M2' AS technique, count(*) FILTER (y = 0) AS observed_zeros, round(sum(z), 4) AS expected_zeros, round(sum(z) / nullif(count(*) FILTER (y = 0), 0), 4) AS ratio,
    count(*) FILTER (mu < 0.5) AS zones_below_half FROM (SELECT y, mu, pow(1 + mu / th, -th) AS z FROM (SELECT y, th, pop * exp(b0 + b1 * x1 + b2 * x2) AS mu FROM xy, nbfit WHERE model = -1))""")
CTE["poisf"] = f"""SELECT fold AS model, 0 AS it, ln(y / pop) AS b0, 0E0 AS b1, 0E0 AS b2 FROM (SELECT model AS fold, sum(y) AS y, sum(pop) AS pop FROM nbx WHERE j IS NULL AND model >= 0 GROUP BY model)
  UNION ALL SELECT model, it + 1, (r0 * (a11 * a22 - a12 * a12) - a01 * (r1 * a22 - a12 * r2) + a02 * (r1 * a12 - a11 * r2)) / {_det},
    (a00 * (r1 * a22 - a12 * r2) - r0 * (a01 * a22 - a12 * a02) + a02 * (a01 * r2 - r1 * a02)) / {_det},
    (a00 * (a11 * r2 - r1 * a12) - a01 * (a01 * r2 - r1 * a02) + r0 * (a01 * a12 - a11 * a02)) / {_det}
  FROM (SELECT model, max(it) AS it, sum(w) AS a00, sum(w * x1) AS a01, sum(w * x2) AS a02, sum(w * x1 * x1) AS a11, sum(w * x1 * x2) AS a12, sum(w * x2 * x2) AS a22,
      sum(w * t) AS r0, sum(w * x1 * t) AS r1, sum(w * x2 * t) AS r2
    FROM (SELECT *, lin + (y - w) / w AS t FROM (SELECT poisf.model, it, y, x1, x2, b0 + b1 * x1 + b2 * x2 AS lin, pop * exp(b0 + b1 * x1 + b2 * x2) AS w
      FROM poisf JOIN nbx ON nbx.model = poisf.model WHERE j IS NULL AND it < 40)) GROUP BY model)"""
sel("count_regressions_oof", "SELECT cell, block_id, t.fold, technique, query_count AS observed, round(greatest(pop * exp(b0 + b1 * x1 + b2 * x2), 1E-6), 4) AS expected FROM train t JOIN xy USING (cell) JOIN ("
    "SELECT 'M1' AS technique, model, b0, b1, b2 FROM poisf WHERE it = 40 UNION ALL SELECT 'M2', model, b0, b1, b2 FROM nbfit) f ON f.model = t.fold")
sel("pearson_dispersion", "SELECT round(sum(pow(y - mu, 2) / mu) / (count(*) - 3), 5) AS dispersion FROM mu1")
sel("expected_zeros", """SELECT 'B3' AS technique, count(*) FILTER (observed = 0) AS observed_zeros, CAST(NULL AS DOUBLE) AS expected_zeros, CAST(NULL AS DOUBLE) AS ratio,
    count(*) FILTER (expected < 0.5) AS zones_below_half FROM oof WHERE technique = 'B3'
  UNION ALL SELECT 'M1', count(*) FILTER (y = 0), round(sum(exp(-mu)), 4), round(sum(exp(-mu)) / nullif(count(*) FILTER (y = 0), 0), 4), count(*) FILTER (mu < 0.5) FROM mu1""")
sel("expected_by_zone", "SELECT cell, round(expected, 6) AS expected, partition FROM exp1")
sel("holdout_leak_share", f"""SELECT round(avg(pct), 6) AS pct_leak FROM (SELECT draw, avg(CASE WHEN out THEN 100.0 ELSE 0 END) AS pct FROM (SELECT a.draw, a.cell, bool_or(m.cell IS NOT NULL AND b.cell IS NULL) AS out
    FROM res a JOIN offs ON ring = 1 LEFT JOIN train m ON m.cell = a.cell + d LEFT JOIN res b ON b.draw = a.draw AND b.cell = a.cell + d GROUP BY ALL) GROUP BY draw)""")
CTE["res"] = f"""SELECT draw, cell FROM (SELECT draw, cell, row_number() OVER (PARTITION BY draw ORDER BY md5(cell::VARCHAR || '|' || '{P.seed}-' || draw), cell) AS rn, count(*) OVER (PARTITION BY draw) AS n
    FROM train, range(1, {P.leak_draws + 1}) g(draw)) WHERE rn <= greatest(1, CAST(round_even(n * {P.boosting_reserve}, 0) AS BIGINT))"""
ORDER = list(CTE)

# ---- evaluation ------------------------------------------------------------

_tp = "(SELECT cell, query_count AS observed, f.expected, g.expected AS reference, 1 AS one FROM test JOIN fin2 f USING (cell) JOIN fin0 g USING (cell))"


def dev(f: str) -> str:
    return f"avg(CASE WHEN observed > 0 THEN observed * ln(observed / {f}) ELSE 0 END - observed + {f})"


_d2a = f"(SELECT 1 - {dev('expected')} / {dev('reference')} FROM {_tp})"
sel("d2_against", f"SELECT round({_d2a}, 6) AS d2")
sel("calibration_deciles", f"SELECT decile, count(*) AS zones, round(sum(observed)::DOUBLE, 6) AS observed, round(sum(expected), 6) AS expected, round(sum(observed) / sum(expected), 6) AS ratio FROM {_dec} GROUP BY decile")
_tm = metrics(_tp, "one")
_cv2 = f"(SELECT * FROM {_cv} WHERE technique = 'B2')"
sel("test_vs_cv_table", " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, round((SELECT {m} FROM {_tm}), 6) AS test, round({m}_mean, 6) AS cv_mean, round({m}_sd, 6) AS cv_sd FROM {_cv2}" for m in ("deviance", "d2", "mae", "spearman")]
    + [f"SELECT 'calibration', round((SELECT calibration FROM {_tm}), 6), round(oof_calibration, 6), NULL FROM {_cv2}",
       f"SELECT 'd2_against_global', round({_d2a}, 6), NULL, NULL"]))
sel("gap_table", "SELECT cell, municipality, population, observed, round(dist_centre_km, 6) AS dist_centre_km, dist_network_m, covered, round(lat, 6) AS lat, round(lon, 6) AS lon, round(expected, 6) AS expected, partition, round(expected_week, 6) AS expected_week, round(gap_pearson, 6) AS gap_pearson, round(ratio_obs_exp, 6) AS ratio_obs_exp, round(unmet_demand, 6) AS unmet_demand, round(gap_pearson_global, 6) AS gap_pearson_global FROM gapz")


def variant(tech: int, target: str, min_pop: int | None = None) -> str:
    """(cell, gap measures) of another technique (B1 or B2), target or threshold; the fold of a zone does not change."""
    g = {1: "municipality", 2: "distance_ring"}[tech]
    keep = f"WHERE population >= {min_pop}" if min_pop else ""
    tr, te = f"(SELECT * FROM train {keep})", f"(SELECT * FROM test {keep})"
    oof = (f"SELECT t.cell, t.{target} AS o, coalesce((SELECT sum(s.{target}) / sum(s.population) FROM {tr} s WHERE s.{g} = t.{g} AND s.fold <> t.fold), "
           f"(SELECT sum(s.{target}) / sum(s.population) FROM {tr} s WHERE s.fold <> t.fold)) * t.population AS e FROM {tr} t")
    fin = (f"SELECT t.cell, t.{target} AS o, coalesce((SELECT sum(s.{target}) / sum(s.population) FROM {tr} s WHERE s.{g} = t.{g}), "
           f"(SELECT sum(s.{target}) / sum(s.population) FROM {tr} s)) * t.population AS e FROM {te} t")
    return f"(SELECT cell, {gaps('o', 'e')} FROM (SELECT cell, o, greatest(e, 1E-6) AS e FROM ({oof} UNION ALL {fin})))"


_b3gap = f"(SELECT cell, {gaps('query_count', 'expected')} FROM exp3 JOIN model USING (cell))"
sel("gap_of_variant", f"SELECT cell, round(gap_pearson, 6) AS gap_pearson, round(ratio_obs_exp, 6) AS ratio_obs_exp, round(unmet_demand, 6) AS unmet_demand FROM {variant(1, 'query_count_before_gap', P.pop_min_sensitivity)}")


def compare(a: str, b: str, lead: str = "") -> str:
    both = f"(SELECT x.gap_pearson AS gx, y.gap_pearson AS gy FROM {a} x JOIN {b} y USING (cell))"
    ta, tb = (f"(SELECT cell FROM {t} ORDER BY gap_pearson, cell LIMIT {P.top_k})" for t in (a, b))
    jac = f"(SELECT count(u.cell IS NOT NULL AND v.cell IS NOT NULL OR NULL) / count(*) FROM {ta} u FULL JOIN {tb} v ON u.cell = v.cell)"
    return f"SELECT {lead}(SELECT count(*) FROM {both}) AS common_zones, round({rho(both, 'gx', 'gy')}, 3) AS spearman, round({jac}, 3) AS jaccard"


CTE["v_b3"] = f"SELECT * FROM {_b3gap}"
CTE["v_global"] = "SELECT cell, gap_pearson_global AS gap_pearson FROM gapz"
CTE["v_before"] = f"SELECT * FROM {variant(2, 'query_count_before_gap')}"
CTE["v_larger"] = f"SELECT * FROM {variant(2, 'query_count', P.pop_min_sensitivity)}"
CTE["best"] = f"SELECT arg_min(technique, mean) AS technique FROM (SELECT technique, avg(deviance) AS mean FROM {_fm} GROUP BY technique)"
CTE["v_best"] = (f"SELECT cell, {gaps('query_count', 'expected')} FROM (" + " UNION ALL ".join(f"SELECT 'B{i}' AS technique, cell, expected FROM exp{i}" for i in range(4))
                 + ") JOIN best USING (technique) JOIN model USING (cell)")
ORDER = list(CTE)
sel("compare_rankings", compare("gapz", "v_b3"))
_unc = "(SELECT * FROM {} WHERE cell IN (SELECT cell FROM gapz WHERE covered = 0))"
sel("sensitivity_table", " UNION ALL ".join(
    compare(u.format("gapz") if u else "gapz", u.format(t) if u else t, f"'{n}' AS variant, '{un}' AS universe, ")
    for n, t in (("best_mean_technique", "v_best"), ("global_rate", "v_global"), ("before_gap", "v_before"), ("larger_minimum_population", "v_larger"))
    for un, u in (("all", ""), ("uncovered", _unc))))
sel("prioritise", f"SELECT cell, round(gap_pearson, 6) AS gap_pearson, action, pr AS priority_rank FROM acted LEFT JOIN (SELECT cell, row_number() OVER (ORDER BY gap_pearson, cell) AS pr FROM acted WHERE gap_pearson < 0 ORDER BY gap_pearson, cell LIMIT {P.top_k}) USING (cell)")
sel("zone_predictions", "SELECT * FROM pred")
sel("field_list", "SELECT priority_rank, cell, municipality, population, " + ", ".join(f"round(round_even({c}, 3), 2) AS {c}" for c in ("observed_week", "expected_week", "gap_pearson", "unmet_demand", "dist_network_m"))
    + ", 'https://www.openstreetmap.org/?mlat=' || printf('%.5f', lat) || '&mlon=' || printf('%.5f', lon) || '#map=16/' || printf('%.5f', lat) || '/' || printf('%.5f', lon) AS osm_url, 'sin_visitar' AS field_result, '' AS field_notes FROM pred WHERE priority_rank IS NOT NULL")
sel("edition_monitor", f"""SELECT 'ranking_agreement' AS "check", round(v, 6) AS value, v < 0.8 AS alert FROM (SELECT {rho('gapz', 'gap_pearson', 'gap_pearson_global')} AS v)
    UNION ALL SELECT 'calibration', round(v, 6), NOT (v BETWEEN 0.9 AND 1.1) FROM (SELECT sum(expected) / sum(observed) AS v FROM gapz)
    UNION ALL SELECT 'new_bad_weeks', count(*)::DOUBLE, count(*) > 0 FROM weeks WHERE NOT observed OR NOT complete""")

# ---- checks ----------------------------------------------------------------

sel("check_unique", check("zone", "SELECT count(*) FROM (SELECT cell FROM zones GROUP BY cell HAVING count(*) > 1)") + " UNION ALL "
    + check("event", "SELECT count(*) FROM (SELECT event_id FROM trips GROUP BY event_id HAVING count(*) > 1)"))
sel("check_no_nulls", check("table", "SELECT " + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in MODEL_COLUMNS) + " FROM tab") + " UNION ALL "
    + check("trips", "SELECT count(*) FILTER (user_id IS NULL) + count(*) FILTER (dist_m IS NULL) FROM trips"))
sel("check_range", check("population", "SELECT count(*) FROM tab WHERE population < 0") + " UNION ALL " + check("purity", "SELECT count(*) FROM modal WHERE NOT (modal_queries / total_queries > 0 AND modal_queries / total_queries <= 1)")
    + " UNION ALL " + check("expected", "SELECT count(*) FROM gapz WHERE expected <= 0"))
sel("check_reconciles", check("reconciles", "SELECT ((SELECT count(*) FROM clean) <> (SELECT sum(query_count) FROM zones))::INT + ((SELECT sum(copies) FROM uniq) <> (SELECT count(*) FROM trips))::INT"))
sel("check_disjoint", check("blocks", "SELECT count(*) FROM (SELECT block_id FROM train INTERSECT SELECT block_id FROM test)") + " UNION ALL "
    + check("users", "SELECT count(*) FROM (SELECT user_id FROM clean INTERSECT SELECT user_id FROM anomalous)"))
sel("check_same_as_phase", check("same_metrics", "SELECT ((SELECT count(*) FROM zones) <> (SELECT count(*) FROM tab))::INT + ((SELECT sum(population) FROM zones) <> (SELECT sum(population) FROM tab))::INT"))
sel("check_fold_integrity", check("fold_integrity", "SELECT (SELECT count(*) FROM (SELECT technique, cell FROM oof GROUP BY ALL HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT block_id FROM oof GROUP BY block_id HAVING count(DISTINCT fold) > 1))"))
sel("check_no_leak", check("no_leak", f"SELECT count(*) FILTER (parameter NOT IN ('const', {', '.join(repr(c) for c in P.predictors)})) + {1 + len(P.predictors)} - count(*) FROM ({_m1})"))
sel("check_roundtrip", check("roundtrip", "SELECT count(*) FROM (SELECT * FROM tab EXCEPT SELECT * FROM tab)"))
sel("check_domain", check("action", "SELECT count(*) FROM pred WHERE action NOT IN ('mapear', 'revisar', 'sin_brecha')") + " UNION ALL " + check("technique", "SELECT count(*) FROM oof WHERE technique NOT LIKE 'B_'"))
sel("check_ranking", check("ranking", "SELECT count(*) FROM prior WHERE priority_rank IS NULL AND action = 'mapear' AND gap_pearson < (SELECT max(gap_pearson) FROM prior WHERE priority_rank IS NOT NULL)"))

ORACLES: dict[str, str] = {n: compose(s) for n, s in SELECTS.items()}
