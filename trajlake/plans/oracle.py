"""The queries' answers as plain SQL over the test tables, written from the definitions and without any index."""

from __future__ import annotations

from ..sources.points import FIXTURES


def points(fixture: str = "short", n_query: int | None = 4) -> str:
    """CTEs p (points with their place i and count n), q (query vertices), qn (their number)."""
    pick = f"WHERE n = {n_query}" if n_query else ""
    return f"""raw AS ({FIXTURES[fixture]}),
p0 AS (SELECT id, x, y, t AS ts, row_number() OVER (PARTITION BY id ORDER BY t, x, y) AS i, count(*) OVER (PARTITION BY id) AS n FROM raw),
p AS (SELECT * FROM p0 WHERE n >= 2),
q AS (SELECT i AS j, x AS qx, y AS qy FROM p WHERE id = (SELECT min(id) FROM p {pick})),
qn AS (SELECT max(j) AS m FROM q),
d AS (SELECT p.id, p.i, p.n, q.j, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS d FROM p, q)"""


def reach(eps: float) -> str:
    """CTE hit (id, n_points): trajectories within eps, by reachability of free pairs."""
    return f"""free AS (SELECT id, i, j, n FROM d WHERE d <= {eps}),
walk AS (SELECT id, i, j FROM free WHERE i = 1 AND j = 1
  UNION SELECT f.id, f.i, f.j FROM walk w JOIN free f ON f.id = w.id AND f.i BETWEEN w.i AND w.i + 1 AND f.j BETWEEN w.j AND w.j + 1),
hit AS (SELECT DISTINCT f.id, f.n AS n_points FROM walk w JOIN free f ON f.id = w.id AND f.i = w.i AND f.j = w.j WHERE w.i = f.n AND w.j = (SELECT m FROM qn))"""


EXACT = """w AS (SELECT id, 2 AS s, i, j, d AS v FROM d WHERE i = 1 AND j = 1
  UNION ALL SELECT d.id, w.s + 1, d.i, d.j, greatest(d.d, min(w.v)) FROM w JOIN d ON d.id = w.id
    AND d.i BETWEEN w.i AND w.i + 1 AND d.j BETWEEN w.j AND w.j + 1 AND NOT (d.i = w.i AND d.j = w.j)
  GROUP BY d.id, w.s, d.i, d.j, d.d),
f AS (SELECT w.id, any_value(d.n) AS n_points, min(v) AS frechet FROM w JOIN d ON d.id = w.id AND d.i = w.i AND d.j = w.j
  WHERE w.i = d.n AND w.j = (SELECT m FROM qn) GROUP BY w.id)"""


def range_sql(eps: float, fixture: str = "short", n_query: int | None = 4) -> str:
    return f"WITH RECURSIVE {points(fixture, n_query)}, {reach(eps)} SELECT id, n_points FROM hit"


def knn_sql(k: int, fixture: str = "short", n_query: int | None = 4) -> str:
    return f"WITH RECURSIVE {points(fixture, n_query)}, {EXACT} SELECT id, n_points, round(frechet, 6) AS frechet FROM f ORDER BY f.frechet, id LIMIT {k}"


def batch_sql(eps: float, step: int) -> str:
    return f"""WITH RECURSIVE {points()},
qq AS (SELECT id AS qid, i AS j, n AS m, x AS qx, y AS qy FROM p WHERE id % {step} = 0),
free AS (SELECT qid, p.id, i, j, n, m FROM p, qq WHERE sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) <= {eps}),
walk AS (SELECT qid, id, i, j FROM free WHERE i = 1 AND j = 1
  UNION SELECT f.qid, f.id, f.i, f.j FROM walk w JOIN free f ON f.qid = w.qid AND f.id = w.id AND f.i BETWEEN w.i AND w.i + 1 AND f.j BETWEEN w.j AND w.j + 1)
SELECT DISTINCT w.qid, w.id FROM walk w JOIN free f ON f.qid = w.qid AND f.id = w.id AND f.i = w.i AND f.j = w.j WHERE w.i = f.n AND w.j = f.m"""


def runs(bits: int) -> str:
    """CTE t: tracklets with cell ordinals, sequence, box; r: points with their run; b: padded bounds."""
    n = 1 << bits
    return f"""b AS (SELECT min(x) AS bx0, min(y) AS by0, max(x) + 1e-7 AS bx1, max(y) + 1e-7 AS by1 FROM p),
c AS (SELECT p.*, greatest(0, least({n - 1}, CAST(floor((x - bx0) / (bx1 - bx0) * {n}) AS INT))) AS ix,
  greatest(0, least({n - 1}, CAST(floor((y - by0) / (by1 - by0) * {n}) AS INT))) AS iy FROM p, b),
g AS (SELECT *, CASE WHEN lag(ix) OVER o = ix AND lag(iy) OVER o = iy THEN 0 ELSE 1 END AS new FROM c WINDOW o AS (PARTITION BY id ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM g),
t AS (SELECT id, run, any_value(ix) AS ix, any_value(iy) AS iy, min(i) AS s, max(i) AS e, max(i) = any_value(n) AS last, count(*) AS k,
  min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM r GROUP BY id, run)"""


PIVOTS = """near AS (SELECT r.*, sqrt((r.x - (x0 + x1) / 2) * (r.x - (x0 + x1) / 2) + (r.y - (y0 + y1) / 2) * (r.y - (y0 + y1) / 2)) AS dc FROM r JOIN t USING (id, run)),
p1 AS (SELECT id, run, i, x, y FROM near QUALIFY row_number() OVER (PARTITION BY id, run ORDER BY dc, i) = 1),
p2 AS (SELECT r.id, r.run, r.i, r.x, r.y FROM r JOIN p1 a ON a.id = r.id AND a.run = r.run
  QUALIFY row_number() OVER (PARTITION BY r.id, r.run ORDER BY sqrt((r.x - a.x) * (r.x - a.x) + (r.y - a.y) * (r.y - a.y)) DESC, r.i) = 1),
p3 AS (SELECT r.id, r.run, r.i, r.x, r.y FROM r JOIN p2 a ON a.id = r.id AND a.run = r.run
  QUALIFY row_number() OVER (PARTITION BY r.id, r.run ORDER BY sqrt((r.x - a.x) * (r.x - a.x) + (r.y - a.y) * (r.y - a.y)) DESC, r.i) = 1),
pv AS (SELECT id, run, x, y FROM p1 UNION SELECT id, run, x, y FROM p2 UNION SELECT id, run, x, y FROM p3)"""


def judged(eps: float, bits: int, local: str, variant: str = "v2") -> str:
    """CTE u: the tracklets in cells near the query, with flags a (predicate), e2 (ends), l (local filter); qc: cells of vertices."""
    n = 1 << bits
    cells = f"""qw AS (SELECT q.*, bx0, by0, (bx1 - bx0) / {n} AS cw, (by1 - by0) / {n} AS ch,
  greatest(0, least({n - 1}, CAST(floor((qx - {eps} - bx0) / (bx1 - bx0) * {n}) AS INT))) AS a0, greatest(0, least({n - 1}, CAST(floor((qx + {eps} - bx0) / (bx1 - bx0) * {n}) AS INT))) AS a1,
  greatest(0, least({n - 1}, CAST(floor((qy - {eps} - by0) / (by1 - by0) * {n}) AS INT))) AS b0, greatest(0, least({n - 1}, CAST(floor((qy + {eps} - by0) / (by1 - by0) * {n}) AS INT))) AS b1,
  greatest(0, least({n - 1}, CAST(floor((qx - bx0) / (bx1 - bx0) * {n}) AS INT))) AS qix, greatest(0, least({n - 1}, CAST(floor((qy - by0) / (by1 - by0) * {n}) AS INT))) AS qiy FROM q, b),
ax AS (SELECT range AS v FROM range({n})),
qc AS (SELECT j, i.v AS ix, k.v AS iy FROM qw, ax i, ax k WHERE i.v BETWEEN a0 AND a1 AND k.v BETWEEN b0 AND b1
  AND sqrt(power(greatest(bx0 + i.v * cw - qx, 0, qx - bx0 - (i.v + 1) * cw), 2) + power(greatest(by0 + k.v * ch - qy, 0, qy - by0 - (k.v + 1) * ch), 2)) <= {eps} + 1e-9)"""
    boxes = """bq AS (SELECT qx AS rx0, qy AS ry0, qx AS rx1, qy AS ry1 FROM q)"""
    if variant == "v3":
        boxes = """qr AS (SELECT *, sum(new) OVER (ORDER BY j) AS run FROM (SELECT *, CASE WHEN lag(qix) OVER (ORDER BY j) = qix AND lag(qiy) OVER (ORDER BY j) = qiy THEN 0 ELSE 1 END AS new FROM qw)),
bq AS (SELECT min(qx) AS rx0, min(qy) AS ry0, max(qx) AS rx1, max(qy) AS ry1 FROM qr GROUP BY run)"""
    kept = {
        "dist": f"lf AS (SELECT r.id, r.run, max(nd) <= {eps} AS l FROM r JOIN (SELECT id, i, min(d) AS nd FROM d GROUP BY id, i) USING (id, i) GROUP BY r.id, r.run)",
        "pivot": f"{PIVOTS}, lf AS (SELECT id, run, max(nd) <= {eps} AS l FROM (SELECT pv.id, pv.run, pv.x, pv.y, min(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy))) AS nd FROM pv, q GROUP BY ALL) GROUP BY id, run)",
        "mbr": f"lf AS (SELECT id, run, min(sqrt(power(greatest(x0 - qx, 0, qx - x1), 2) + power(greatest(y0 - qy, 0, qy - y1), 2))) <= {eps} AS l FROM t, q GROUP BY id, run)",
    }[local]
    return f"""{cells}, {boxes}, {kept},
ends AS (SELECT d.id, max(CASE WHEN d.i = 1 AND d.j = 1 THEN d END) <= {eps} AS f1, max(CASE WHEN d.i = d.n AND d.j = (SELECT m FROM qn) THEN d END) <= {eps} AS fn FROM d GROUP BY d.id),
u AS (SELECT t.*, lf.l, (t.s > 1 OR ends.f1) AND (NOT t.last OR ends.fn) AS e2,
  EXISTS (SELECT 1 FROM bq WHERE t.x1 >= rx0 - {eps} AND t.x0 <= rx1 + {eps} AND t.y1 >= ry0 - {eps} AND t.y0 <= ry1 + {eps}) AS a
  FROM t JOIN lf USING (id, run) JOIN ends USING (id) WHERE (t.ix, t.iy) IN (SELECT (ix, iy) FROM qc))"""


def gapped(of: str) -> str:
    """SQL condition on ids: one tracklet only, or a visited cell near each vertex."""
    return f"""(nt = 1 OR NOT EXISTS (SELECT 1 FROM q WHERE NOT EXISTS (SELECT 1 FROM qc JOIN {of} z ON z.ix = qc.ix AND z.iy = qc.iy WHERE qc.j = q.j AND z.id = v.id)))"""


def approx_sql(eps: float, bits: int, local: str) -> str:
    return f"""WITH {points()}, {runs(bits)}, {judged(eps, bits, local)},
k2 AS (SELECT * FROM u WHERE e2 AND l),
v AS (SELECT id, count(*) AS nt, sum(k) AS n_points FROM k2 GROUP BY id HAVING min(s) = 1 AND bool_or(last) AND sum(k) = max(e))
SELECT id, CAST(n_points AS BIGINT) AS n_points FROM v WHERE {gapped('k2')}"""


def funnel_sql(eps: float, bits: int, local: str, variant: str) -> str:
    return f"""WITH RECURSIVE {points()}, {reach(eps)}, {runs(bits)}, {judged(eps, bits, local, variant)},
v AS (SELECT id, count(*) AS nt, coalesce(max(CASE WHEN last THEN e END), -1) AS fin, sum(k) AS k0, sum(CASE WHEN a THEN k ELSE 0 END) AS k1,
  sum(CASE WHEN a AND e2 THEN k ELSE 0 END) AS k2, sum(CASE WHEN a AND e2 AND l THEN k ELSE 0 END) AS k3 FROM u GROUP BY id),
x AS (SELECT *, {gapped('u')} AS gap, id IN (SELECT id FROM hit) AS ok FROM v)
SELECT (SELECT count(DISTINCT (ix, iy)) FROM qc) AS n_cells, CAST(sum(nt) AS BIGINT) AS n_tracklets, count(*) FILTER (k0 = fin) AS after_none, count(*) FILTER (k1 = fin) AS after_predicate,
  count(*) FILTER (k2 = fin) AS after_endpoints, count(*) FILTER (k3 = fin) AS after_local, count(*) FILTER (k3 = fin AND gap) AS after_gap, count(*) FILTER (k3 = fin AND gap AND ok) AS after_exact FROM x"""


def codes(of: str, g: int, pad: float = 1e-7) -> str:
    """CTEs for the home quadrants of the boxes (key columns a1, a2, x0..y1) in ``of``: home (a1, a2, code, level, qx, qy, w in the unit square)."""
    return f"""bb AS (SELECT min(x) - {pad} AS sx, min(y) - {pad} AS sy, max(x) + {pad} - (min(x) - {pad}) AS sw, max(y) + {pad} - (min(y) - {pad}) AS sh FROM p),
un AS (SELECT a1, a2, (x0 - sx) / sw AS u0, (y0 - sy) / sh AS v0, (x1 - sx) / sw AS u1, (y1 - sy) / sh AS v1 FROM {of}, bb),
dive AS (SELECT a1, a2, u0, v0, u1, v1, 0 AS depth, CAST(0 AS BIGINT) AS code, 0.0::DOUBLE AS hx, 0.0::DOUBLE AS hy, 1.0::DOUBLE AS w FROM un
  UNION ALL SELECT a1, a2, u0, v0, u1, v1, depth + 1, code + 1 + (2 * (v0 >= hy + w / 2)::INT + (u0 >= hx + w / 2)::INT) * ((CAST(power(4, {g} - depth) AS BIGINT) - 1) // 3),
    CASE WHEN u0 >= hx + w / 2 THEN hx + w / 2 ELSE hx END, CASE WHEN v0 >= hy + w / 2 THEN hy + w / 2 ELSE hy END, w / 2 FROM dive
  WHERE depth < {g} AND (u0 < hx + w / 2) = (u1 < hx + w / 2) AND (v0 < hy + w / 2) = (v1 < hy + w / 2)),
home AS (SELECT a1, a2, code, depth AS level, hx, hy, w FROM dive QUALIFY row_number() OVER (PARTITION BY a1, a2 ORDER BY depth DESC) = 1)"""


def shape_sql(g: int, alpha: int, beta: int) -> str:
    return f"""WITH RECURSIVE {points()}, box AS (SELECT id AS a1, 0 AS a2, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY id), {codes('box', g)},
m AS (SELECT p.id, bit_or(CAST(1 AS BIGINT) << (greatest(0, least({alpha - 1}, CAST(floor((y - (sy + hy * sh)) / (w * sh) * {alpha}) AS INT))) * {beta} + greatest(0, least({beta - 1}, CAST(floor((x - (sx + hx * sw)) / (w * sw) * {beta}) AS INT))))) AS shape
  FROM p JOIN home ON a1 = id, bb GROUP BY p.id)
SELECT id, code AS quad, level, shape, (code << {alpha * beta}) | shape AS key FROM m JOIN home ON a1 = id"""


def segment_sql(bits: int, g: int, rows: int, cols: int) -> str:
    slot = lambda v, lo, hi, n: f"(CASE WHEN {hi} <= {lo} THEN 0 ELSE greatest(0, least({n - 1}, CAST(floor(({v} - {lo}) / ({hi} - {lo}) * {n}) AS INT))) END)"
    return f"""WITH RECURSIVE {points()}, {runs(bits)}, box AS (SELECT id AS a1, run AS a2, x0, y0, x1, y1 FROM t), {codes('box', g)},
m AS (SELECT r.id, r.run, bit_or(CAST(1 AS BIGINT) << ({slot('r.y', 'y0', 'y1', rows)} * {cols} + {slot('r.x', 'x0', 'x1', cols)})) AS signature FROM r JOIN t USING (id, run) GROUP BY r.id, r.run)
SELECT t.id, t.s AS seq_start, CASE WHEN s = 1 AND last THEN 3 WHEN s = 1 THEN 0 WHEN last THEN 2 ELSE 1 END AS seg_type, home.code AS key, m.signature
FROM t JOIN m USING (id, run) JOIN home ON home.a1 = t.id AND home.a2 = t.run"""


def examined_sql(eps: float | None, k: int, g: int, alpha: int, beta: int, fixture: str = "short", n_query: int | None = 4) -> str:
    """Records whose visited sub-cells all lie near the query, those whose ends do too, and those within eps; without eps, within the k-th distance."""
    reach = "(SELECT max(frechet) FROM (SELECT frechet FROM f ORDER BY frechet, id LIMIT " + str(k) + "))" if eps is None else str(eps)
    return f"""WITH RECURSIVE {points(fixture, n_query)}, {EXACT}, tau AS (SELECT {reach} AS e),
box AS (SELECT id AS a1, 0 AS a2, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY id), {codes('box', g)},
z AS (SELECT a1 AS id, sx + hx * sw AS zx, sy + hy * sh AS zy, w * sw AS zw, w * sh AS zh FROM home, bb),
m AS (SELECT DISTINCT p.id, greatest(0, least({alpha - 1}, CAST(floor((y - zy) / zh * {alpha}) AS INT))) AS r, greatest(0, least({beta - 1}, CAST(floor((x - zx) / zw * {beta}) AS INT))) AS c FROM p JOIN z USING (id)),
v AS (SELECT id, r, c, min(sqrt(power(greatest(zx + c * (zw / {beta}) - qx, 0, qx - zx - (c + 1) * (zw / {beta})), 2) + power(greatest(zy + r * (zh / {alpha}) - qy, 0, qy - zy - (r + 1) * (zh / {alpha})), 2))) AS nd FROM m JOIN z USING (id), q GROUP BY id, r, c),
ok AS (SELECT id FROM v GROUP BY id HAVING max(nd) <= (SELECT e FROM tau) + 1e-9),
ends AS (SELECT d.id, max(CASE WHEN d.i = 1 AND d.j = 1 THEN d END) AS f1, max(CASE WHEN d.i = d.n AND d.j = (SELECT m FROM qn) THEN d END) AS fn FROM d GROUP BY d.id)
SELECT count(*) AS loaded, count(*) FILTER (greatest(f1, fn) <= e) AS after_endpoints, count(*) FILTER (greatest(f1, fn) <= e AND frechet <= e) AS after_exact FROM ok JOIN ends USING (id) JOIN f USING (id), tau"""


def home_sql(g: int) -> str:
    return f"""WITH RECURSIVE {points()}, box AS (SELECT id AS a1, 0 AS a2, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY id), {codes('box', g)}
SELECT a1 AS id, code, level FROM home"""


def window_sql(rect: tuple[float, float, float, float], g: int, alpha: int, beta: int) -> str:
    """Trajectories whose home quadrant meets a window, and those with a point in a sub-cell that does."""
    x0, y0, x1, y1 = rect
    return f"""WITH RECURSIVE {points()}, box AS (SELECT id AS a1, 0 AS a2, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY id), {codes('box', g)},
z AS (SELECT a1 AS id, sx + hx * sw AS zx, sy + hy * sh AS zy, w * sw AS zw, w * sh AS zh FROM home, bb),
m AS (SELECT DISTINCT p.id, greatest(0, least({alpha - 1}, CAST(floor((y - zy) / zh * {alpha}) AS INT))) AS r, greatest(0, least({beta - 1}, CAST(floor((x - zx) / zw * {beta}) AS INT))) AS c FROM p JOIN z USING (id)),
v AS (SELECT id, zx + c * (zw / {beta}) AS cx, zy + r * (zh / {alpha}) AS cy, zw / {beta} AS cw, zh / {alpha} AS ch FROM m JOIN z USING (id))
SELECT (SELECT count(*) FROM z WHERE zx <= {x1} AND zx + zw >= {x0} AND zy <= {y1} AND zy + zh >= {y0}) AS n_window,
  (SELECT count(DISTINCT id) FROM v WHERE cx <= {x1} AND cx + cw >= {x0} AND cy <= {y1} AND cy + ch >= {y0}) AS n_visiting"""


_LINE = "string_agg(x || ',' || y || ',' || epoch_us(ts) // 1000, ';' ORDER BY i) || ';' AS value"


def sample_sql(n: int, most_points: int = 200, seed: int = 1) -> str:
    return f"""WITH {points()}, s AS (SELECT id FROM p WHERE n <= {most_points} GROUP BY id ORDER BY md5('{seed}:' || id), id LIMIT {n})
SELECT {_LINE} FROM p JOIN s USING (id) GROUP BY id"""


def parts_sql(n: int, length: int = 30, seed: int = 1) -> str:
    return f"""WITH {points('medium', None)}, s AS (SELECT id, CAST('0x' || substr(md5('{seed}:' || id || ':offset'), 1, 8) AS BIGINT) % (any_value(n) - {length} + 1) AS o FROM p WHERE n >= {length} GROUP BY id ORDER BY md5('{seed}:' || id), id LIMIT {n})
SELECT {_LINE} FROM p JOIN s USING (id) WHERE i > o AND i <= o + {length} GROUP BY id"""


def hilbert_sql(bits: int) -> str:
    return f"""WITH RECURSIVE h AS (SELECT CAST(a.range AS INT) AS ix, CAST(b.range AS INT) AS iy, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, {1 << bits >> 1} AS s, CAST(0 AS BIGINT) AS d FROM range({1 << bits}) a, range({1 << bits}) b
  UNION ALL SELECT ix, iy, CASE WHEN ry = 1 THEN lx WHEN rx = 1 THEN s - 1 - ly ELSE ly END, CASE WHEN ry = 1 THEN ly WHEN rx = 1 THEN s - 1 - lx ELSE lx END, s // 2, d + CAST(s AS BIGINT) * s * xor(3 * rx, ry)
  FROM (SELECT *, (x & s > 0)::INT AS rx, (y & s > 0)::INT AS ry, x & (s - 1) AS lx, y & (s - 1) AS ly FROM h WHERE s > 0))
SELECT ix, iy, d AS cell FROM h WHERE s = 0"""
