"""DuckDB SQL for the engine's queries, written from the operators' definitions and not from their Spark plans."""

from __future__ import annotations

from footgrid.functions import params, tags

_OFFSETS = "offs(dr, dc, s, g) AS (VALUES (1,-1,0,1),(1,0,1,0),(1,1,0,1),(0,1,1,0),(-1,1,0,1),(-1,0,1,0),(-1,-1,0,1),(0,-1,1,0))"
_ROWS = "nr AS (SELECT count(*) // 100 AS n FROM orders)"
_CELLS = """raw AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c, o_custkey AS k, o_totalprice AS p,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN -1
         WHEN ((o_orderkey // 100 // 8) * 131 + ((o_orderkey % 100) // 8) * 71) % 7 < 3 AND o_orderpriority <> '1-URGENT' THEN 1 ELSE 0 END AS state FROM orders),
  cells AS (SELECT r, c, state, p, CASE WHEN state = 1 AND k % 3 = 0 THEN 1 WHEN state = 0 AND k % 11 = 0 THEN 0 ELSE -1 END AS origin FROM raw),
  grid AS (SELECT r, c, state, origin, CAST(CASE WHEN state = 1 AND origin = -1 THEN CASE WHEN p > 300000 THEN 60 WHEN p > 150000 THEN 30 ELSE 10 END ELSE 0 END AS DOUBLE) AS density FROM cells)"""
_SEEDS = f"{_ROWS}, seeds AS (SELECT CAST(s_suppkey AS BIGINT) AS ord, CAST(s_suppkey * 7919 % n AS INTEGER) AS r, CAST(s_suppkey * 104729 % 100 AS INTEGER) AS c FROM supplier, nr)"
_MEMBERS = f"""{_CELLS}, own AS (SELECT CAST(l_linenumber AS INTEGER) AS member, l_orderkey // 100 AS r, l_orderkey % 100 AS c, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
  members AS (SELECT m.member, grid.r, grid.c, CASE WHEN state = -1 THEN -1 WHEN f = 'A' THEN 0 WHEN f = 'N' THEN 1 WHEN f IS NOT NULL THEN 2 ELSE state END AS state, origin
    FROM grid CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS member) m LEFT JOIN own ON own.member = m.member AND own.r = grid.r AND own.c = grid.c)"""
_BOXES = f"""{_ROWS}, boxes AS (SELECT p_partkey AS pid, CAST(p_partkey * 37 % 9000 AS DOUBLE) AS x0, CAST(p_partkey * 53 % (n * 100 - 600) AS DOUBLE) AS y0,
    CAST(p_partkey * 37 % 9000 + 20 * p_size + 7 AS DOUBLE) AS x1, CAST(p_partkey * 53 % (n * 100 - 600) + 11 * p_size + 3 AS DOUBLE) AS y1 FROM part, nr)"""


def _labels(name: str, cells: str, queen: bool, key: str = "") -> str:
    """Recursive CTE: the smallest place of each cell's component."""
    k, mk, on = (f"{key}, ", f"m.{key}, ", f"m.{key} = w.{key} AND ") if key else ("", "", "")
    rook = "" if queen else "AND x.s = 1 "
    return f"""{name}({k}r, c, root) USING KEY ({k}r, c) AS (SELECT {k}r, c, CAST(r AS BIGINT) * 4294967296 + c FROM {cells} UNION
      SELECT {mk}m.r, m.c, min(w.root) FROM {name} w, offs x, recurring.{name} m WHERE {on}m.r = w.r + x.dr AND m.c = w.c + x.dc {rook}AND w.root < m.root GROUP BY {mk}m.r, m.c)"""


def _walk(name: str, cells: str, bound: float, key: str = "") -> str:
    """Recursive CTE over (key, r, c, target, open): straight and diagonal steps, a million where out of reach."""
    k, mk, on = (f"{key}, ", f"m.{key}, ", f"m.{key} = w.{key} AND ") if key else ("", "", "")
    n = "(w.o + x.s) + (w.d + x.g) * sqrt(2.0)"
    return f"""{name}({k}r, c, open, o, d) USING KEY ({k}r, c) AS (SELECT {k}r, c, open, CASE WHEN target THEN 0 ELSE 1000000 END, 0 FROM {cells} UNION
      SELECT {mk}m.r, m.c, true, arg_min(w.o + x.s, {n}), arg_min(w.d + x.g, {n}) FROM {name} w, offs x, recurring.{name} m
      WHERE w.o < 1000000 AND m.open AND {on}m.r = w.r + x.dr AND m.c = w.c + x.dc AND {n} <= {bound} + 1e-9 AND {n} < m.o + m.d * sqrt(2.0) - 1e-9 GROUP BY {mk}m.r, m.c)"""


#: The bridge's plan: parks are rook components of 16 green cells or more.
_PLAN = f"""{_OFFSETS}, {_CELLS}, {_SEEDS}, first AS (SELECT r, c, min(ord) AS ord FROM seeds GROUP BY r, c),
  base AS (SELECT g.r, g.c, CASE WHEN ord IS NOT NULL AND state <> -1 THEN 2 ELSE state END AS state, origin, density, ord IS NOT NULL AND state <> -1 AND ord % 2 = 0 AS old_centre FROM grid g LEFT JOIN first USING (r, c)),
  green AS (SELECT r, c FROM base WHERE state = 0), {_labels("gl", "green", False)},
  parks AS (SELECT r, c FROM gl WHERE root IN (SELECT root FROM gl GROUP BY root HAVING count(*) >= 16)),
  plan AS (SELECT b.r, b.c, b.origin, b.density, CASE WHEN state = -1 THEN 0 WHEN origin = 0 AND state = 0 THEN 1 WHEN origin = 0 THEN 1 WHEN p.r IS NOT NULL THEN 1
      WHEN state = 2 AND old_centre THEN 5 WHEN state = 2 THEN 3 WHEN state > 0 AND origin = 1 THEN 4 WHEN state > 0 THEN 2 ELSE 0 END AS plan FROM base b LEFT JOIN parks p USING (r, c))"""
_FIELDS = f"""{_PLAN}, pgreen AS (SELECT r, c FROM plan WHERE plan = 1), {_labels("pl", "pgreen", False)},
  ppark AS (SELECT r, c FROM pl WHERE root IN (SELECT root FROM pl GROUP BY root HAVING count(*) >= 16)),
  tc AS (SELECT r, c, plan IN (3, 5) AS target, plan <> 0 AS open FROM plan), {_walk("wc", "tc", 8)},
  tg AS (SELECT plan.r, plan.c, ppark.r IS NOT NULL AS target, plan <> 0 AS open FROM plan LEFT JOIN ppark USING (r, c)), {_walk("wg", "tg", 8)},
  dist AS (SELECT plan.r, plan.c, plan, ppark.r IS NOT NULL AS park, CASE WHEN wc.o < 1000000 THEN 100.0::DOUBLE * (wc.o + wc.d * sqrt(2.0)) END AS cd, CASE WHEN wg.o < 1000000 THEN 100.0::DOUBLE * (wg.o + wg.d * sqrt(2.0)) END AS gd
    FROM plan LEFT JOIN ppark USING (r, c) JOIN wc ON wc.r = plan.r AND wc.c = plan.c JOIN wg ON wg.r = plan.r AND wg.c = plan.c)"""
_COVER = """count(*) AS built_cells, round(avg((coalesce(cd <= 800, false))::INT), 4) AS centre_coverage, round(avg((coalesce(gd <= 400, false))::INT), 4) AS green_coverage,
    round(avg((coalesce(cd <= 800, false) AND coalesce(gd <= 400, false))::INT), 4) AS served_coverage, round(avg((NOT (coalesce(cd <= 800, false) AND coalesce(gd <= 400, false)))::INT), 4) AS unserved_fraction,
    round(avg(CASE WHEN cd <= 800 THEN cd ELSE 1600 END), 4) AS centre_access, round(avg(CASE WHEN gd <= 400 THEN gd ELSE 800 END), 4) AS green_access,
    round(avg(CASE WHEN cd <= 800 THEN cd END), 4) AS centre_walk_mean, round(avg(CASE WHEN gd <= 400 THEN gd END), 4) AS green_walk_mean,
    round(0.5 * (avg(CASE WHEN cd <= 800 THEN cd ELSE 1600 END) + avg(CASE WHEN gd <= 400 THEN gd ELSE 800 END)), 4) AS access_cost"""
_MEMBER_SCORES, _SOME_MEMBER_SCORES = (f"""{_OFFSETS}, {_MEMBERS}, ms AS (SELECT * FROM members{which}), mgreen AS (SELECT member, r, c FROM ms WHERE state = 0), {_labels("ml", "mgreen", False, "member")},
  mpark AS (SELECT member, r, c FROM ml WHERE (member, root) IN (SELECT (member, root) FROM ml GROUP BY member, root HAVING count(*) >= 16)),
  mplan AS (SELECT m.member, m.r, m.c, CASE WHEN state = 2 THEN 3 WHEN state = -1 THEN 0 WHEN origin = 0 OR p.r IS NOT NULL THEN 1 WHEN state > 0 THEN 2 ELSE 0 END AS plan FROM ms m LEFT JOIN mpark p USING (member, r, c)),
  mg2 AS (SELECT member, r, c FROM mplan WHERE plan = 1), {_labels("ml2", "mg2", False, "member")},
  mp2 AS (SELECT member, r, c FROM ml2 WHERE (member, root) IN (SELECT (member, root) FROM ml2 GROUP BY member, root HAVING count(*) >= 16)),
  mtc AS (SELECT member, r, c, plan IN (3, 5) AS target, plan <> 0 AS open FROM mplan), {_walk("mwc", "mtc", 8, "member")},
  mtg AS (SELECT p.member, p.r, p.c, q.r IS NOT NULL AS target, plan <> 0 AS open FROM mplan p LEFT JOIN mp2 q USING (member, r, c)), {_walk("mwg", "mtg", 8, "member")},
  mdist AS (SELECT p.member, plan, CASE WHEN a.o < 1000000 THEN 100.0::DOUBLE * (a.o + a.d * sqrt(2.0)) END AS cd, CASE WHEN b.o < 1000000 THEN 100.0::DOUBLE * (b.o + b.d * sqrt(2.0)) END AS gd
    FROM mplan p JOIN mwc a USING (member, r, c) JOIN mwg b USING (member, r, c)),
  scores AS (SELECT member, {_COVER} FROM mdist WHERE plan IN (2, 3, 4, 5) GROUP BY member)""" for which in ("", " WHERE member IN (1, 3, 5)"))
#: Walks of centre areas, each with its own targets.
_AUDIT = f"""{_PLAN}, cen AS (SELECT r, c FROM plan WHERE plan IN (3, 5)), {_labels("cl", "cen", True)},
  areas AS (SELECT root, cl.r, cl.c, plan FROM cl JOIN plan USING (r, c)),
  near AS (SELECT DISTINCT a.root, p.r, p.c, p.plan FROM areas a JOIN plan p ON p.r BETWEEN a.r - 4 AND a.r + 4 AND p.c BETWEEN a.c - 4 AND a.c + 4),
  ta AS (SELECT n.root, n.r, n.c, a.root IS NOT NULL AS target, n.plan <> 0 AS open FROM near n LEFT JOIN areas a ON a.root = n.root AND a.r = n.r AND a.c = n.c), {_walk("wa", "ta", 4, "root")},
  served AS (SELECT root, count(*) AS served, round(avg(100.0::DOUBLE * (o + d * sqrt(2.0))), 4) AS mean_dist FROM wa JOIN plan USING (r, c) WHERE o < 1000000 AND plan IN (2, 3, 4, 5) GROUP BY root),
  audit AS (SELECT a.root, CAST(round_even(avg(r), 0) AS INTEGER) AS row, CAST(round_even(avg(c), 0) AS INTEGER) AS col, count(*) AS cells, coalesce(any_value(s.served), 0) AS served, any_value(s.mean_dist) AS mean_dist, max(plan = 5) AS old
    FROM areas a LEFT JOIN served s USING (root) GROUP BY a.root)"""
_ARRANGED = f"""{_FIELDS}, fresh AS (SELECT r, c, row_number() OVER (ORDER BY round(coalesce(cd, 1048576), 6), r, c) AS k, count(*) OVER () AS n FROM dist WHERE plan IN (2, 3)),
  arranged AS (SELECT r, c, CAST(CASE WHEN k <= round_even(0.2 * n, 0) THEN 6000 WHEN k <= round_even(0.2 * n, 0) + round_even(0.3 * n, 0) THEN 3000 ELSE 1000 END AS DOUBLE) AS density FROM fresh),
  coded AS (SELECT p.r, p.c, CASE WHEN density IS NULL THEN plan WHEN plan = 2 THEN 6 + tier WHEN plan = 3 THEN 9 + tier ELSE plan END AS code
    FROM plan p LEFT JOIN (SELECT r, c, density AS dd, CASE density WHEN 6000 THEN 2 WHEN 3000 THEN 1 ELSE 0 END AS tier FROM arranged) a ON a.r = p.r AND a.c = p.c, (SELECT 1) one)"""
_ARRANGED = _ARRANGED.replace("CASE WHEN density IS NULL THEN plan", "CASE WHEN dd IS NULL THEN plan").replace(", (SELECT 1) one)", ")")
_GREEN_SPANS = f"""{_CELLS}, e AS (SELECT r, c, state, CASE WHEN state <> 0 THEN c END AS sc, CASE WHEN state <> 0 THEN r END AS sr, min(c) OVER (PARTITION BY r) AS c0, max(c) OVER (PARTITION BY r) AS c1, min(r) OVER (PARTITION BY c) AS r0, max(r) OVER (PARTITION BY c) AS r1 FROM grid),
  f AS (SELECT *, max(sc) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc, min(sc) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rc,
    max(sr) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ur, min(sr) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS br FROM e),
  spans AS (SELECT f.r, f.c, f.state, CAST(coalesce(f.c - lc - 1, f.c - c0) AS INTEGER) AS "left", CAST(coalesce(rc - f.c - 1, c1 - f.c) AS INTEGER) AS "right", CAST(coalesce(f.r - ur - 1, f.r - r0) AS INTEGER) AS up, CAST(coalesce(br - f.r - 1, r1 - f.r) AS INTEGER) AS down,
    a.state AS left_end, b.state AS right_end, d.state AS up_end, g.state AS down_end FROM f LEFT JOIN grid a ON a.r = f.r AND a.c = lc LEFT JOIN grid b ON b.r = f.r AND b.c = rc LEFT JOIN grid d ON d.r = ur AND d.c = f.c LEFT JOIN grid g ON g.r = br AND g.c = f.c)"""


def _bad(k: str) -> str:
    return f'("{k}" > 0 AND "{k}" < 4 AND coalesce({k}_end, 9) <> -1)'


_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{list(v)}::DOUBLE[]" if isinstance(v, tuple) else f"{v}::DOUBLE"
_PRESETS = ", ".join(f"('{k}', {_sql(v.get('dispersal'))}, {_sql(v.get('shares'))}, {_sql(v.get('centre_walk_m'))}, {_sql(v.get('centre_mode'))})" for k, v in params.PRESETS.items())
_SELECTORS = ", ".join(f"({i}, '{d}', '{q}')" for i, (d, q) in enumerate((d, q) for d in tags.ORDER for q in tags.dataset_selectors(d)))
_CATALOGUE = ", ".join(f"({i}, '{d}', '{tags.CATALOGUE[d][0]}', '{tags.CATALOGUE[d][1]}')" for i, d in enumerate(tags.ORDER))
_KINDS = ", ".join(
    f"({k}, '{d}', '{kind}')"
    for k, found in enumerate(
        ("point stops, line streets", "line streets, line unbuildable", "line streets", "", "line railways, line unbuildable", "point stations", "point stops", "point stations", "line unbuildable", "polygon unbuildable",
         "polygon unbuildable", "polygon green", "", "polygon unbuildable", "polygon industrial, polygon unbuildable", "polygon green", "", "polygon built, polygon centres", "polygon green", "polygon green", "polygon unbuildable", "polygon unbuildable", "")
    )
    for kind, d in (x.split() for x in found.split(", ") if x)
)
_PCT, _NUM = (lambda v: f"coalesce(CAST(CAST(round_even(100 * ({v}), 0) AS BIGINT) AS VARCHAR) || '%', '-')"), (lambda v: f"coalesce(format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT)), '-')")
_OPTION_ROWS = [
    ("population accommodated", _NUM("a * 0.5::DOUBLE")), ("share of target", _PCT("a * 0.5::DOUBLE / 1000")), ("built cells (incl. existing)", _NUM("n::DOUBLE")), ("mixed-use centre areas", _NUM("d::DOUBLE")),
    ("served coverage (centre AND green)", _PCT("a / (a + b)")), ("centre coverage", _PCT("a / (n * 97)")), ("green coverage", _PCT("b / (n * 89)")), ("unserved homes", _PCT("1 - a / (a + b)")), ("avg walk to a centre (m)", _NUM("a / n")),
    ("avg walk to green (m)", _NUM("CASE WHEN k <> 2 THEN b / n END")), ("mean walk, served homes: centre (m)", _NUM("CASE WHEN k <> 1 THEN a / 7 END")), ("mean walk, served homes: green (m)", _NUM("b::DOUBLE")),
    ("m2 mixed-use centre / person", _NUM("b * 10 / a")), ("m2 walkable green / person", _NUM("a * 3.0::DOUBLE")), ("homes served per centre area", _NUM("d::DOUBLE")), ("compactness", _PCT("d / (n * 5)")),
    ("transit coverage (reported only)", _PCT("b / (a + b)")), ("avg walk to a stop (m)", "'-'"),
]
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


_STEEP = """h AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c, CAST(o_custkey % 61 AS DOUBLE) AS h FROM orders), d AS (SELECT r, c, h, lag(h) OVER x AS a, lead(h) OVER x AS b, lag(h) OVER y AS e, lead(h) OVER y AS f FROM h WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)), s AS (SELECT r, c, degrees(atan(sqrt((CASE WHEN a IS NULL THEN (b - h) / 30 WHEN b IS NULL THEN (h - a) / 30 ELSE (b - a) / 60 END) ** 2 + (CASE WHEN e IS NULL THEN (f - h) / 30 WHEN f IS NULL THEN (h - e) / 30 ELSE (f - e) / 60 END) ** 2))) AS deg FROM d),
  steep AS (SELECT r, c, band FROM s, (VALUES (15), (20), (25), (30)) b(band) WHERE deg > band)"""
#: What a triangle under a falling line shares with a square: a rectangle up to where the line enters the square, then a trapezoid.
_CLIPS = f"""{_ROWS}, p AS (SELECT p_partkey AS fid, p_partkey * 37 % 9000 AS x, p_partkey * 53 % (n * 100 - 600) AS y, p_size * 20 AS s FROM part, nr),
  q AS (SELECT s_suppkey AS other, s_suppkey % 9 * 1000 + 100 AS qx, s_suppkey // 9 * 1000 + 50 AS qy, s_suppkey % 7 * 50 + 500 AS qs FROM supplier),
  o AS (SELECT fid, other, greatest(x, qx) AS xl, least(x + s, qx + qs) AS xr, greatest(y, qy) AS low, qy + qs AS high, x + y + s AS d FROM p JOIN q ON x < qx + qs AND qx < x + s AND y < qy + qs AND qy < y + s),
  e AS (SELECT *, greatest(xl, d - high) AS a, least(xr, d - low) AS b FROM o WHERE xl < xr AND low < high),
  clips AS (SELECT fid, other, greatest(0, least(xr, d - high) - xl) * (high - low) + CASE WHEN b > a THEN ((d - a - low) + (d - b - low)) / 2.0 * (b - a) ELSE 0 END AS area FROM e)"""


def _slabs(name: str, x: str, y: str) -> str:
    """CTEs: for each slab between neighbouring ends along ``x``, the land of the rectangles and its width times the number of stretches along ``y``."""
    return f"""{name}s AS (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM (SELECT {x}0 AS v FROM boxes UNION SELECT {x}1 FROM boxes)),
  {name}m AS (SELECT v, w, {y}0 AS lo, {y}1 AS hi, max({y}1) OVER (PARTITION BY v ORDER BY {y}0, {y}1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {name}s JOIN boxes ON {x}0 <= v AND {x}1 >= w),
  {name} AS (SELECT sum((w - v) * greatest(0, hi - greatest(lo, coalesce(seen, lo)))) AS land, sum((w - v) * CASE WHEN seen IS NULL OR lo > seen THEN 1 ELSE 0 END) AS runs FROM {name}m)"""


#: Sides without a neighbour; rings by the count of cells, of pairs side by side and of blocks of four: what is left of one is holes.
_OUTLINES = """nb AS (SELECT l.band, l.root, count(e.r) AS e, count(f.r) AS f, count(g.r) AS g, count(*) AS n FROM l
    LEFT JOIN l e ON e.band = l.band AND e.r = l.r AND e.c = l.c + 1 LEFT JOIN l f ON f.band = l.band AND f.r = l.r + 1 AND f.c = l.c
    LEFT JOIN l g ON g.band = l.band AND g.r = l.r + 1 AND g.c = l.c + 1 AND e.r IS NOT NULL AND f.r IS NOT NULL GROUP BY ALL),
  outlines AS (SELECT band, CAST(root // 4294967296 AS INTEGER) AS root_r, CAST(root % 4294967296 AS INTEGER) AS root_c, n AS cells, 4 * n - 2 * (e + f) AS sides, 2 - (n - e - f + g) AS rings FROM nb)"""
ORACLE_SQL: dict[str, str] = {
    "grid_align": f"WITH {_BOXES} SELECT CAST((ceil(max(y1) / 100) - floor(min(y0) / 100)) AS BIGINT) AS rows, CAST((ceil(max(x1) / 100) - floor(min(x0) / 100)) AS BIGINT) AS cols, CAST(floor(min(x0) / 100) * 100 AS DOUBLE) AS x_min, CAST(ceil(max(y1) / 100) * 100 AS DOUBLE) AS y_max FROM boxes",
    "grid_dense": f"WITH {_ROWS} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, (c + 0.5) * 100.0::DOUBLE AS x, n * 100.0::DOUBLE - (r + 0.5) * 100.0::DOUBLE AS y FROM nr, unnest(range(nr.n)) a(r), unnest(range(100)) b(c)",
    "burn_boxes": f"WITH {_BOXES} SELECT pid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM boxes, nr, unnest(range(-1, 200)) b(c), unnest(range(CAST((n * 100 - y1) // 100 AS BIGINT) - 1, CAST((n * 100 - y0) // 100 AS BIGINT) + 2)) a(r) WHERE (c + 0.5) * 100 >= x0 AND (c + 0.5) * 100 < x1 AND n * 100 - (r + 0.5) * 100 >= y0 AND n * 100 - (r + 0.5) * 100 < y1",
    "burn_all_touched": f"WITH {_BOXES} SELECT pid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM boxes, nr, unnest(range(-1, 200)) b(c), unnest(range(CAST((n * 100 - y1) // 100 AS BIGINT) - 1, CAST((n * 100 - y0) // 100 AS BIGINT) + 2)) a(r) WHERE c BETWEEN floor(x0 / 100) AND floor(x1 / 100) AND r BETWEEN floor((n * 100 - y1) / 100) AND floor((n * 100 - y0) / 100)",
    "layer_precedence": "SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN -1 WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_custkey % 3 = 0 THEN 1 WHEN o_custkey % 10 < 8 THEN 0 ELSE -1 END AS INTEGER) AS state, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_custkey % 3 = 0 THEN 1 ELSE -1 END AS INTEGER) AS origin FROM orders",
    "layer_precedence_alt": "SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c, CAST(CASE WHEN o_custkey % 10 >= 8 THEN -1 WHEN o_custkey % 3 = 0 THEN 1 WHEN o_orderpriority = '5-LOW' THEN -1 ELSE 0 END AS INTEGER) AS state, CAST(CASE WHEN o_custkey % 10 >= 8 THEN -1 WHEN o_custkey % 3 = 0 THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE -1 END AS INTEGER) AS origin FROM orders",
    "points_to_cells": f"WITH {_ROWS}, p AS (SELECT event_id AS point_id, event_id * 137 % 12000 - 900 AS x, user_id * 211 % (n * 100 + 500) AS y, n FROM events, nr), q AS (SELECT point_id, n, CAST(floor((n * 100 - y) / 100) AS INTEGER) AS r, CAST(floor(x / 100) AS INTEGER) AS c FROM p) SELECT point_id, r, c FROM q WHERE r >= 0 AND r < n AND c >= 0 AND c < 100",
    "seed_snap": f"WITH {_CELLS}, {_SEEDS}, f AS (SELECT s.ord, greatest(abs(g.r - s.r), abs(g.c - s.c)) AS ring, (g.r - s.r) ** 2 + (g.c - s.c) ** 2 AS d2, g.r, g.c FROM seeds s JOIN grid g ON g.state <> -1 AND g.r BETWEEN s.r - 3 AND s.r + 3 AND g.c BETWEEN s.c - 3 AND s.c + 3), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ord ORDER BY ring, d2, r, c) = 1) SELECT ord, b.r, b.c, CASE WHEN b.r IS NULL THEN 'dropped' WHEN row_number() OVER (PARTITION BY b.r, b.c ORDER BY ord) > 1 THEN 'duplicate' WHEN ring = 0 THEN 'kept' ELSE 'snapped' END AS status FROM seeds LEFT JOIN b USING (ord)",
    "nearest_built": f"WITH {_CELLS}, {_SEEDS}, f AS (SELECT s.ord, greatest(abs(g.r - s.r), abs(g.c - s.c)) AS ring, (g.r - s.r) ** 2 + (g.c - s.c) ** 2 AS d2, g.r, g.c FROM seeds s JOIN grid g ON g.state = 1 AND g.r BETWEEN s.r - 8 AND s.r + 8 AND g.c BETWEEN s.c - 8 AND s.c + 8) SELECT ord, r, c FROM f QUALIFY row_number() OVER (PARTITION BY ord ORDER BY ring, d2, r, c) = 1",
    "slope_bands": f"WITH {_STEEP}, t AS (SELECT r, c, band, c - row_number() OVER (PARTITION BY r, band ORDER BY c) AS i FROM steep) SELECT r, band, min(c) AS c_from, max(c) AS c_to FROM t GROUP BY r, band, i",
    "valid_rings": "WITH p AS (SELECT p_partkey AS fid, p_size * 20 AS s FROM part) SELECT fid, CAST(2 AS BIGINT) AS rings, CAST(s * s * CASE fid % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 0.75 END AS DOUBLE) AS area FROM p",
    "clip_polygons": f"WITH {_CLIPS} SELECT fid, other, CAST(area AS DOUBLE) AS area FROM clips WHERE area > 0",
    "cut_polygons": f"WITH {_CLIPS}, c AS (SELECT fid, sum(area) AS gone FROM clips GROUP BY fid) SELECT fid, CAST(s * s / 2.0 - coalesce(gone, 0) AS DOUBLE) AS area FROM p LEFT JOIN c USING (fid) WHERE s * s / 2.0 > coalesce(gone, 0)",
    "layer_union": f"WITH {_BOXES}, {_slabs('up', 'x', 'y')}, {_slabs('along', 'y', 'x')} SELECT CAST(up.land AS DOUBLE) AS area, CAST(2 * (up.runs + along.runs) AS DOUBLE) AS outline FROM up, along",
    "built_outlines": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, m AS (SELECT 1 AS band, r, c FROM grid WHERE state = 1), {_labels('l', 'm', False, 'band')}, {_OUTLINES} SELECT * EXCLUDE (band) FROM outlines",
    "slope_band_polygons": f"WITH RECURSIVE {_OFFSETS}, {_STEEP}, m AS (SELECT band, r, c FROM steep), {_labels('l', 'm', False, 'band')}, {_OUTLINES} SELECT * FROM outlines",
    "nbr_counts": f"WITH {_OFFSETS}, {_CELLS}, n AS (SELECT g.r, g.c, x.s FROM grid g, offs x JOIN grid m ON m.r = g.r + x.dr AND m.c = g.c + x.dc WHERE m.state = 1) SELECT g.r, g.c, CAST(coalesce(sum(n.s), 0) AS BIGINT) AS rook_n, count(n.s) AS queen_n FROM grid g LEFT JOIN n ON n.r = g.r AND n.c = g.c GROUP BY g.r, g.c",
    "ring_runs": f"WITH o(i, dr, dc) AS (VALUES (0,1,-1),(1,1,0),(2,1,1),(3,0,1),(4,-1,1),(5,-1,0),(6,-1,-1),(7,0,-1)), {_CELLS}, t AS (SELECT g.r, g.c, string_agg(CASE WHEN m.state > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS f FROM grid g JOIN o ON true JOIN grid m ON m.r = g.r + o.dr AND m.c = g.c + o.dc GROUP BY g.r, g.c), u AS (SELECT r, c, f, list_filter(string_split(f, '0'), lambda x: x <> '') AS p, length(f) = 8 AND f LIKE '1%1' AND f LIKE '%0%' AS w FROM t) SELECT r, c, CAST(length(replace(f, '0', '')) AS INTEGER) AS total, CAST(greatest(coalesce(list_max(list_transform(p, lambda x: length(x))), 0), CASE WHEN w THEN length(p[1]) + length(p[-1]) ELSE 0 END) AS INTEGER) AS longest, CAST(len(p) - CASE WHEN w THEN 1 ELSE 0 END AS INTEGER) AS runs FROM u",
    "green_spans": f'WITH {_GREEN_SPANS} SELECT r, c, "left", "right", up, down, left_end, right_end, up_end, down_end FROM spans WHERE state = 0',
    "span_admissible": f"WITH {_GREEN_SPANS} SELECT r, c, NOT ({' OR '.join(map(_bad, ('left', 'right', 'up', 'down')))}) AS ok FROM spans",
    "box_sum": f"WITH {_CELLS} SELECT a.r, a.c, CAST(sum((b.state = 1)::INT) AS BIGINT) AS s FROM grid a JOIN grid b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY a.r, a.c",
    "disk_cover": f"WITH {_CELLS}, {_SEEDS} SELECT g.r, g.c, count(*) AS n FROM seeds s JOIN grid g ON g.r BETWEEN s.r - 6 AND s.r + 6 AND g.c BETWEEN s.c - 6 AND s.c + 6 AND (g.r - s.r) ** 2 + (g.c - s.c) ** 2 <= 36 GROUP BY g.r, g.c",
    "components_queen": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, m AS (SELECT r, c FROM grid WHERE state = 1), {_labels('l', 'm', True)} SELECT r, c, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM l",
    "components_rook": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, m AS (SELECT r, c FROM grid WHERE state = 0), {_labels('l', 'm', False)} SELECT r, c, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM l",
    "large_components": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, m AS (SELECT r, c FROM grid WHERE state = 0), {_labels('l', 'm', False)} SELECT r, c FROM l WHERE root IN (SELECT root FROM l GROUP BY root HAVING count(*) >= 16)",
    "component_sizes": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, m AS (SELECT r, c FROM grid WHERE state = 1), {_labels('l', 'm', True)} SELECT CAST(row_number() OVER (ORDER BY root) AS INTEGER) AS label, count(*) AS cells, min(r) AS r_min, min(c) AS c_min FROM l GROUP BY root",
    "walk_open": f"WITH {_CELLS}, {_SEEDS}, n AS (SELECT g.r, g.c, abs(abs(g.r - s.r) - abs(g.c - s.c)) AS o, least(abs(g.r - s.r), abs(g.c - s.c)) AS d FROM seeds s JOIN grid g ON g.r BETWEEN s.r - 8 AND s.r + 8 AND g.c BETWEEN s.c - 8 AND s.c + 8) SELECT r, c, arg_min(o, o + d * sqrt(2.0)) AS n_orth, arg_min(d, o + d * sqrt(2.0)) AS n_diag, round(100.0::DOUBLE * min(o + d * sqrt(2.0)), 6) AS dist FROM n WHERE o + d * sqrt(2.0) <= 8 + 1e-9 GROUP BY r, c",
    "walk_blocked": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, {_SEEDS}, t AS (SELECT r, c, (r, c) IN (SELECT (r, c) FROM seeds) AS target, state <> -1 AS open FROM grid), {_walk('w', 't', 8)} SELECT r, c, o AS n_orth, d AS n_diag, round(100.0::DOUBLE * (o + d * sqrt(2.0)), 6) AS dist FROM w WHERE o < 1000000",
    "reach_mask": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, {_SEEDS}, s AS (SELECT DISTINCT seeds.r, seeds.c FROM seeds JOIN grid USING (r, c)), t AS (SELECT CAST(s.r AS BIGINT) * 1000 + s.c AS src, g.r, g.c, s.r = g.r AND s.c = g.c AS target, g.state = 0 AS open FROM s JOIN grid g ON g.r BETWEEN s.r - 4 AND s.r + 4 AND g.c BETWEEN s.c - 4 AND s.c + 4), {_walk('w', 't', 4, 'src')}, h AS (SELECT DISTINCT w.src, g.r, g.c FROM w, (SELECT dr, dc, s, g FROM offs UNION ALL SELECT 0, 0, 0, 0) x JOIN grid g ON g.r = w.r + x.dr AND g.c = w.c + x.dc WHERE w.o < 1000000 AND g.state >= 0 AND w.o + x.s + (w.d + x.g) * sqrt(2.0) <= 4 + 1e-9) SELECT CAST(src // 1000 AS INTEGER) AS sr, CAST(src % 1000 AS INTEGER) AS sc, r, c FROM h",
    "green_access": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, p AS (SELECT g.r, g.c, g.state, CASE WHEN g.state = -1 THEN -1 WHEN g.state > 0 THEN 1 WHEN EXISTS (SELECT 1 FROM grid m WHERE m.state > 0 AND abs(m.r - g.r) + abs(m.c - g.c) = 1) THEN 2 ELSE 0 END AS itx FROM grid g), t AS (SELECT CAST(s.r AS BIGINT) * 1000 + s.c AS src, g.r, g.c, s.r = g.r AND s.c = g.c AS target, g.itx >= 0 AS open FROM p s JOIN p g ON s.itx = 2 AND g.r BETWEEN s.r - 3 AND s.r + 3 AND g.c BETWEEN s.c - 3 AND s.c + 3), {_walk('w', 't', 3, 'src')} SELECT p.r, p.c, p.itx, coalesce(n, 0) AS acc FROM p LEFT JOIN (SELECT r, c, count(*) AS n FROM w WHERE o < 1000000 GROUP BY r, c) a ON a.r = p.r AND a.c = p.c",
    "centre_access": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, {_SEEDS}, s AS (SELECT DISTINCT seeds.r, seeds.c FROM seeds JOIN grid USING (r, c) WHERE state >= 0), t AS (SELECT CAST(s.r AS BIGINT) * 1000 + s.c AS src, g.r, g.c, s.r = g.r AND s.c = g.c AS target, g.state >= 0 AS open FROM s JOIN grid g ON g.r BETWEEN s.r - 8 AND s.r + 8 AND g.c BETWEEN s.c - 8 AND s.c + 8), {_walk('w', 't', 8, 'src')} SELECT r, c, count(*) AS acc FROM w WHERE o < 1000000 GROUP BY r, c",
    "interior_point": f"WITH RECURSIVE {_OFFSETS}, {_CELLS}, m AS (SELECT r, c FROM grid WHERE state = 1), {_labels('l', 'm', True)}, k AS (SELECT unnest(range(1, 13)) AS k), b AS (SELECT a.root, a.r, a.c, k FROM l a, k JOIN l b ON b.root = a.root AND b.r BETWEEN a.r - k + 1 AND a.r + k - 1 AND b.c BETWEEN a.c - k + 1 AND a.c + k - 1 GROUP BY ALL HAVING count(*) = (2 * k - 1) ** 2), d AS (SELECT root, r, c, max(k) AS depth FROM b GROUP BY root, r, c) SELECT CAST(root // 4294967296 AS INTEGER) AS root_r, CAST(root % 4294967296 AS INTEGER) AS root_c, r, c FROM d QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth DESC, r, c) = 1",
    "classify_cells": f"WITH {_CELLS}, {_SEEDS}, first AS (SELECT r, c, min(ord) AS ord FROM seeds GROUP BY r, c), b AS (SELECT g.r, g.c, ord IS NOT NULL AND state <> -1 AS centre, ord % 2 = 0 AS old, state, origin, density FROM grid g LEFT JOIN first USING (r, c)), k AS (SELECT r, c, CAST(CASE WHEN centre AND old THEN 9 WHEN origin = 1 THEN 7 WHEN origin = 0 THEN 8 WHEN centre THEN CASE density WHEN 10 THEN 4 WHEN 30 THEN 5 WHEN 60 THEN 6 ELSE 255 END WHEN state = 0 THEN 0 WHEN state = 1 THEN CASE density WHEN 10 THEN 1 WHEN 30 THEN 2 WHEN 60 THEN 3 ELSE 255 END ELSE 255 END AS INTEGER) AS cls FROM b) SELECT r, c, cls, CASE cls WHEN 0 THEN 'nature' WHEN 1 THEN 'new low' WHEN 2 THEN 'new medium' WHEN 3 THEN 'new high' WHEN 4 THEN 'centre low' WHEN 5 THEN 'centre medium' WHEN 6 THEN 'centre high' WHEN 7 THEN 'existing built' WHEN 8 THEN 'fixed green' WHEN 9 THEN 'existing centre' ELSE 'no data' END AS label FROM k",
    "state_to_plan": f"WITH RECURSIVE {_PLAN} SELECT r, c, CAST(plan AS INTEGER) AS plan FROM plan",
    "class_counts": f"WITH {_MEMBERS} SELECT r, c, count(*) FILTER (state = 1) AS n_built, count(*) FILTER (state = 0) AS n_green, count(*) FILTER (state = 2) AS n_centre FROM members GROUP BY r, c",
    "probability": f"WITH {_MEMBERS} SELECT r, c, round(avg((state > 0)::INT), 6) AS p FROM members GROUP BY r, c",
    "likelihood": f"WITH {_MEMBERS} SELECT r, c, round(avg((state = 1)::INT), 6) AS p_built, round(avg((state = 0)::INT), 6) AS p_green FROM members GROUP BY r, c",
    "tier_draw": f"WITH {_CELLS}, a AS (SELECT r, c, (7 * 1103515 + 3 * 12345 + r::BIGINT * 7919 + c::BIGINT * 104729 + 31337) % 2147483647 AS x FROM grid WHERE state = 1), b AS (SELECT r, c, (x * 48271 + r + 11) % 2147483647 AS x FROM a), d AS (SELECT r, c, (x * 69621 + c + 11) % 2147483647 AS x FROM b), e AS (SELECT r, c, (x * 16807 + 1 + 11) % 2147483647 / 2147483647.0::DOUBLE AS u FROM d) SELECT r, c, CAST(CASE WHEN u < 0.4 THEN 6000 WHEN u < 0.4::DOUBLE + 0.4::DOUBLE THEN 3000 ELSE 1000 END AS DOUBLE) AS tier FROM e",
    "prune": f"WITH RECURSIVE {_PLAN}, u AS (SELECT r, c, plan FROM plan WHERE plan >= 2), {_labels('l', 'u', True)}, bad AS (SELECT root FROM l JOIN plan USING (r, c) GROUP BY root HAVING count(*) < 12 AND max(plan) < 4) SELECT p.r, p.c, CAST(CASE WHEN l.root IN (SELECT root FROM bad) THEN 1 ELSE plan END AS INTEGER) AS plan FROM plan p LEFT JOIN l USING (r, c)",
    "absorb": f"WITH RECURSIVE {_PLAN}, u AS (SELECT r, c FROM plan WHERE plan >= 2), {_labels('l', 'u', True)}, v AS (SELECT r, c FROM plan WHERE plan IN (2, 3)), {_labels('k', 'v', True)}, old AS (SELECT DISTINCT root FROM l JOIN plan USING (r, c) WHERE plan IN (4, 5)), small AS (SELECT root FROM k GROUP BY root HAVING count(*) < 6) SELECT p.r, p.c, CAST(CASE WHEN k.root IN (SELECT root FROM small) AND l.root IN (SELECT root FROM old) THEN 4 ELSE plan END AS INTEGER) AS plan FROM plan p LEFT JOIN l USING (r, c) LEFT JOIN k USING (r, c)",
    "coverage": f"WITH RECURSIVE {_FIELDS} SELECT {_COVER} FROM dist WHERE plan >= 2",
    "compactness": f"WITH RECURSIVE {_PLAN}, b AS (SELECT r, c FROM plan WHERE plan >= 2), n AS (SELECT count(*) AS n FROM b), s AS (SELECT count(*) AS s FROM b JOIN b d ON abs(b.r - d.r) + abs(b.c - d.c) = 1 AND d.r BETWEEN b.r - 1 AND b.r + 1) SELECT n AS built_cells, round(s / (4.0::DOUBLE * n), 6) AS compactness FROM n, s",
    "provision": f"WITH RECURSIVE {_PLAN}, k AS (SELECT count(*) FILTER (plan IN (2, 3)) * 28.5::DOUBLE AS people, count(*) FILTER (plan = 3) AS a, count(*) FILTER (plan = 1 AND origin <> 0) AS b FROM plan) SELECT round(people, 4) AS population, round(a * 10000 / people, 4) AS centre_m2_per_person, round(b * 10000 / people, 4) AS green_m2_per_person FROM k",
    "efficiency": f"WITH RECURSIVE {_FIELDS} SELECT round(count(*) FILTER (plan >= 2 AND cd <= 800) / count(*) FILTER (plan IN (3, 5))::DOUBLE, 4) AS centre_efficiency, round(count(*) FILTER (plan >= 2 AND gd <= 400) / count(*) FILTER (park)::DOUBLE, 4) AS green_efficiency FROM dist",
    "transit": f"WITH RECURSIVE {_PLAN}, st AS (SELECT DISTINCT CAST(event_id * 31 % n AS INTEGER) AS r, CAST((user_id * 17 + event_id) % 100 AS INTEGER) AS c FROM events, nr WHERE event_type IN ('view', 'signup')), t AS (SELECT p.r, p.c, st.r IS NOT NULL AS target, plan <> 0 AS open FROM plan p LEFT JOIN st USING (r, c)), {_walk('w', 't', 8)}, d AS (SELECT CASE WHEN o < 1000000 THEN 100.0::DOUBLE * (o + d * sqrt(2.0)) END AS x FROM w JOIN plan USING (r, c) WHERE plan >= 2) SELECT round(avg(coalesce(x <= 600, false)::INT), 4) AS transit_coverage, round(avg(CASE WHEN x <= 600 THEN x END), 4) AS transit_walk_mean FROM d",
    "centre_audit": f"WITH RECURSIVE {_AUDIT} SELECT row, col, cells, served, mean_dist, old FROM audit",
    "audit_summary": f"WITH RECURSIVE {_AUDIT} SELECT count(*) AS n, count(*) FILTER (NOT old) AS n_new, min(served) AS served_min, CAST(floor(median(served)) AS BIGINT) AS served_median, max(served) AS served_max, min(served) FILTER (NOT old) AS new_min, CAST(floor(median(served) FILTER (NOT old)) AS BIGINT) AS new_median, max(served) FILTER (NOT old) AS new_max, round(median(mean_dist), 4) AS walk_median FROM audit",
    "weakest5": f"WITH RECURSIVE {_AUDIT} SELECT row, col, cells, served, mean_dist FROM audit WHERE NOT old ORDER BY served, root LIMIT 5",
    "arrange_density": f"WITH RECURSIVE {_ARRANGED} SELECT r, c, density FROM arranged",
    "tiered_plan": f"WITH RECURSIVE {_ARRANGED} SELECT r, c, CAST(code AS INTEGER) AS code FROM coded",
    "tier_breakdown": f"WITH RECURSIVE {_ARRANGED}, k AS (SELECT CASE WHEN code IN (6, 9) THEN 'low' WHEN code IN (7, 10) THEN 'medium' ELSE 'high' END AS tier, code, CASE WHEN code IN (6, 9) THEN 10 WHEN code IN (7, 10) THEN 30 ELSE 60 END AS e FROM coded WHERE code >= 6) SELECT coalesce(tier, 'total') AS tier, count(*) FILTER (code <= 8) AS built_cells, count(*) FILTER (code >= 9) AS centre_cells, CAST(sum(e) AS DOUBLE) AS population FROM k GROUP BY ROLLUP (tier)",
    "select_member": f"WITH RECURSIVE {_MEMBER_SCORES} SELECT member, access_cost FROM scores ORDER BY access_cost NULLS LAST, member LIMIT 1",
    "options_pivot": f"WITH RECURSIVE {_SOME_MEMBER_SCORES}, u AS (SELECT member, metric, value FROM (SELECT member, centre_coverage, green_coverage, served_coverage, access_cost FROM scores) UNPIVOT (value FOR metric IN (centre_coverage, green_coverage, served_coverage, access_cost))) SELECT metric, max(value) FILTER (member = 1) AS m1, max(value) FILTER (member = 3) AS m3, max(value) FILTER (member = 5) AS m5 FROM u GROUP BY metric",
    "tiers_rollup": f"WITH {_CELLS} SELECT coalesce(t, 'total') AS tier, count(*) AS cells, sum(density) AS population FROM (SELECT density, CASE density WHEN 60 THEN 'high' WHEN 30 THEN 'medium' ELSE 'low' END AS t FROM grid WHERE density > 0) GROUP BY ROLLUP (t)",
    "fixed_table": "WITH t AS (SELECT n_name AS a, r_name AS b, CAST(n_nationkey AS VARCHAR) AS d FROM nation JOIN region ON n_regionkey = r_regionkey), w AS (SELECT CAST(greatest(max(length(a)), 4) AS INTEGER) AS wa, CAST(greatest(max(length(b)), 6) AS INTEGER) AS wb, CAST(greatest(max(length(d)), 1) AS INTEGER) AS wd FROM t) SELECT CAST(0 AS INTEGER) AS line_no, rtrim(rpad('name', wa, ' ') || '  ' || lpad('region', wb, ' ') || '  ' || lpad('n', wd, ' ')) AS line FROM w UNION ALL SELECT 1, repeat('-', wa + wb + wd + 4) FROM w UNION ALL SELECT CAST(row_number() OVER (ORDER BY a) + 1 AS INTEGER), rtrim(rpad(a, wa, ' ') || '  ' || lpad(b, wb, ' ') || '  ' || lpad(d, wd, ' ')) FROM t, w",
    "params_load": """WITH n AS (SELECT n_nationkey AS k, n_name FROM nation), f AS (SELECT k, unnest([{'key': 'name', 'value': n_name, 'status': 'ok'},
        {'key': 'grid_size_m', 'value': CAST(CAST(k * 5 + 25 AS DOUBLE) AS VARCHAR), 'status': 'ok'}, {'key': 'build_prob', 'value': CASE WHEN k % 4 <> 0 THEN '0.25' END, 'status': CASE WHEN k % 4 = 0 THEN 'malformed' ELSE 'ok' END},
        {'key': 'max_iterations', 'value': CAST(k + 50 AS VARCHAR), 'status': 'ok'}, {'key': 'ensemble', 'value': CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, 'status': 'ok'}, {'key': 'unknown_' || k % 3, 'value': NULL, 'status': 'ignored'}]) AS x FROM n WHERE k % 6 <> 5 AND k % 7 <> 6)
        SELECT k AS doc, x.key AS key, x.value AS value, x.status AS status FROM f UNION ALL SELECT k, 'schema', NULL, 'error' FROM n WHERE k % 6 = 5 OR k % 7 = 6""",
    "params_diff": "WITH o AS (SELECT r_name AS key, CAST(r_regionkey * 10 AS VARCHAR) AS v FROM region), n AS (SELECT CASE WHEN n_nationkey < 5 THEN ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][n_nationkey + 1] ELSE n_name END AS key, CAST(n_nationkey * CASE WHEN n_nationkey % 2 = 0 THEN 10 ELSE 11 END AS VARCHAR) AS v FROM nation) SELECT coalesce(o.key, n.key) AS key, o.v AS old, n.v AS new FROM o FULL JOIN n ON o.key = n.key WHERE o.v IS DISTINCT FROM n.v",
    "preset_expand": f"""WITH s AS (SELECT c_name AS scenario, CASE c_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'moderate' ELSE 'aggressive' END AS d, CAST(c_custkey % 5 * 100 + 600 AS DOUBLE) AS w, c_custkey % 40 * 700 + 3000 AS span FROM customer),
      p(preset, od, os, ow, om) AS (VALUES {_PRESETS}),
      e AS (SELECT scenario, CASE WHEN preset = 'compact' AND d = 'off' THEN 'moderate' ELSE preset END AS preset, CASE WHEN preset = 'compact' AND d = 'off' THEN 'moderate' ELSE coalesce(od, d) END AS dispersal,
        coalesce(os[1], 0.25) AS p_high, coalesce(os[2], 0.25) AS p_medium, coalesce(os[3], 0.5) AS p_low, coalesce(ow, w) AS centre_walk_m, coalesce(om, '{params.CENTRE_MODE}') AS centre_mode, CAST(greatest(25, ceil(span / 150.0::DOUBLE / 5) * 5) AS DOUBLE) AS block_m FROM s, p)
      SELECT *, CAST(CASE dispersal WHEN 'off' THEN 0 WHEN 'moderate' THEN 0.0001 ELSE 0.04 END AS DOUBLE) AS p_isolated FROM e""",
    "snapshot_grid": f"""WITH {_BOXES}, grid AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c FROM orders),
      hit AS (SELECT r, c, bool_or(pid % 4 = 0) AS b, bool_or(pid % 4 = 1) AS g, bool_or(pid % 4 = 2) AS u, bool_or(pid % 4 = 3) AS m FROM grid, nr, boxes WHERE (c + 0.5) * 100 >= x0 AND (c + 0.5) * 100 < x1 AND n * 100 - (r + 0.5) * 100 >= y0 AND n * 100 - (r + 0.5) * 100 < y1 GROUP BY r, c)
      SELECT r, c, CAST(CASE WHEN b THEN 1 WHEN u THEN -1 ELSE 0 END AS INTEGER) AS state, CAST(CASE WHEN b THEN 1 WHEN g THEN 0 ELSE -1 END AS INTEGER) AS origin, coalesce(b AND m, false) AS seed FROM grid LEFT JOIN hit USING (r, c)""",
    "parameter_lines": """WITH p AS (SELECT p_partkey AS id, p_partkey % 4 * 25 + 25 AS b, p_size AS s, p_retailprice * 100 AS target, [0, 0.0001, 0.04, p_size / 1000.0::DOUBLE][CAST(p_partkey % 4 AS INTEGER) + 1]::DOUBLE AS iso FROM part),
      t AS (SELECT *, s * 2750.0::DOUBLE * (b * b) / 1e6::DOUBLE AS people FROM p)
      SELECT id, CAST(unnest(range(12)) AS INTEGER) AS line_no, unnest(['  Grid size             : ' || b || ' m', '  Max iterations        : ' || s * 10, '  Target population     : ' || format('{:,}', CAST(round_even(target, 0) AS BIGINT)),
        '  Build probability     : ' || regexp_replace(printf('%.6f', s / 100.0::DOUBLE), '\.?0+$', ''), '  Dispersed development : ' || CASE round(iso, 4) WHEN 0 THEN 'Off' WHEN 0.0001 THEN 'Moderate' WHEN 0.04 THEN 'Aggressive' ELSE regexp_replace(printf('%.6f', iso), '\.?0+$', '') END,
        '  Centre walk           : ' || CASE id % 3 WHEN 0 THEN 600 ELSE id % 3 * 400 END || ' m', '  Green walk            : ' || CASE id % 2 WHEN 0 THEN 600 ELSE 300 END || ' m', '  Min green span        : ' || s * 10 || ' m',
        '  Density               : high 6,000 (25%), med 3,000 (25%), low 1,000 (50%) /km²; mean 2,750', '  Min settlement        : ~' || format('{:,}', CAST(round_even(people, 0) AS BIGINT)) || ' people (' || s || ' cells)',
        '  Optimise centres      : ' || CASE id % 2 WHEN 0 THEN 'on' ELSE 'off' END, '  Ensemble              : ' || id % 5 * 10 || ' run(s)']) AS line FROM t""",
    "file_lines": """WITH f AS (SELECT l_orderkey AS run, l_linenumber AS ord, 'plan_' || l_partkey || '.tif' AS name, 'option ' || l_returnflag AS label FROM lineitem)
      SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY ord, name, label) - 1 AS INTEGER) AS line_no, '  ' || rpad(name, CAST(max(length(name)) OVER (PARTITION BY run) AS INTEGER), ' ') || '  ' || label AS line FROM f""",
    "least_settlements": """WITH m AS (SELECT p_partkey AS id, 0.25 * 6000::DOUBLE + 0.25 * 3000::DOUBLE + 0.5 * 1000::DOUBLE AS mean, CAST(p_size * 37 AS DOUBLE) AS people, CAST(p_partkey % 4 * 25 + 25 AS DOUBLE) AS b FROM part)
      SELECT id, round(mean, 6) AS mean_km2, greatest(1, CAST(round_even(people / (mean * b * b / 1e6::DOUBLE), 0) AS BIGINT)) AS least_cells FROM m""",
    "density_check": "WITH r AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 4 THEN 6000.0::DOUBLE END AS h, CAST(n_nationkey * 300 AS DOUBLE) AS m, CASE WHEN n_nationkey % 2 = 0 THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS pm FROM nation) SELECT id, CASE WHEN h IS NULL THEN 'not a number' WHEN NOT (h > m AND m > 1000) THEN 'densities must fall' WHEN abs(0.2::DOUBLE + pm + 0.5::DOUBLE - 1) > 1e-3 THEN 'shares must sum to 1' ELSE '' END AS message, CASE WHEN h IS NOT NULL THEN round(0.2::DOUBLE + pm + 0.5::DOUBLE, 6) END AS total, CASE WHEN h IS NOT NULL THEN round(0.2::DOUBLE * h + pm * m + 0.5::DOUBLE * 1000, 6) END AS mean FROM r",
    "frames": f"WITH {_MEMBERS} SELECT member AS step, make_date(member + 2025, 1, 1) AS valid_from, make_date(member + 2026, 1, 1) AS valid_to, CAST(CASE state WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 255 END AS INTEGER) AS cls, count(*) AS n FROM members GROUP BY ALL",
    "osm_hstore": r"""WITH e AS (SELECT event_id AS id, event_id AS n, event_type AS k, user_id % 5 AS u FROM events),
        own AS (SELECT id, 'highway' AS key, 'residential' AS value FROM e WHERE k = 'view' UNION ALL SELECT id, 'name', 'a, ' || n FROM e WHERE k = 'view' UNION ALL SELECT id, 'building', 'yes' FROM e WHERE k = 'click'
          UNION ALL SELECT id, 'landuse', CASE WHEN n % 2 = 0 THEN 'retail' ELSE 'industrial' END FROM e WHERE k = 'click' UNION ALL SELECT id, CASE WHEN n % 3 = 0 THEN 'railway' ELSE 'highway' END, CASE WHEN n % 3 = 0 THEN 'station' ELSE 'bus_stop' END FROM e WHERE k = 'signup'
          UNION ALL SELECT id, 'leisure', 'park' FROM e WHERE k = 'purchase' UNION ALL SELECT id, 'name', 'the "green" one' FROM e WHERE k = 'purchase' UNION ALL SELECT id, 'waterway', 'river' FROM e WHERE k = 'error' AND n % 2 = 0),
        nat AS (SELECT id, 'name' AS key, 'native ' || u AS value FROM e WHERE u > 0 UNION ALL SELECT id, 'highway', 'track' FROM e)
        SELECT * FROM own UNION ALL SELECT nat.* FROM nat ANTI JOIN own ON own.id = nat.id AND own.key = nat.key""",
    "osm_route": """WITH e AS (SELECT event_id AS n, event_type AS k FROM events), d AS (SELECT 'streets' AS dataset, 'residential' AS highway FROM e WHERE k = 'view'
        UNION ALL SELECT unnest(CASE WHEN n % 2 = 0 THEN ['built', 'centres'] ELSE ['industrial', 'unbuildable'] END), '-' FROM e WHERE k = 'click'
        UNION ALL SELECT CASE WHEN n % 3 = 0 THEN 'stations' ELSE 'stops' END, '-' FROM e WHERE k = 'signup' UNION ALL SELECT 'streets', 'bus_stop' FROM e WHERE k = 'signup' AND n % 3 <> 0
        UNION ALL SELECT 'green', '-' FROM e WHERE k = 'purchase') SELECT dataset, highway, count(*) AS n, CAST(0 AS BIGINT) AS barriers FROM d GROUP BY ALL""",
    "osm_route_kinds": f"WITH t(u, dataset, kind) AS (VALUES {_KINDS}) SELECT dataset, kind, count(*) AS n FROM events JOIN t ON user_id % 23 = u AND kind = CASE event_id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END GROUP BY ALL",
    "options_table": "WITH s AS (SELECT n_regionkey AS k, count(*) AS n, sum(c_custkey % 97)::DOUBLE AS a, sum(c_custkey % 89)::DOUBLE AS b, sum(c_custkey % 5)::DOUBLE AS d FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), m AS (SELECT r_name, s.* FROM region JOIN s ON r_regionkey = k), x AS ("
    + " UNION ALL ".join(f"SELECT {i} AS ord, '{label}' AS metric, r_name, {sql} AS v FROM m" for i, (label, sql) in enumerate(_OPTION_ROWS))
    + ") SELECT ord, metric, " + ", ".join(f"""max(CASE WHEN r_name = '{r}' THEN v END) AS "{r}\"""" for r in _REGIONS) + " FROM x GROUP BY ord, metric",
    "osm_query_text": f"""WITH s(o, dataset, q) AS (VALUES {_SELECTORS}), e AS (SELECT o, dataset, q FROM s UNION ALL SELECT min(o), 'all', q FROM s GROUP BY q),
      a AS (SELECT s_suppkey AS area, '(' || concat_ws(',', CAST(CAST(s_suppkey % 60 + 0.5 AS DOUBLE) AS VARCHAR), CAST(CAST(s_suppkey * 7 % 170 + 0.25 AS DOUBLE) AS VARCHAR), CAST(CAST(s_suppkey % 60 + 1.5 AS DOUBLE) AS VARCHAR), CAST(CAST(s_suppkey * 7 % 170 + 1.25 AS DOUBLE) AS VARCHAR)) || ');' AS box FROM supplier)
      SELECT area, dataset, '[out:xml][timeout:60];' || chr(10) || '(' || chr(10) || string_agg('  ' || q || box, chr(10) ORDER BY o) || chr(10) || ');' || chr(10) || '(._;>;);' || chr(10) || 'out body;' || chr(10) AS ql FROM e, a GROUP BY area, dataset""",
    "osm_way_coords": "WITH w AS (SELECT CAST(o_orderkey AS VARCHAR) AS way_id, o_orderkey AS k, (SELECT count(*) * 10 // 9 FROM events) AS n FROM orders), p AS (SELECT way_id, pos, id FROM w, LATERAL (VALUES (0, k % n), (1, (k * 3 + 1) % n), (2, (k * 7 + 2) % n), (3, CASE WHEN k % 2 = 0 THEN k % n ELSE (k + 5) % n END)) v(pos, id)), q AS (SELECT way_id, pos, user_id, event_id FROM p JOIN events ON event_id = id) SELECT way_id, count(*) AS n_pts, count(*) >= 4 AND arg_min(user_id, pos) = arg_max(user_id, pos) AND arg_min(event_id, pos) = arg_max(event_id, pos) AS closed FROM q GROUP BY way_id HAVING count(*) >= 2",
    "feature_measures": f"WITH {_BOXES} SELECT pid, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0) + 2 * (y1 - y0) AS outline, CAST(CASE WHEN y0 / 400 - 10 >= 0 THEN 32600 ELSE 32700 END + floor((x0 / 50 - 90 + 180) / 6) % 60 + 1 AS INTEGER) AS epsg FROM boxes",
    "clip_difference": "SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 10 < 8 AND o_custkey % 3 <> 0",
    "barrier_corridors": f"WITH {_CELLS}, {_ROWS}, l AS (SELECT p_partkey AS fid, p_partkey * 37 % 9000 AS x0, p_partkey * 53 % (n * 100) AS y0, 10.0::DOUBLE * p_size AS dx, 7.0::DOUBLE * p_size AS dy, n FROM part, nr), d AS (SELECT fid, r, c, x0, y0, dx, dy, (c + 0.5) * 100.0::DOUBLE AS px, n * 100.0::DOUBLE - (r + 0.5) * 100.0::DOUBLE AS py FROM l, grid), t AS (SELECT *, greatest(0, least(1, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy))) AS u FROM d) SELECT fid, r, c FROM t WHERE sqrt((px - x0 - u * dx) ** 2 + (py - y0 - u * dy) ** 2) <= 150",
    "existing_fabric": f"WITH {_CELLS}, {_SEEDS} SELECT r, c, CAST(CASE WHEN state = -1 THEN 0 WHEN (r, c) IN (SELECT (r, c) FROM seeds) THEN 5 WHEN origin = 0 THEN 1 WHEN origin = 1 THEN 4 ELSE 0 END AS INTEGER) AS plan FROM grid",
    "stage_codes": f"WITH {_CELLS} SELECT r, c, CAST(CASE WHEN origin = 1 THEN 7 WHEN origin = 0 THEN 8 WHEN state = -1 THEN 255 ELSE state END AS INTEGER) AS code FROM grid",
    "likelihood_shown": f"WITH {_MEMBERS}, p AS (SELECT r, c, round(avg((state = 1)::INT), 6) AS p FROM members GROUP BY r, c) SELECT r, c, round(0.3 + 0.7 * p, 6) AS opacity FROM p WHERE p > 0.04",
    "ensemble_presets": "SELECT n_nationkey AS id, CAST(CASE WHEN n_nationkey * 5 <= 30 THEN 10 WHEN n_nationkey * 5 <= 75 THEN 50 ELSE 100 END AS INTEGER) AS runs FROM nation",
    "dataset_catalogue": f"""WITH t(u, dataset, kind) AS (VALUES {_KINDS}), n AS (SELECT dataset, count(*) AS n FROM events JOIN t ON user_id % 23 = u AND kind = CASE event_id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END GROUP BY dataset),
      c(ord, dataset, label, kind) AS (VALUES {_CATALOGUE}) SELECT CAST(ord AS INTEGER) AS ord, dataset, label, kind, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (dataset)""",
    "elevation_heights": "WITH t AS (SELECT p_partkey % 7 - 3 AS y, p_partkey % 10 AS a, p_partkey % 9 AS b, CAST(max(p_partkey) AS DOUBLE) AS h FROM part GROUP BY ALL) SELECT CAST(o_orderkey // 100 AS INTEGER) AS r, CAST(o_orderkey % 100 AS INTEGER) AS c, coalesce(h, 0) AS h FROM orders LEFT JOIN t ON o_orderkey % 7 - 3 = y AND o_orderkey % 5 = 2 AND o_orderkey % 10 = a AND o_orderkey % 9 = b",
    "extent_guard": "SELECT n_nationkey AS id, n_nationkey * 3 + 1 AS rows, 40 - n_nationkey AS cols, CAST(50 AS DOUBLE) AS block_m, (n_nationkey * 3 + 1) * 50 > 800 AND (40 - n_nationkey) * 50 > 800 AS ok FROM nation",
    "inner_row_points": f"WITH {_BOXES}, b AS (SELECT pid, CAST(ceil((n * 100 - y1) / 100 - 0.5) AS INTEGER) AS r0, CAST(ceil((n * 100 - y0) / 100 - 0.5) AS INTEGER) - 1 AS r1, CAST(ceil(x0 / 100 - 0.5) AS INTEGER) AS c0, CAST(ceil(x1 / 100 - 0.5) AS INTEGER) - 1 AS c1, y0, y1, n FROM boxes, nr), k AS (SELECT pid, CAST(floor((n * 100 - y1) / 100 - 0.5) AS INTEGER) + 1 AS r0, CAST(floor((n * 100 - y0) / 100 - 0.5) AS INTEGER) AS r1, c0, c1 FROM b) SELECT pid, CAST(floor((r0 + r1) / 2.0) AS INTEGER) AS r, CAST(floor((c0 + c1) / 2.0) AS INTEGER) AS c FROM k WHERE r0 <= r1 AND c0 <= c1",
    "run_check": "SELECT n_nationkey AS id, CASE WHEN n_nationkey - 1 <= 0 THEN 'block' WHEN n_nationkey - 1 > 10 THEN 'walk' WHEN n_nationkey % 9 <= 0 THEN 'span or target' WHEN n_nationkey % 4 / 2.5 > 1 THEN 'probability' WHEN n_nationkey % 5 = 0 THEN 'shares' WHEN n_nationkey % 3 <> 2 THEN 'densities' ELSE '' END AS problem FROM nation",
    "growth_seed_union": f"WITH {_SEEDS}, st AS (SELECT DISTINCT CAST(event_id * 31 % n AS INTEGER) AS r, CAST((user_id * 17 + event_id) % 100 AS INTEGER) AS c FROM events, nr WHERE event_type = 'signup') SELECT ord, r, c FROM seeds UNION ALL SELECT CAST(r * 100 + c + (SELECT max(ord) FROM seeds) + 1 AS BIGINT), r, c FROM st WHERE (r, c) NOT IN (SELECT (r, c) FROM seeds)",
    "burn_rings": f"WITH {_ROWS}, d AS (SELECT p_partkey AS pid, p_partkey * 37 % 9000 + 0.37::DOUBLE AS x, p_partkey * 53 % (n * 100) + 0.19::DOUBLE AS y, p_size * 10 + 33 AS a, p_size * 7 + 21 AS b, n FROM part, nr), k AS (SELECT pid, x, y, a, b, n, unnest(range(-10, 120)) AS c FROM d), m AS (SELECT *, unnest(range(CAST(floor(n - (y + b) / 100) AS BIGINT) - 1, CAST(ceil(n - (y - b) / 100) AS BIGINT) + 1)) AS r FROM k WHERE abs((c + 0.5) * 100 - x) <= a) SELECT pid, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM m WHERE abs((c + 0.5) * 100 - x) * b + abs(n * 100 - (r + 0.5) * 100 - y) * a < a * b",
    "compose_check": "WITH s AS (SELECT count(*) FILTER (o_custkey % 3 = 0 AND o_orderpriority = '1-URGENT') * 10000.0::DOUBLE AS a FROM orders) SELECT 'raw' AS layer, a AS overlap_m2, a < 1 AS ok FROM s UNION ALL SELECT 'cut', 0.0::DOUBLE, true",
    "street_filter": "SELECT h AS highway, count(*) AS n FROM (SELECT ['residential', 'footway', 'primary', 'path', 'cycleway', 'tertiary', 'steps', 'track', 'service', 'living_street', NULL][user_id % 11 + 1] AS h FROM events) WHERE h IS NULL OR h IN ('residential', 'primary', 'tertiary', 'living_street') GROUP BY h",
    "input_slots": "WITH s(k, slot) AS (VALUES (0, 'built'), (1, 'green'), (2, 'centre_seeds'), (6, 'transit_stops'), (7, 'stations'), (8, 'unbuildable'), (9, 'extents')), f AS (SELECT slot, max(n_name) AS layer FROM nation JOIN s ON n_nationkey % 10 = k GROUP BY slot) SELECT slot, CASE slot WHEN 'green' THEN 'AMERICA' ELSE layer END AS layer FROM f UNION ALL SELECT 'terrain', 'ASIA'",
    "run_names": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 NOT IN (1, 2) THEN n_name END AS name FROM nation",
    "selection_progress": "SELECT n_nationkey AS id, round(40 + 59.0::DOUBLE * (n_nationkey % 4) / greatest(1, n_nationkey % 5), 6) AS percent FROM nation",
    "crs_guard": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 1 THEN 'not projected' WHEN n_nationkey <> 20 AND NOT (n_nationkey * 6 - 80 <= 9 AND n_nationkey * 6 - 74 >= -3) THEN 'outside' WHEN n_nationkey = 20 AND n_nationkey * 6 - 74 < -3 THEN 'outside' ELSE '' END AS problem FROM nation",
    "block_plan": f"WITH {_CELLS}, {_ROWS}, b AS (SELECT p_partkey AS k, p_partkey * 7 % n AS r0, p_partkey * 13 % 100 AS c0, p_size % 9 AS h, p_size % 6 AS w FROM part, nr), f AS (SELECT g.r, g.c, max(k) AS k FROM grid g JOIN b ON g.r >= r0 AND g.r < r0 + h AND g.c >= c0 AND g.c < c0 + w GROUP BY g.r, g.c) SELECT g.r, g.c, CAST(coalesce(k % 5 + 1, 0) AS INTEGER) AS plan FROM grid g LEFT JOIN f ON f.r = g.r AND f.c = g.c",
    "drawn_density": f"WITH {_CELLS} SELECT r, c, round(density * 100, 6) AS per_km2 FROM grid WHERE density > 0",
    "raw_pre_plan": f"WITH RECURSIVE {_MEMBER_SCORES}, best AS (SELECT member FROM scores ORDER BY access_cost NULLS LAST, member LIMIT 1) SELECT m.r, m.c, CAST(CASE WHEN state = 2 THEN 3 WHEN plan = 2 AND origin = 1 THEN 4 ELSE plan END AS INTEGER) AS plan FROM ms m JOIN mplan USING (member, r, c) JOIN best USING (member)",
    "geojson_lines": f"""WITH {_BOXES}, b AS (SELECT pid, round(x0 / 7, 1) AS x0, round(y0 / 7, 1) AS y0, round(CASE WHEN pid % 50 = 0 THEN x0 / 7 + 0.01 ELSE x1 / 7 END, 1) AS x1, round(y1 / 7, 1) AS y1 FROM boxes)
        SELECT pid AS fid, '{{"type":"Feature","properties":{{"name":"' || pid || '"}},"geometry":{{"type":"Polygon","coordinates":[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]}}}}' AS value FROM b WHERE x1 > x0 AND y1 > y0""",
}
_ROOK = "offs(dr, dc, s, g) AS (VALUES (1,0,1,0),(0,1,1,0),(-1,0,1,0),(0,-1,1,0))"
ORACLE_SQL["reach_rook"] = ORACLE_SQL["reach_mask"].replace(_OFFSETS, _ROOK)
ORACLE_SQL["walk_sql"] = ORACLE_SQL["walk_blocked"]
ORACLE_SQL["block_labels"] = f"""WITH RECURSIVE {_OFFSETS}, {_CELLS}, m AS (SELECT r // 16 * 1000 + c // 16 AS band, r, c FROM grid WHERE state = 1), {_labels('l', 'm', True, 'band')}
  SELECT r, c, CAST(root // 4294967296 AS INTEGER) AS first_r, CAST(root % 4294967296 AS INTEGER) AS first_c FROM l"""
#: A source's walked cells look about in the order of their lengths; what is seen up to the third built cell's turn counts.
ORACLE_SQL["reach_first"] = (
    ORACLE_SQL["reach_mask"].partition(", h AS (")[0]
    + """, k AS (SELECT src, r, c, o, d, row_number() OVER (PARTITION BY src ORDER BY o + d * sqrt(2.0), r, c) - 1 AS turn FROM w WHERE o < 1000000),
      a AS (SELECT k.src, g.r, g.c, min(CASE WHEN x.s + x.g = 0 THEN 0 ELSE turn END) AS seen FROM k, (SELECT dr, dc, s, g FROM offs UNION ALL SELECT 0, 0, 0, 0) x JOIN grid g ON g.r = k.r + x.dr AND g.c = k.c + x.dc
        WHERE g.state = 1 AND (x.s + x.g > 0 OR o + d = 0) AND k.o + x.s + (k.d + x.g) * sqrt(2.0) <= 4 + 1e-9 GROUP BY k.src, g.r, g.c),
      l AS (SELECT src, max(seen) FILTER (n = 3) AS last FROM (SELECT src, seen, row_number() OVER (PARTITION BY src ORDER BY seen) AS n FROM a) GROUP BY src)
      SELECT CAST(a.src // 1000 AS INTEGER) AS sr, CAST(a.src % 1000 AS INTEGER) AS sc, r, c FROM a JOIN l ON l.src = a.src WHERE last IS NULL OR seen <= last"""
)
