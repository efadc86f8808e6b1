"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

MAX_DEPTH = 7

#: The grid has more steps along x the more order lines there are; the iso-value is two deviations over the mean.
VOLUME = """
gs AS MATERIALIZED (SELECT greatest(1, count(*) // 60000) AS k, 50 * greatest(1, count(*) // 60000) AS sx FROM lineitem),
g AS (SELECT i % sx AS x, (i // sx) % 11 AS y, i // (11 * sx) AS z, i AS point_id FROM (SELECT unnest(range(99 * sx)) AS i, sx FROM gs)),
l AS (SELECT ((l_quantity - 1)::INT * k + l_partkey % k)::INT AS x, round(l_discount * 100)::INT AS y, round(l_tax * 100)::INT AS z, count(*) AS n FROM lineitem, gs GROUP BY ALL),
v AS MATERIALIZED (SELECT g.x::INT AS x, g.y::INT AS y, g.z::INT AS z, point_id::BIGINT AS point_id, coalesce(n, 0)::DOUBLE AS value FROM g LEFT JOIN l ON g.x = l.x AND g.y = l.y AND g.z = l.z),
iv AS MATERIALIZED (SELECT round(avg(value) + 2 * stddev_pop(value), 3) AS iso FROM v)"""
SX, ISO = "(SELECT sx FROM gs)", "(SELECT iso FROM iv)"


def _cells(name: str, patterns: tuple) -> str:
    rows = ", ".join(f"({k}, {', '.join(str(c) for c in p)})" for k, p in enumerate(patterns))
    vertex = lambda i: f"((cx + (c{i} & 1)) + sx * (cy + ((c{i} >> 1) & 1)) + 11 * sx * (cz + (c{i} >> 2)))::BIGINT AS v{i}"
    return f"""
{name} AS MATERIALIZED (SELECT (cube * {len(patterns)} + k)::BIGINT AS cell_id, {', '.join(vertex(i) for i in range(4))}
  FROM (SELECT i AS cube, sx, i % (sx - 1) AS cx, (i // (sx - 1)) % 10 AS cy, i // (10 * (sx - 1)) AS cz FROM (SELECT unnest(range(80 * (sx - 1))) AS i, sx FROM gs)), (VALUES {rows}) AS p(k, c0, c1, c2, c3))"""


T6 = _cells("t6", ((1, 0, 5, 7), (0, 5, 7, 4), (0, 7, 6, 4), (0, 7, 2, 6), (0, 3, 2, 7), (0, 1, 3, 7)))
#: Corners are numbered with bit 0 for x, bit 1 for y, bit 2 for z.
T5 = _cells("t5", ((0, 1, 2, 4), (1, 3, 2, 7), (4, 7, 5, 1), (4, 7, 2, 6), (1, 2, 4, 7)))
CV = "cv AS (SELECT cell_id, unnest([v0, v1, v2, v3]) AS point_id, unnest([0, 1, 2, 3]) AS i FROM t6)"
BOUNDS = "b AS MATERIALIZED (SELECT cell_id, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, min(z)::DOUBLE AS z0, max(x)::DOUBLE AS x1, max(y)::DOUBLE AS y1, max(z)::DOUBLE AS z1 FROM cv JOIN v USING (point_id) GROUP BY cell_id)"
HELD = "h AS MATERIALIZED (SELECT b.* FROM b SEMI JOIN (SELECT cell_id FROM cv JOIN v USING (point_id) WHERE value > (SELECT iso FROM iv)) AS k ON b.cell_id = k.cell_id)"


def _tree(cells: str, max_cells: int) -> str:
    """All nodes down to the deepest level with their cells, then those that a leaf size leaves."""
    pick = lambda n: f"CASE depth % 3 WHEN 0 THEN {n.format('x')} WHEN 1 THEN {n.format('y')} ELSE {n.format('z')} END"
    low, high = ", ".join(f"{a}0" for a in "xyz"), ", ".join(f"{a}1" for a in "xyz")
    mid = pick("(n.{0}0 + n.{0}1) / 2")
    return f"""
box AS (WITH RECURSIVE n(node_key, depth, {low}, {high}) AS (
    SELECT 1::BIGINT, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, (SELECT (sx - 1)::DOUBLE FROM gs), 10.0::DOUBLE, 8.0::DOUBLE
    UNION ALL
    SELECT k, d, bx0, by0, bz0, bx1, by1, bz1 FROM (
      SELECT 2 * node_key + side AS k, depth + 1 AS d,
        CASE WHEN side = 1 AND depth % 3 = 0 THEN {mid} ELSE x0 END AS bx0, CASE WHEN side = 1 AND depth % 3 = 1 THEN {mid} ELSE y0 END AS by0, CASE WHEN side = 1 AND depth % 3 = 2 THEN {mid} ELSE z0 END AS bz0,
        CASE WHEN side = 0 AND depth % 3 = 0 THEN {mid} ELSE x1 END AS bx1, CASE WHEN side = 0 AND depth % 3 = 1 THEN {mid} ELSE y1 END AS by1, CASE WHEN side = 0 AND depth % 3 = 2 THEN {mid} ELSE z1 END AS bz1
      FROM n, (VALUES (0), (1)) AS s(side) WHERE depth < {MAX_DEPTH})
  ) SELECT * FROM n),
memb AS MATERIALIZED (WITH RECURSIVE m(node_key, depth, cell_id) AS (
    SELECT 1::BIGINT, 0, cell_id FROM {cells}
    UNION ALL
    SELECT 2 * m.node_key + side, m.depth + 1, m.cell_id FROM m JOIN {cells} AS c ON m.cell_id = c.cell_id JOIN box AS n ON n.node_key = m.node_key, (VALUES (0), (1)) AS s(side)
    WHERE m.depth < {MAX_DEPTH} AND CASE WHEN side = 0 THEN CASE m.depth % 3 WHEN 0 THEN c.x0 WHEN 1 THEN c.y0 ELSE c.z0 END <= CASE m.depth % 3 WHEN 0 THEN (n.x0 + n.x1) / 2 WHEN 1 THEN (n.y0 + n.y1) / 2 ELSE (n.z0 + n.z1) / 2 END
      ELSE CASE m.depth % 3 WHEN 0 THEN c.x1 WHEN 1 THEN c.y1 ELSE c.z1 END > CASE m.depth % 3 WHEN 0 THEN (n.x0 + n.x1) / 2 WHEN 1 THEN (n.y0 + n.y1) / 2 ELSE (n.z0 + n.z1) / 2 END END
  ) SELECT * FROM m),
num AS MATERIALIZED (SELECT box.*, coalesce(c, 0)::BIGINT AS cell_count FROM box LEFT JOIN (SELECT node_key, count(*) AS c FROM memb GROUP BY node_key) AS q USING (node_key)),
nodes AS MATERIALIZED (WITH RECURSIVE t AS (
    SELECT num.*, (depth = {MAX_DEPTH} OR cell_count <= {max_cells}) AS is_leaf FROM num WHERE node_key = 1
    UNION ALL
    SELECT num.*, (num.depth = {MAX_DEPTH} OR num.cell_count <= {max_cells}) AS is_leaf FROM num JOIN t ON num.node_key // 2 = t.node_key WHERE NOT t.is_leaf
  ) SELECT * FROM t),
lc AS MATERIALIZED (SELECT m.node_key AS leaf_key, m.cell_id FROM memb AS m JOIN nodes USING (node_key) WHERE is_leaf)"""


FULL = f"{VOLUME},{T6}, {CV}, {BOUNDS}, {_tree('b', 1024)}"
PART = f"{VOLUME},{T6}, {CV}, {BOUNDS}, {HELD}, {_tree('h', 256)}"
RANGES = """
lr AS (SELECT n.node_key AS leaf_key, coalesce(min(value), 0) AS lo, coalesce(max(value), 0) AS hi FROM nodes AS n LEFT JOIN lc ON lc.leaf_key = n.node_key LEFT JOIN cv USING (cell_id) LEFT JOIN v USING (point_id) WHERE is_leaf GROUP BY n.node_key),
nr AS (SELECT leaf_key >> k AS node_key, 'count' AS name, min(lo) AS lo, max(hi) AS hi FROM lr, range(8) AS r(k) WHERE leaf_key >> k > 0 GROUP BY ALL)"""
BLOCKS = """
bp AS MATERIALIZED (SELECT leaf_key, point_id, row_number() OVER (PARTITION BY leaf_key ORDER BY place) - 1 AS local_id FROM (SELECT leaf_key, point_id, min(cell_id * 4 + i) AS place FROM lc JOIN cv USING (cell_id) GROUP BY leaf_key, point_id)),
bs AS (SELECT n.node_key AS leaf_key, depth, cell_count AS cells, count(bp.point_id) AS verts FROM nodes AS n LEFT JOIN bp ON bp.leaf_key = n.node_key WHERE is_leaf GROUP BY ALL)"""
PROBES = "pr AS (SELECT p_partkey AS probe_id, (p_partkey * 7) % (4 * (SELECT sx - 1 FROM gs)) / 4.0::DOUBLE AS x, (p_partkey * 3) % 40 / 4.0::DOUBLE AS y, p_partkey % 32 / 4.0::DOUBLE AS z FROM part)"


def _trilinear(source: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN count(w) = 0 THEN NULL ELSE round(sum(w * value), 6) END AS sample FROM (
  SELECT q.*, v.value, (CASE dx WHEN 1 THEN x_ - bx ELSE 1 - (x_ - bx) END) * (CASE dy WHEN 1 THEN y_ - by_ ELSE 1 - (y_ - by_) END) * (CASE dz WHEN 1 THEN z_ - bz ELSE 1 - (z_ - bz) END) AS w
  FROM (SELECT *, x AS x_, y AS y_, z AS z_, least(floor(x), {SX} - 2) AS bx, least(floor(y), 9) AS by_, least(floor(z), 7) AS bz FROM {source} WHERE x BETWEEN 0 AND {SX} - 1 AND y BETWEEN 0 AND 10 AND z BETWEEN 0 AND 8) AS q,
    (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy), (VALUES (0), (1)) AS c(dz), v WHERE v.x = bx + dx AND v.y = by_ + dy AND v.z = bz + dz) GROUP BY {key}"""


CLOUD = "cl AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS value FROM embeddings)"
TELEMETRY = "te AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_num, event_type AS metric, value::DOUBLE AS value, event_id AS seq FROM events)"
_D = lambda e, a: f"coalesce(lead({e}) OVER w{a} - ({e}), ({e}) - lag({e}) OVER w{a}, 0)"
_W = "WINDOW wx AS (PARTITION BY y, z ORDER BY x), wy AS (PARTITION BY x, z ORDER BY y), wz AS (PARTITION BY x, y ORDER BY z)"

SQL = {
    "volume": f"WITH {VOLUME} SELECT x, y, z, value FROM v",
    "tets6": f"WITH {VOLUME},{T6} SELECT cell_id, v0, v1, v2, v3, a.value + b.value + c.value + d.value AS total FROM t6 JOIN v a ON a.point_id = v0 JOIN v b ON b.point_id = v1 JOIN v c ON c.point_id = v2 JOIN v d ON d.point_id = v3",
    "tets5": f"WITH {VOLUME},{T5} SELECT cell_id, v0, v1, v2, v3, a.value + b.value + c.value + d.value AS total FROM t5 JOIN v a ON a.point_id = v0 JOIN v b ON b.point_id = v1 JOIN v c ON c.point_id = v2 JOIN v d ON d.point_id = v3",
    "downsample": f"WITH {VOLUME} SELECT (x // 2)::INT AS x, (y // 2)::INT AS y, (z // 2)::INT AS z, value FROM v WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0 AND y < 10 AND z < 8",
    "mirror": f"WITH {CLOUD}, n AS (SELECT max(point_id) + 1 AS n FROM cl) SELECT (point_id + c * n)::BIGINT AS point_id, round(CASE WHEN c & 1 > 0 THEN 1 - x ELSE x END, 6) AS x, round(y, 6) AS y, round(CASE WHEN c & 2 > 0 THEN -0.5 - z ELSE z END, 6) AS z FROM cl, n, range(4) AS r(c)",
    "bounding_box": f"WITH {CLOUD} SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM cl",
    "field_limits": f"WITH {VOLUME}, {CLOUD} SELECT 'count' AS name, min(value) AS lo, max(value) AS hi FROM v UNION ALL SELECT 'embedding', min(value), max(value) FROM cl",
    "select_scalars": "SELECT event_type AS name, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'missing') GROUP BY 1",
    "cell_bounds": f"WITH {VOLUME},{T6}, {CV}, {BOUNDS}, {HELD} SELECT *, (x1 - x0) * (y1 - y0) * (z1 - z0) AS volume, greatest(x1 - x0, y1 - y0, z1 - z0) AS longest FROM h",
    "boundary_geometry": f"""WITH {VOLUME}, f AS (SELECT CASE WHEN value > {ISO} THEN 'wall' ELSE 'symmetry' END AS name, point_id AS p FROM v WHERE z = 0 AND x < {SX} - 1 AND y < 10),
t AS (SELECT name, 2 * p AS tri_id, [p, p + 1, p + 1 + {SX}] AS verts FROM f UNION ALL SELECT name, 2 * p + 1, [p, p + 1 + {SX}, p + {SX}] FROM f),
c AS (SELECT name, tri_id, unnest(verts) AS point_id, unnest([0, 1, 2]) AS i FROM t),
o AS (SELECT point_id, row_number() OVER (ORDER BY place) - 1 AS local_id FROM (SELECT point_id, min((name, tri_id, i)) AS place FROM c GROUP BY point_id))
SELECT name, tri_id, max(local_id) FILTER (i = 0) AS a, max(local_id) FILTER (i = 1) AS b, max(local_id) FILTER (i = 2) AS c, name <> 'symmetry' AS show_by_default FROM c JOIN o USING (point_id) GROUP BY ALL""",
    "transfer": f"WITH {VOLUME}, {CLOUD}, m AS (SELECT point_id, (x + 1) / 2 * ({SX} - 1) AS x, (y + 1) / 2 * 10 AS y, (z + 1) / 2 * 8 AS z FROM cl), s AS ({_trilinear('m', 'point_id')}) SELECT point_id, sample AS value FROM cl LEFT JOIN s USING (point_id)",
    "trilinear": f"WITH {VOLUME}, {PROBES}, s AS ({_trilinear('pr', 'probe_id')}) SELECT probe_id, sample FROM pr LEFT JOIN s USING (probe_id)",
    "tree_nodes": f"WITH {FULL}, {RANGES} SELECT node_key, node_key // 2 AS parent_key, depth, is_leaf, cell_count, x0, y0, z0, x1, y1, z1, hi FROM nodes JOIN nr USING (node_key)",
    "node_ranges": f"WITH {FULL}, {RANGES} SELECT * FROM nr",
    "iso_leaves": f"WITH {FULL}, {RANGES} SELECT node_key, lo, hi, cell_count FROM nr JOIN nodes USING (node_key) WHERE is_leaf AND lo <= {ISO} AND hi >= {ISO}",
    "leaf_values": f"WITH {FULL} SELECT leaf_key, count(DISTINCT cell_id) AS cells, sum(value) AS total FROM lc JOIN cv USING (cell_id) JOIN v USING (point_id) GROUP BY leaf_key",
    "tree_stats": f"WITH {PART} SELECT count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, round(avg(cell_count) FILTER (is_leaf), 6) AS avg_cells, max(cell_count) FILTER (is_leaf) AS max_cells, max(depth) AS max_depth, (sum(cell_count) FILTER (is_leaf))::BIGINT AS leaf_cells, count(*) FILTER (is_leaf AND cell_count < 10) AS small_leaves, count(*) * 20 AS node_bytes, (sum(cell_count) FILTER (is_leaf) * 4)::BIGINT AS cell_bytes FROM nodes",
    "serialised_nodes": f"""WITH {PART}, o AS (SELECT *, translate(substr(bin(node_key), 2), '01', '10') AS path FROM nodes),
p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path) - 1 AS this_ptr, sum(CASE WHEN is_leaf THEN cell_count ELSE 0 END) OVER (ORDER BY path) - CASE WHEN is_leaf THEN cell_count ELSE 0 END AS cells_before FROM o)
SELECT p.node_key, p.this_ptr, CASE WHEN p.is_leaf THEN NULL ELSE (CASE p.depth % 3 WHEN 0 THEN (p.x0 + p.x1) / 2 WHEN 1 THEN (p.y0 + p.y1) / 2 ELSE (p.z0 + p.z1) / 2 END)::FLOAT END AS split_val, p.cell_count, coalesce(u.this_ptr, 0) AS parent_ptr, (CASE WHEN p.is_leaf THEN p.cells_before ELSE a.this_ptr END)::BIGINT AS left_ptr, coalesce(b.this_ptr, 0) AS right_ptr
FROM p LEFT JOIN p AS u ON u.node_key = p.node_key // 2 LEFT JOIN p AS a ON a.node_key = 2 * p.node_key LEFT JOIN p AS b ON b.node_key = 2 * p.node_key + 1""",
    "leaf_sweep": f"WITH {PART} SELECT target, count(*) AS leaves, sum(n.cell_count)::BIGINT AS leaf_cells, max(n.cell_count) AS max_cells FROM (SELECT unnest([8192, 4096, 2048, 1024, 512, 256])::INT AS target) AS t, nodes AS n LEFT JOIN nodes AS u ON u.node_key = n.node_key // 2 WHERE coalesce(u.cell_count, 1e18) > target AND (n.cell_count <= target OR n.is_leaf) GROUP BY target",
    "node_averages": f"WITH {FULL}, {BLOCKS}, la AS (SELECT leaf_key, avg(value) AS average FROM bp JOIN v USING (point_id) GROUP BY leaf_key), w AS (SELECT la.*, (x1 - x0) * (y1 - y0) * (z1 - z0) AS vol FROM la JOIN nodes ON node_key = leaf_key) SELECT leaf_key >> k AS node_key, 'count' AS name, round(sum(average * vol) / sum(vol), 6) AS average FROM w, range(8) AS r(k) WHERE leaf_key >> k > 0 GROUP BY ALL",
    "block_values": f"WITH {FULL}, {BLOCKS} SELECT leaf_key, local_id, value FROM bp JOIN v USING (point_id)",
    "block_cells": f"""WITH {FULL}, {RANGES}, {BLOCKS}, k AS (SELECT leaf_key, cell_id, row_number() OVER (PARTITION BY leaf_key ORDER BY cell_id) - 1 AS local_cell FROM lc)
SELECT leaf_key, local_cell, max(local_id) FILTER (i = 0) AS v0, max(local_id) FILTER (i = 1) AS v1, max(local_id) FILTER (i = 2) AS v2, max(local_id) FILTER (i = 3) AS v3 FROM k JOIN cv USING (cell_id) JOIN bp USING (leaf_key, point_id) SEMI JOIN (SELECT * FROM nr WHERE lo <= {ISO} AND hi >= {ISO}) AS a ON a.node_key = leaf_key GROUP BY leaf_key, local_cell""",
    "padded_blocks": f"WITH {PART}, {BLOCKS} SELECT leaf_key, (4 * (SELECT max(cells) FROM bs))::INT AS length, sum(local_id)::BIGINT AS total FROM lc JOIN cv USING (cell_id) JOIN bp USING (leaf_key, point_id) GROUP BY leaf_key",
    "filled_slots": f"WITH {PART}, {BLOCKS} SELECT leaf_key, depth, cells, verts FROM bs",
    "overview": f"WITH {PART}, {BLOCKS} SELECT sum(verts)::BIGINT AS block_verts, sum(cells)::BIGINT AS block_cells, count(*) AS leaves, (99 * {SX})::BIGINT AS verts, (480 * ({SX} - 1))::BIGINT AS cells, 256 AS target FROM bs",
    "duplicates": f"WITH {PART}, {BLOCKS}, a AS (SELECT n - 1 AS copies, count(*) AS verts FROM (SELECT count(*) AS n FROM bp GROUP BY point_id) GROUP BY 1), c AS (SELECT n - 1 AS copies, count(*) AS cells FROM (SELECT count(*) AS n FROM lc GROUP BY cell_id) GROUP BY 1) SELECT copies, coalesce(verts, 0) AS verts, coalesce(cells, 0) AS cells FROM a FULL JOIN c USING (copies)",
    "buffer_sizes": f"WITH {PART}, {BLOCKS}, s AS (SELECT sum(verts) AS v, sum(cells) AS c, max(verts) AS mv, max(cells) AS mc, count(*) AS n FROM bs) SELECT kind, used::BIGINT AS used, padded::BIGINT AS padded FROM (SELECT 'positions' AS kind, 3 * v AS used, 3 * mv * n AS padded FROM s UNION ALL SELECT 'values', v, mv * n FROM s UNION ALL SELECT 'offsets', c, mc * n FROM s UNION ALL SELECT 'connectivity', 4 * c, 4 * mc * n FROM s)",
    "locate": f"WITH {FULL}, {PROBES}, h AS (SELECT probe_id, max(node_key) AS leaf_key FROM pr JOIN nodes AS n ON is_leaf AND pr.x <= n.x1 AND pr.y <= n.y1 AND pr.z <= n.z1 AND (pr.x > n.x0 OR n.x0 = 0) AND (pr.y > n.y0 OR n.y0 = 0) AND (pr.z > n.z0 OR n.z0 = 0) WHERE pr.x BETWEEN 0 AND {SX} - 1 AND pr.y BETWEEN 0 AND 10 AND pr.z BETWEEN 0 AND 8 GROUP BY probe_id) SELECT probe_id, leaf_key FROM pr LEFT JOIN h USING (probe_id)",
    "derivative": f"WITH {VOLUME} SELECT x, y, z, {_D('value', 'x')} AS d FROM v {_W}",
    "derived_fields": f"""WITH {VOLUME}, f AS (SELECT x, y, z, value, value AS vx, -x::DOUBLE AS vy, z * value AS vz, value + 1 AS sound2 FROM v),
d AS (SELECT *, {', '.join(f"{_D(e, a)} AS d{e}_{a}" for e in ('value', 'vx', 'vy', 'vz') for a in 'xyz')} FROM f {_W})
SELECT x, y, z, round(sqrt(vx * vx + vy * vy + vz * vz), 6) AS magnitude, round(sqrt(dvalue_x ** 2 + dvalue_y ** 2 + dvalue_z ** 2), 6) AS gradient_magnitude, round(sqrt((vx * vx + vy * vy + vz * vz) / sound2), 6) AS mach,
  round(dvx_x + dvy_y + dvz_z, 6) AS divergence, round(sqrt((dvz_y - dvy_z) ** 2 + (dvx_z - dvz_x) ** 2 + (dvy_x - dvx_y) ** 2), 6) AS vorticity,
  round((dvx_x * dvy_y + dvx_x * dvz_z + dvy_y * dvz_z) - (dvx_y * dvy_x + dvx_z * dvz_x + dvy_z * dvz_y), 6) AS q_criterion FROM d""",
    "colours": f"WITH {VOLUME}, t AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / (2 * {ISO}))) AS t FROM v) SELECT x, y, z, round(CASE WHEN t < 0.5 THEN 2 * t ELSE 1 END, 6) AS red, round(CASE WHEN t < 0.5 THEN 2 * t ELSE 2 - 2 * t END, 6) AS green, round(CASE WHEN t < 0.5 THEN 1 ELSE 2 - 2 * t END, 6) AS blue FROM t",
    "frontier": f"WITH {PART}, e AS (SELECT node_key FROM nodes WHERE NOT is_leaf ORDER BY node_key LIMIT 3), f AS (SELECT 1 AS node_key UNION SELECT 2 * node_key FROM e UNION SELECT 2 * node_key + 1 FROM e) SELECT node_key, is_leaf FROM nodes WHERE node_key IN (SELECT node_key FROM f) AND node_key NOT IN (SELECT node_key FROM e)",
    "frame_metrics": f"WITH {TELEMETRY}, k AS (SELECT * FROM (SELECT *, max(frame_num) OVER (PARTITION BY run_id) AS newest FROM te) WHERE frame_num > newest - 2000) SELECT run_id, frame_num, {', '.join(f'''arg_max(value, seq) FILTER (metric = '{m}') AS {m}''' for m in ('click', 'error', 'purchase', 'signup', 'view'))} FROM k GROUP BY run_id, frame_num",
    "job_expansion": "SELECT c_mktsegment || '_' || c_nationkey || '_' || b AS name, c_nationkey AS nation, b AS budget FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), (VALUES (10), (30), (90)) AS t(b)",
    "camera_schedule": """WITH t AS (SELECT DISTINCT event_id % 3000000 / 100000.0::DOUBLE AS t FROM events), s AS (SELECT n_nationkey * 1.2::DOUBLE AS t0, (n_nationkey + 1) * 1.2::DOUBLE AS t1, (1 + n_nationkey % 5)::DOUBLE AS r0, (1 + (n_nationkey + 1) % 5)::DOUBLE AS r1, n_nationkey * 0.5::DOUBLE AS a0, (n_nationkey + 1) * 0.5::DOUBLE AS a1, (n_nationkey % 3) * 0.25::DOUBLE AS e0, ((n_nationkey + 1) % 3) * 0.25::DOUBLE AS e1 FROM nation),
n AS (SELECT t, r0 + (r1 - r0) * p AS r, a0 + (a1 - a0) * p AS a, e0 + (e1 - e0) * p AS e FROM (SELECT *, ((t - t0) / (t1 - t0))::DOUBLE AS p FROM t JOIN s ON t >= t0 AND t < t1))
SELECT t, round(r * cos(e) * sin(a), 6) AS x, round(r * sin(e), 6) AS y, round(r * cos(e) * cos(a), 6) AS z FROM n""",
    "iso_crossing": f"""WITH {VOLUME}, r AS (SELECT (y + 100 * z)::BIGINT AS ray_id, x AS step, value, lag(value) OVER (PARTITION BY y, z ORDER BY x) AS before FROM v), f AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY step) AS n FROM r WHERE (before > {ISO}) <> (value > {ISO}))
SELECT ray_id, step, CASE WHEN value > {ISO} THEN 1 ELSE -1 END AS direction, round((step * (before - {ISO}) - (step - 1) * (value - {ISO})) / (before - value), 6) AS t FROM f WHERE n = 1""",
    "light": f"""WITH {VOLUME}, d AS (SELECT (y + 100 * z)::BIGINT AS ray_id, value, value / 16.0::DOUBLE AS d, sum(value / 16.0::DOUBLE) OVER (PARTITION BY y, z ORDER BY x) AS upto FROM v), q AS (SELECT *, pow(2.0::DOUBLE, -upto) AS after, pow(2.0::DOUBLE, d - upto) AS before FROM d)
SELECT ray_id, round(sum(value * (before - after)), 6) AS light, round(min(after), 9) AS transmittance FROM q WHERE before >= 0.005 GROUP BY ray_id""",
    "line_probe": f"WITH {VOLUME}, s AS (SELECT p_partkey AS ray_id, i::INT AS step, i::DOUBLE AS x, (p_partkey % 11)::DOUBLE AS y, i * 0.125::DOUBLE AS z FROM (SELECT p_partkey, unnest(range(least({SX} - 1, 64) + 1)) AS i FROM part)), q AS ({_trilinear('s', 'ray_id, step')}) SELECT * FROM q WHERE sample IS NOT NULL",
}
