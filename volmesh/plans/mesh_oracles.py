"""DuckDB SQL for queries on rays and derivatives in the mesh, and on the best leaves of views."""

from __future__ import annotations

from volmesh.plans.node_oracles import GEOMETRY, LOCATED, PLACED, SCORES, _sampled, _slab
from volmesh.plans.oracles import FULL, ISO, PART, PROBES, SX, T6, VOLUME

STEP = 0.75
RAYS = "ry AS (SELECT s_suppkey AS ray_id, -2.0::DOUBLE AS ox, s_suppkey % 41 / 4.0::DOUBLE AS oy, s_suppkey % 33 / 4.0::DOUBLE AS oz, 1.0::DOUBLE AS dx, (s_suppkey % 5 - 2) / 16.0::DOUBLE AS dy, (s_suppkey % 3 - 1) / 16.0::DOUBLE AS dz FROM supplier)"
#: Every step of every ray, and the value in the cell there.
ALONG = f"""{FULL}, {RAYS},
t AS (SELECT *, {_slab('x', f'({SX} - 1)')}, {_slab('y', '10')}, {_slab('z', '8')} FROM ry),
u AS (SELECT *, greatest(nx, ny, nz, 0.0::DOUBLE) AS begin, least(fx, fy, fz) AS far FROM t),
st AS (SELECT *, unnest(range(floor((far - begin) / {STEP})::INT + 1))::INT AS step FROM u WHERE begin <= far),
pr AS (SELECT ray_id * 1000000 + step AS probe_id, ray_id, step, ox + (begin + step * {STEP}) * dx AS x, oy + (begin + step * {STEP}) * dy AS y, oz + (begin + step * {STEP}) * dz AS z FROM st),
{LOCATED}, {PLACED}, {GEOMETRY}, {_sampled('sm', 'pl')},
al AS MATERIALIZED (SELECT probe_id // 1000000 AS ray_id, (probe_id % 1000000)::INT AS step, sample AS value FROM sm)"""


def _cross(a: str, b: str, axis: int) -> str:
    p, q = "xyz"[(axis + 1) % 3], "xyz"[(axis + 2) % 3]
    return f"({a}{p} * {b}{q} - {a}{q} * {b}{p})"


_EDGES = ", ".join(f"({a}_{i} - {a}_0) AS e{i}{a}" for i in (1, 2, 3) for a in "xyz")
_NORMALS = ", ".join(f"{_cross(f'e{p}', f'e{q}', n)} AS m{i}{a}" for i, (p, q) in enumerate(((2, 3), (3, 1), (1, 2)), 1) for n, a in enumerate("xyz"))
_EACH = " UNION ALL ".join(f"SELECT cell_id, {i} AS i, abs(w) AS w, " + ", ".join((f"m{i}{a} / w" if i else f"-(m1{a} + m2{a} + m3{a}) / w") + f" AS n{a}" for a in "xyz") + " FROM nm" for i in range(4))
#: wg: the gradient of each vertex's weight in each cell.
WEIGHTS = f"""{GEOMETRY}, ed AS (SELECT cell_id, {_EDGES} FROM geo), nm AS (SELECT cell_id, {_NORMALS}, e1x * {_cross('e2', 'e3', 0)} + e1y * {_cross('e2', 'e3', 1)} + e1z * {_cross('e2', 'e3', 2)} AS w FROM ed),
wg AS MATERIALIZED (SELECT cell_id, point_id, w, nx, ny, nz FROM ({_EACH}) JOIN cv USING (cell_id, i))"""
CV_ALL = "cv AS (SELECT cell_id, unnest([v0, v1, v2, v3]) AS point_id, unnest([0, 1, 2, 3]) AS i FROM t6)"


def _slopes(source: str) -> str:
    """vg: the gradient of fields (point_id, name, value) at vertices."""
    return f"""cg AS (SELECT cell_id, name, any_value(w) AS w, {', '.join(f'sum(value * n{a}) AS g{a}' for a in 'xyz')} FROM wg JOIN {source} USING (point_id) GROUP BY cell_id, name),
vg AS MATERIALIZED (SELECT cv.point_id, name, {', '.join(f'sum(w * g{a}) / sum(w) AS g{a}' for a in 'xyz')} FROM cg JOIN cv USING (cell_id) GROUP BY cv.point_id, name)"""


_D = lambda f, a: f"max(g{a}) FILTER (name = '{f}') AS d{f}_{a}"
DERIVED = f"""{VOLUME},{T6}, {CV_ALL}, {WEIGHTS}, fl AS (SELECT point_id, value, value AS vx, -x::DOUBLE AS vy, z * value AS vz, value + 1 AS sound2 FROM v),
ff AS (SELECT point_id, unnest(['value', 'vx', 'vy', 'vz']) AS name, unnest([value, vx, vy, vz]) AS value FROM fl), {_slopes('ff')},
d AS (SELECT point_id, {', '.join(_D(f, a) for f in ('value', 'vx', 'vy', 'vz') for a in 'xyz')} FROM vg GROUP BY point_id),
out AS MATERIALIZED (SELECT point_id, sqrt(vx * vx + vy * vy + vz * vz) AS magnitude, sqrt(dvalue_x ** 2 + dvalue_y ** 2 + dvalue_z ** 2) AS gradient_magnitude, sqrt((vx * vx + vy * vy + vz * vz) / sound2) AS mach,
  dvx_x + dvy_y + dvz_z AS divergence, sqrt((dvz_y - dvy_z) ** 2 + (dvx_z - dvz_x) ** 2 + (dvy_x - dvx_y) ** 2) AS vorticity,
  (dvx_x * dvy_y + dvx_x * dvz_z + dvy_y * dvz_z) - (dvx_y * dvy_x + dvx_z * dvz_x + dvy_z * dvz_y) AS q_criterion FROM d JOIN fl USING (point_id))"""
NAMES = ("magnitude", "gradient_magnitude", "mach", "divergence", "vorticity", "q_criterion")
_E = 2.0**-6
_MOVED = " UNION ALL ".join(f"SELECT probe_id * 3 + {i} AS probe_id, x + {s}::DOUBLE AS x, y, z FROM pq" for i, s in enumerate((0.0, _E, -_E)))

SQL = {
    "mesh_line_probe": f"WITH {ALONG} SELECT ray_id, step, 'count' AS name, round(value, 6) AS value FROM al",
    "mesh_crossing": f"""WITH {ALONG}, bf AS (SELECT *, lag(value) OVER w AS before, lag(step) OVER w AS step_before FROM al WINDOW w AS (PARTITION BY ray_id ORDER BY step)),
f AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY step) AS n FROM bf WHERE step_before = step - 1 AND (before > {ISO}) <> (value > {ISO}))
SELECT ray_id, step, CASE WHEN value > {ISO} THEN 1 ELSE -1 END AS direction, round((step * {STEP} * (before - {ISO}) - (step - 1) * {STEP} * (value - {ISO})) / (before - value), 6) AS t FROM f WHERE n = 1""",
    "mesh_light": f"""WITH {ALONG}, d AS (SELECT ray_id, value, value / 16.0::DOUBLE * {STEP} AS d, sum(value / 16.0::DOUBLE * {STEP}) OVER (PARTITION BY ray_id ORDER BY step) AS upto FROM al), q AS (SELECT *, pow(2.0::DOUBLE, -upto) AS after, pow(2.0::DOUBLE, d - upto) AS before FROM d)
SELECT ray_id, round(sum(value * (before - after)), 6) AS light, round(min(after), 9) AS transmittance FROM q WHERE before >= 0.005 GROUP BY ray_id""",
    "mesh_gradients": f"WITH {VOLUME},{T6}, {CV_ALL}, {WEIGHTS}, ff AS (SELECT point_id, 'count' AS name, value FROM v), {_slopes('ff')} SELECT point_id, name, {', '.join(f'round(g{a}, 6) AS g{a}' for a in 'xyz')} FROM vg",
    "mesh_derived": f"WITH {DERIVED} SELECT point_id, {', '.join(f'round({n}, 5) AS {n}' for n in NAMES)} FROM out",
    "mesh_derived_limits": f"WITH {DERIVED} " + " UNION ALL ".join(f"SELECT '{n}' AS name, round(min({n}), 5) AS lo, round(max({n}), 5) AS hi FROM out" for n in NAMES),
    "mesh_derivative_points": f"""WITH {PART}, {PROBES.replace('pr AS', 'pq AS')}, pr AS ({_MOVED}), {LOCATED}, {PLACED}, {GEOMETRY}, {_sampled('sm', 'pl')},
w AS (SELECT probe_id // 3 AS probe_id, {', '.join(f'max(sample) FILTER (probe_id % 3 = {i}) AS s{i}' for i in range(3))} FROM sm GROUP BY 1)
SELECT probe_id, 'count' AS name, round(coalesce((s1 - s0) / {_E}, (s0 - s2) / {_E}, 0), 5) AS d FROM pq LEFT JOIN w USING (probe_id)""",
    "best_leaves": f"WITH {SCORES} SELECT view_id, node_key AS leaf_key, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, node_key) AS r FROM sc WHERE is_leaf AND score > 0) WHERE r <= 3",
}
