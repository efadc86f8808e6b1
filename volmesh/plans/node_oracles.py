"""DuckDB SQL for queries on trees by other strategies, on values at nodes and points, on views and on blocks."""

from __future__ import annotations

from volmesh.plans.oracles import BLOCKS, BOUNDS, CV, FULL, HELD, ISO, MAX_DEPTH, PART, PROBES, RANGES, SX, T6, VOLUME, _trilinear

BOX = ("x0", "y0", "z0", "x1", "y1", "z1")
SIDES = "(VALUES (0), (1)) AS s(side)"


def _number(*key: str) -> str:
    joined = " || ':' || ".join(key)
    return f"('0x' || substr(md5({joined}), 1, 8))::BIGINT"


def _unit(*key: str) -> str:
    return f"({_number(*key)} / 4294967296.0::DOUBLE)"


def _levels(strategy: str, cells: str, max_cells: int, points: str | None = None) -> str:
    """Nodes, a level at a time, by any strategy that doesn't only depend on the boxes."""
    out = [
        "n0 AS (SELECT 1::BIGINT AS node_key, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS z0, (SELECT (sx - 1)::DOUBLE FROM gs) AS x1, 10.0::DOUBLE AS y1, 8.0::DOUBLE AS z1)",
        f"a0 AS (SELECT 1::BIGINT AS node_key, cell_id, {', '.join(BOX)} FROM {cells})",
    ]
    if points:
        out.append(f"p0 AS (SELECT 1::BIGINT AS node_key, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM {points})")
    for d in range(MAX_DEPTH + 1):
        a = "xyz"[d % 3]
        count = f"c{d} AS MATERIALIZED (SELECT n{d}.*, coalesce(c, 0)::BIGINT AS cell_count FROM n{d} LEFT JOIN (SELECT node_key, count(*) AS c FROM a{d} GROUP BY node_key) AS q USING (node_key))"
        out.append(count)
        if strategy in ("surface", "volume"):
            n = 5 if strategy == "surface" else 1
            out.append(f"r{d} AS (SELECT *, {', '.join(f'({a}0 + ({a}1 - {a}0) * {i + 1} / {n + 1})::FLOAT AS t{i}' for i in range(n))} FROM c{d})")
            sums = ", ".join(f"count(*) FILTER (c.{a}0 <= r.t{i}::DOUBLE) AS l{i}, count(*) FILTER (c.{a}1 > r.t{i}::DOUBLE) AS g{i}" for i in range(n))
            out.append(f"s{d} AS (SELECT r.node_key, {sums} FROM r{d} AS r JOIN a{d} AS c ON c.node_key = r.node_key GROUP BY r.node_key)")

            def measure(low: str | None = None, high: str | None = None) -> str:
                x, y, z = (f"({high if b == a and high else b + '1'} - {low if b == a and low else b + '0'})" for b in "xyz")
                return f"(2 * ({x} * {y} + {y} * {z} + {z} * {x}))" if strategy == "surface" else f"({x} * {y} * {z})"

            costs = ", ".join(f"0.0625::DOUBLE + ({measure(high=f't{i}::DOUBLE')} * coalesce(l{i}, 0) + {measure(low=f't{i}::DOUBLE')} * coalesce(g{i}, 0)) / {measure()} AS k{i}" for i in range(n))
            out.append(f"k{d} AS (SELECT r{d}.*, {costs} FROM r{d} LEFT JOIN s{d} USING (node_key))")
            least = f"least({', '.join(f'k{i}' for i in range(n))})" if n > 1 else "k0"
            pick = "CASE " + " ".join(f"WHEN k{i} = {least} THEN t{i}" for i in range(n)) + " END"
            split, source = f"{pick} AS split_val, {least} AS cost", f"k{d}"
            stop = f"cell_count < 4 OR (cost > cell_count AND cell_count < {max_cells})" if strategy == "surface" else f"cell_count < {max_cells} OR cost > cell_count"
        else:
            if strategy == "average":
                out.append(f"v{d}_ AS (SELECT node_key, ((min({a}) + max({a})) / 2)::FLOAT AS piv FROM p{d} GROUP BY node_key)")
            else:
                out.append(f"v{d}_ AS (SELECT node_key, {a}::FLOAT AS piv FROM (SELECT node_key, {a}, row_number() OVER (PARTITION BY node_key ORDER BY {a}) AS i, count(*) OVER (PARTITION BY node_key) AS n FROM p{d}) WHERE n > 1 AND i = n // 2)")
            out.append(f"w{d}_ AS (SELECT node_key, any_value(piv) AS piv FROM p{d} JOIN v{d}_ USING (node_key) GROUP BY node_key HAVING bool_or({a} > piv::DOUBLE) AND bool_or({a} <= piv::DOUBLE))")
            split, source = "piv AS split_val, 0 AS cost", f"c{d} LEFT JOIN w{d}_ USING (node_key)"
            stop = f"cell_count <= {max_cells} OR split_val IS NULL"
        stop = "true" if d == MAX_DEPTH else stop
        columns = ", ".join(("node_key", *BOX, "cell_count"))
        out.append(f"l{d} AS MATERIALIZED (SELECT *, coalesce({stop}, false) AS is_leaf FROM (SELECT {columns}, {split} FROM {source}))")
        if d < MAX_DEPTH:
            box = ", ".join(f"CASE WHEN side = {int(b[1] == '0')} THEN split_val::DOUBLE ELSE {b} END AS {b}" if b[0] == a else b for b in BOX)
            out.append(f"n{d + 1} AS MATERIALIZED (SELECT 2 * node_key + side AS node_key, {box} FROM l{d}, {SIDES} WHERE NOT is_leaf)")
            out.append(f"a{d + 1} AS MATERIALIZED (SELECT 2 * c.node_key + side AS node_key, cell_id, {', '.join(f'c.{b}' for b in BOX)} FROM a{d} AS c JOIN l{d} AS l ON l.node_key = c.node_key, {SIDES} WHERE NOT is_leaf AND CASE WHEN side = 0 THEN c.{a}0 <= split_val::DOUBLE ELSE c.{a}1 > split_val::DOUBLE END)")
            if points:
                out.append(f"p{d + 1} AS MATERIALIZED (SELECT 2 * p.node_key + (p.{a} > split_val::DOUBLE)::BIGINT AS node_key, p.x, p.y, p.z FROM p{d} AS p JOIN l{d} AS l ON l.node_key = p.node_key WHERE NOT is_leaf)")
    union = " UNION ALL ".join(f"SELECT node_key, node_key // 2 AS parent_key, {d}::INT AS depth, CASE WHEN NOT is_leaf THEN {d % 3}::INT END AS split_dim, CASE WHEN NOT is_leaf THEN split_val END AS split_val, is_leaf, cell_count, {', '.join(BOX)} FROM l{d}" for d in range(MAX_DEPTH + 1))
    return ", ".join(out) + f" {union}"


def _strategy(strategy: str, points: bool = False) -> str:
    over = f", o AS (SELECT * FROM v WHERE value > {ISO})" if points else ""
    return f"WITH {VOLUME},{T6}, {CV}, {BOUNDS}, {HELD}{over}, {_levels(strategy, 'h', 256, 'o' if points else None)}"


LOCATED = f"lo AS MATERIALIZED (SELECT probe_id, max(node_key) AS leaf_key FROM pr JOIN nodes AS n ON is_leaf AND pr.x <= n.x1 AND pr.y <= n.y1 AND pr.z <= n.z1 AND (pr.x > n.x0 OR n.x0 = 0) AND (pr.y > n.y0 OR n.y0 = 0) AND (pr.z > n.z0 OR n.z0 = 0) WHERE pr.x BETWEEN 0 AND {SX} - 1 AND pr.y BETWEEN 0 AND 10 AND pr.z BETWEEN 0 AND 8 GROUP BY probe_id)"
GEOMETRY = "geo AS MATERIALIZED (SELECT cell_id, " + ", ".join(f"p{i}.{a}::DOUBLE AS {a}_{i}" for i in range(4) for a in "xyz") + ", " + ", ".join(f"p{i}.value AS val{i}" for i in range(4)) + " FROM t6 " + " ".join(f"JOIN v AS p{i} ON p{i}.point_id = v{i}" for i in range(4)) + ")"


def _tet(v: list[tuple[str, str, str]]) -> str:
    """Six times the signed volume."""
    a, b, c = ([f"({p} - {q})" for p, q in zip(v[k], v[0], strict=True)] for k in (1, 2, 3))
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) + {a[1]} * ({b[2]} * {c[0]} - {b[0]} * {c[2]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


def _sampled(name: str, probes: str) -> str:
    """probe_id, cell_id, sample: from the cell with the smallest id that holds a probe (probe_id, leaf_key, x, y, z)."""
    corners = [tuple(f"{a}_{i}" for a in "xyz") for i in range(4)]
    parts = [_tet([("x", "y", "z") if i == j else corners[j] for j in range(4)]) for i in range(4)]
    least, most = ({a: f"{f}({', '.join(f'{a}_{i}' for i in range(4))})" for a in "xyz"} for f in ("least", "greatest"))
    near = " AND ".join(f"{a} BETWEEN {least[a]} - 0.05 AND {most[a]} + 0.05" for a in "xyz")
    weights = ", ".join(f"{p} / {_tet(corners)} AS w{i}" for i, p in enumerate(parts))
    return f"""
{name}_c AS (SELECT probe_id, q.leaf_key, cell_id, {weights}, val0, val1, val2, val3 FROM {probes} AS q JOIN lc ON lc.leaf_key = q.leaf_key JOIN geo USING (cell_id) WHERE {near}),
{name} AS MATERIALIZED (SELECT probe_id, arg_min(cell_id, cell_id) AS cell_id, arg_min(w0 * val0 + w1 * val1 + w2 * val2 + w3 * val3, cell_id) AS sample FROM {name}_c WHERE {' AND '.join(f'w{i} >= -0.005' for i in range(4))} GROUP BY probe_id)"""


PLACED = "pl AS MATERIALIZED (SELECT pr.*, leaf_key FROM pr JOIN lo USING (probe_id))"
LEAF_CORNERS = f"""
cp AS (SELECT node_key * 8 + c AS probe_id, node_key AS leaf_key, c AS corner, CASE WHEN c & 1 > 0 THEN x1 ELSE x0 END AS x, CASE WHEN c & 2 > 0 THEN y1 ELSE y0 END AS y, CASE WHEN c & 4 > 0 THEN z1 ELSE z0 END AS z FROM nodes, range(8) AS r(c) WHERE is_leaf),
{_sampled('cs', 'cp')},
lcv AS MATERIALIZED (SELECT leaf_key, corner, coalesce(sample, 0) AS value FROM cp LEFT JOIN cs USING (probe_id))"""
NODE_CORNERS = """
dn AS (WITH RECURSIVE t(node_key, corner, cur, depth) AS (SELECT node_key, c::INT, node_key, depth FROM nodes, range(8) AS r(c)
  UNION ALL SELECT t.node_key, t.corner, 2 * t.cur + ((t.corner >> (t.depth % 3)) & 1), t.depth + 1 FROM t JOIN nodes AS n ON n.node_key = t.cur WHERE NOT n.is_leaf) SELECT * FROM t),
nc AS MATERIALIZED (SELECT dn.node_key, dn.corner, value FROM dn JOIN lcv ON lcv.leaf_key = dn.cur AND lcv.corner = dn.corner)"""
CORNERS = f"{FULL}, {GEOMETRY}, {LEAF_CORNERS}, {NODE_CORNERS}"


def _between(point: tuple[str, str, str], box: str, c: str) -> str:
    """Trilinear between the corners c[1] to c[8] of the box's columns."""
    x, y, z = (f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({p} - {box}.{a}0) / ({box}.{a}1 - {box}.{a}0)))" for a, p in zip("xyz", point, strict=True))
    mix = lambda a, b, t: f"({a} * (1 - {t}) + {b} * {t})"
    in_z = [mix(f"{c}[{i + 1}]", f"{c}[{i + 5}]", z) for i in range(4)]
    in_y = [mix(in_z[i], in_z[i + 2], y) for i in range(2)]
    return mix(in_y[0], in_y[1], x)


ARRAYS = "ca AS MATERIALIZED (SELECT node_key, list(value ORDER BY corner) AS c FROM nc GROUP BY node_key)"
VIEWS = f"vw AS (SELECT 1::BIGINT AS view_id, -20.0::DOUBLE AS ex, 5.0::DOUBLE AS ey, 4.0::DOUBLE AS ez, {ISO} AS iso UNION ALL SELECT 2, 60.0, 5.0, -9.0, 2 * {ISO})"


def _iso_score(lo: str, hi: str, least: str, most: str) -> str:
    return f"CASE WHEN {lo} <= iso AND iso <= {hi} THEN 1.0::DOUBLE WHEN {hi} < iso THEN 0.1::DOUBLE * ({hi} - {least}) / (iso - {least}) ELSE 0.1::DOUBLE * ({most} - {lo}) / ({most} - iso) END"


#: The views' matrix only divides by 60, so what lies beyond 60 along x is out of sight.
BOX_SCORE = "CASE WHEN n.x0 <= 60 THEN pow(greatest(n.x1 - n.x0, n.y1 - n.y0, n.z1 - n.z0), 2) / (((n.x0 + n.x1) / 2 - ex) * ((n.x0 + n.x1) / 2 - ex) + ((n.y0 + n.y1) / 2 - ey) * ((n.y0 + n.y1) / 2 - ey) + ((n.z0 + n.z1) / 2 - ez) * ((n.z0 + n.z1) / 2 - ez)) ELSE 0.0 END"
SCORES = f"{FULL}, {RANGES}, {VIEWS}, lim AS (SELECT min(value) AS a, max(value) AS b FROM v), sc AS MATERIALIZED (SELECT view_id, n.node_key, is_leaf, {BOX_SCORE} * {_iso_score('lo', 'hi', 'a', 'b')} AS score FROM nodes AS n JOIN nr ON nr.node_key = n.node_key, vw, lim)"
FRONT = "fe AS (SELECT node_key FROM nodes WHERE NOT is_leaf ORDER BY node_key LIMIT 6), fr AS MATERIALIZED (SELECT node_key FROM nodes WHERE node_key IN (SELECT 1 UNION SELECT 2 * node_key FROM fe UNION SELECT 2 * node_key + 1 FROM fe) AND node_key NOT IN (SELECT node_key FROM fe)), fs AS MATERIALIZED (SELECT sc.* FROM sc SEMI JOIN fr ON fr.node_key = sc.node_key)"
ORDERED = "o AS (SELECT *, translate(substr(bin(node_key), 2), '01', '10') AS path FROM nodes), p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path) - 1 AS this_ptr FROM o)"
#: Neighbours of an inner vertex in the order in which they are tried.
NEIGHBOURS = "[i + 1, i - 1, i + sx, i - sx, i + 11 * sx, i - 11 * sx]"
COLLAPSES = f"""
inn AS MATERIALIZED (SELECT point_id AS i, sx, {_number("'1'", 'point_id')} AS rank FROM v, gs WHERE x BETWEEN 1 AND sx - 2 AND y BETWEEN 1 AND 9 AND z BETWEEN 1 AND 7),
nb AS (SELECT i AS src, rank, unnest({NEIGHBOURS}) AS n, unnest([1, 2, 3, 4, 5, 6]) AS k FROM inn),
low AS (SELECT src, list(n ORDER BY k) AS lower FROM nb LEFT JOIN inn AS m ON m.i = nb.n WHERE coalesce(m.rank, -1) < nb.rank GROUP BY src),
pk AS (SELECT src, lower[{_number("'2'", 'src')} % len(lower) + 1] AS dst, row_number() OVER (ORDER BY {_number("'3'", 'src')}, src) AS r FROM low),
dm AS MATERIALIZED (SELECT src, dst FROM pk WHERE r <= round(99 * {SX} * 0.1)),
fol AS (WITH RECURSIVE f(src, cur) AS (SELECT src, dst FROM dm UNION ALL SELECT f.src, dm.dst FROM f JOIN dm ON dm.src = f.cur) SELECT * FROM f),
rm AS MATERIALIZED (SELECT src, cur AS dst FROM fol WHERE cur NOT IN (SELECT src FROM dm)),
cc AS MATERIALIZED (SELECT cell_id, {', '.join(f'coalesce(r{i}.dst, v{i}) AS v{i}' for i in range(4))} FROM t6 {' '.join(f'LEFT JOIN rm AS r{i} ON r{i}.src = v{i}' for i in range(4))}),
whole AS MATERIALIZED (SELECT * FROM cc WHERE len(list_distinct([v0, v1, v2, v3])) = 4)"""
GRID = f"{VOLUME},{T6}"


def _treelet(step: int) -> str:
    """Boxes and cells one level further down: tb (leaf_key, node_key, depth, box), tc (leaf_key, node_key, cell_id, box)."""
    axis = lambda b: {"x": 0, "y": 1, "z": 2}[b[0]]
    mid = "CASE depth % 3 WHEN 0 THEN (x0 + x1) / 2 WHEN 1 THEN (y0 + y1) / 2 ELSE (z0 + z1) / 2 END"
    box = ", ".join(f"CASE WHEN depth % 3 = {axis(b)} AND side = {int(b[1] == '0')} THEN s ELSE {b} END AS {b}" for b in BOX)
    pick = lambda i: f"CASE depth % 3 WHEN 0 THEN c.x{i} WHEN 1 THEN c.y{i} ELSE c.z{i} END"
    return f"""
ts{step} AS (SELECT *, ({mid})::FLOAT::DOUBLE AS s FROM tb{step}),
tb{step + 1} AS MATERIALIZED (SELECT leaf_key, 2 * node_key + side AS node_key, depth + 1 AS depth, {box} FROM ts{step}, {SIDES}),
tc{step + 1} AS MATERIALIZED (SELECT c.leaf_key, 2 * c.node_key + side AS node_key, cell_id, {', '.join(f'c.{b}' for b in BOX)} FROM tc{step} AS c JOIN (SELECT node_key, depth, s FROM ts{step}) AS t ON t.node_key = c.node_key, {SIDES} WHERE CASE WHEN side = 0 THEN {pick(0)} <= s ELSE {pick(1)} > s END)"""


def _treelet_nodes(step: int, last: bool) -> str:
    split = "NULL::FLOAT" if last else "(CASE depth % 3 WHEN 0 THEN (x0 + x1) / 2 WHEN 1 THEN (y0 + y1) / 2 ELSE (z0 + z1) / 2 END)::FLOAT"
    return f"SELECT leaf_key, node_key, depth, {split} AS split_val, coalesce(n, 0)::BIGINT AS cell_count, {', '.join(BOX)} FROM tb{step} LEFT JOIN (SELECT node_key, count(*) AS n FROM tc{step} GROUP BY node_key) AS q USING (node_key)"


TREELETS = f"{PART}, tb0 AS (SELECT node_key AS leaf_key, node_key, depth, {', '.join(BOX)} FROM nodes WHERE is_leaf), tc0 AS (SELECT leaf_key, leaf_key AS node_key, cell_id, {', '.join(BOX)} FROM lc JOIN h USING (cell_id)), {_treelet(0)}, {_treelet(1)}"
RANDOM = lambda k, seed: f"pr AS MATERIALIZED (SELECT node_key * {k} + i AS probe_id, node_key AS leaf_key, i::INT AS i, " + ", ".join(f"{a}0 + ({a}1 - {a}0) * {_unit(repr(str(seed)), 'node_key', 'i', repr(str(n)))} AS {a}" for n, a in enumerate("xyz")) + f" FROM nodes, range({k}) AS r(i) WHERE is_leaf)"
NEAREST = "nv AS MATERIALIZED (SELECT probe_id, arg_min(point_id, (d, point_id)) AS point_id, min(d) AS distance FROM (SELECT probe_id, bp.point_id, sqrt((q.x - v.x) * (q.x - v.x) + (q.y - v.y) * (q.y - v.y) + (q.z - v.z) * (q.z - v.z)) AS d FROM {0} AS q JOIN bp ON bp.leaf_key = q.leaf_key JOIN v ON v.point_id = bp.point_id) GROUP BY probe_id)"
FACES = [(a, i) for a in "xyz" for i in (1, 0)]


def _face(n: int, a: str, i: int) -> str:
    at = [(f"b.{a}1 + 0.1::DOUBLE" if i else f"b.{a}0 - 0.1::DOUBLE") if c == a else f"pl.{c}" for c in "xyz"]
    away = f"b.{a}1 - pl.{a}" if i else f"pl.{a} - b.{a}0"
    return f"SELECT pl.probe_id AS of_, {n} AS face, pl.leaf_key AS own, b.depth AS own_depth, {at[0]} AS x, {at[1]} AS y, {at[2]} AS z, 1 / greatest({away}, 0.01::DOUBLE) AS w FROM pl JOIN nodes AS b ON b.node_key = pl.leaf_key"


CONTINUOUS = f"""{CORNERS}, {ARRAYS}, {PROBES}, {LOCATED}, {PLACED},
fc AS MATERIALIZED ({' UNION ALL '.join(_face(n, a, i) for n, (a, i) in enumerate(FACES))}),
at_ AS (SELECT of_, face, max(node_key) AS near FROM fc JOIN nodes AS n ON is_leaf AND fc.x <= n.x1 AND fc.y <= n.y1 AND fc.z <= n.z1 AND (fc.x > n.x0 OR n.x0 = 0) AND (fc.y > n.y0 OR n.y0 = 0) AND (fc.z > n.z0 OR n.z0 = 0) WHERE fc.x BETWEEN 0 AND {SX} - 1 AND fc.y BETWEEN 0 AND 10 AND fc.z BETWEEN 0 AND 8 GROUP BY of_, face),
ch AS (SELECT fc.*, CASE WHEN n.depth > own_depth AND n.node_key % 3 <> 0 THEN n.node_key ELSE own END AS chosen FROM fc LEFT JOIN at_ USING (of_, face) LEFT JOIN nodes AS n ON n.node_key = near)"""


def _moved(i: int, a: str | None, by: float) -> str:
    return f"SELECT probe_id * 7 + {i} AS key, " + ", ".join(f"{c} + {by}::DOUBLE AS {c}" if c == a else c for c in "xyz") + " FROM pr"


def _shifted(moves: list[tuple[str, float]]) -> str:
    every = " UNION ALL ".join(_moved(i, *m) for i, m in enumerate([(None, 0.0), *moves]))
    raw = _trilinear("mv", "key").replace("round(sum(w * value), 6)", "sum(w * value)")
    columns = ", ".join(f"max(sample) FILTER (key % 7 = {i}) AS s{i}" for i in range(len(moves) + 1))
    return f"mv AS MATERIALIZED ({every}), ms AS ({raw}), sh AS (SELECT pr.probe_id, any_value(pr.x) AS x, any_value(pr.y) AS y, any_value(pr.z) AS z, {columns} FROM pr LEFT JOIN ms ON ms.key // 7 = pr.probe_id GROUP BY pr.probe_id)"


STEP = 2.0**-6
CAMERAS = "cm AS (SELECT s_suppkey AS camera_id, (s_suppkey % 7)::DOUBLE AS ox, (s_suppkey % 5)::DOUBLE AS oy, -20.0::DOUBLE AS oz, 0.0::DOUBLE AS ux, 1.0::DOUBLE AS uy, 0.0::DOUBLE AS uz, 1.0::DOUBLE AS rx, 0.0::DOUBLE AS ry, (s_suppkey % 3) / 10.0::DOUBLE AS rz, 1.0::DOUBLE AS fovx, 0.75::DOUBLE AS fovy FROM supplier)"
_TRI = "CASE WHEN t < 0.5 THEN {a} + ({b} - {a}) * 2 * t ELSE {b} + ({c} - {b}) * (2 * t - 1) END"
RAYS = f"ry AS (SELECT p_partkey AS ray_id, (p_partkey % 60 - 5)::DOUBLE AS ox, (p_partkey % 13 - 1)::DOUBLE AS oy, -4.0::DOUBLE AS oz, (p_partkey % 3 - 1)::DOUBLE AS dx, (p_partkey % 2)::DOUBLE AS dy, 0.5::DOUBLE AS dz FROM part)"


def _slab(a: str, high: str) -> str:
    t = [f"(0 - o{a}) / d{a}", f"({high} - o{a}) / d{a}"]
    between = f"o{a} BETWEEN 0 AND {high}"
    inf = "'infinity'::DOUBLE"
    return f"CASE WHEN d{a} = 0 THEN CASE WHEN {between} THEN -{inf} ELSE {inf} END ELSE least({t[0]}, {t[1]}) END AS n{a}, CASE WHEN d{a} = 0 THEN CASE WHEN {between} THEN {inf} ELSE -{inf} END ELSE greatest({t[0]}, {t[1]}) END AS f{a}"


SQL = {
    "vert_median_nodes": _strategy("median", True),
    "vert_average_nodes": _strategy("average", True),
    "surface_area_nodes": _strategy("surface"),
    "volume_heuristic_nodes": _strategy("volume"),
    "decimation_map": f"WITH {GRID}, {COLLAPSES} SELECT src, dst, b.value - a.value AS change FROM dm JOIN v AS a ON a.point_id = src JOIN v AS b ON b.point_id = dst",
    "resolved_map": f"WITH {GRID}, {COLLAPSES} SELECT src, dst, b.value - a.value AS change FROM rm JOIN v AS a ON a.point_id = src JOIN v AS b ON b.point_id = dst",
    "decimate": f"WITH {GRID}, {COLLAPSES} SELECT cell_id, v0, v1, v2, v3, a.value + b.value + c.value + d.value AS total FROM whole JOIN v a ON a.point_id = v0 JOIN v b ON b.point_id = v1 JOIN v c ON c.point_id = v2 JOIN v d ON d.point_id = v3",
    "removed_share": f"WITH {GRID}, {COLLAPSES} SELECT (SELECT count(*) FROM cc) AS cells, (SELECT count(*) FROM cc) - (SELECT count(*) FROM whole) AS removed, round(1 - (SELECT count(*) FROM whole)::DOUBLE / (SELECT count(*) FROM cc), 9) AS share",
    "corner_values": f"WITH {CORNERS} SELECT node_key, 'count' AS name, corner, round(value, 6) AS value FROM nc",
    "sample_cells": f"WITH {FULL}, {PROBES}, {LOCATED}, {PLACED}, {GEOMETRY}, {_sampled('sm', 'pl')} SELECT probe_id, cell_id, round(sample, 6) AS sample FROM sm",
    "nearest_vertex": f"WITH {FULL}, {BLOCKS}, {PROBES}, {LOCATED}, {PLACED}, {NEAREST.format('pl')} SELECT probe_id, point_id, round(distance, 6) AS distance FROM nv",
    "sample_or_nearest": f"WITH {PART}, {BLOCKS}, {PROBES}, {LOCATED}, {PLACED}, {GEOMETRY}, {_sampled('sm', 'pl')}, {NEAREST.format('pl')} SELECT pr.probe_id, 'count' AS name, round(coalesce(sample, value, 0), 6) AS sample, CASE WHEN sample IS NOT NULL THEN 'cell' WHEN value IS NOT NULL THEN 'vertex' ELSE 'none' END AS found FROM pr LEFT JOIN sm USING (probe_id) LEFT JOIN nv USING (probe_id) LEFT JOIN v ON v.point_id = nv.point_id",
    "locate_leaves": f"WITH {PART}, {ORDERED}, {PROBES}, {LOCATED}, li AS (SELECT node_key, row_number() OVER (ORDER BY this_ptr) - 1 AS leaf_index FROM p WHERE is_leaf) SELECT pr.probe_id, lo.leaf_key, depth, cell_count, leaf_index, x0, y0, z0, x1, y1, z1 FROM pr LEFT JOIN lo USING (probe_id) LEFT JOIN nodes ON node_key = leaf_key LEFT JOIN li USING (node_key)",
    "leaf_index": f"WITH {PART}, {ORDERED} SELECT node_key, this_ptr, row_number() OVER (ORDER BY this_ptr) - 1 AS leaf_index FROM p WHERE is_leaf",
    "rebuilt_nodes": f"WITH {PART}, {ORDERED} SELECT node_key, this_ptr, depth, is_leaf, {', '.join(BOX)} FROM p",
    "treelets": f"WITH {TREELETS} {_treelet_nodes(1, False)} UNION ALL {_treelet_nodes(2, True)}",
    "random_points": f"WITH {PART}, {RANDOM(3, 1)} SELECT probe_id, leaf_key, i, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pr",
    "random_vertices": f"WITH {PART}, {BLOCKS}, n AS (SELECT leaf_key, floor(count(*) * {_unit(repr('1'), 'leaf_key')})::BIGINT AS local_id FROM bp GROUP BY leaf_key) SELECT leaf_key, local_id, point_id FROM bp JOIN n USING (leaf_key, local_id)",
    "sampled_averages": f"WITH {FULL}, {BLOCKS}, {RANDOM(10, 1)}, {GEOMETRY}, {_sampled('sm', 'pr')}, {NEAREST.format('pr')}, la AS (SELECT leaf_key, avg(coalesce(sample, value, 0)) AS average FROM pr LEFT JOIN sm USING (probe_id) LEFT JOIN nv USING (probe_id) LEFT JOIN v ON v.point_id = nv.point_id GROUP BY leaf_key), w AS (SELECT la.*, (x1 - x0) * (y1 - y0) * (z1 - z0) AS vol FROM la JOIN nodes ON node_key = leaf_key) SELECT leaf_key >> k AS node_key, 'count' AS name, round(sum(average * vol) / sum(vol), 5) AS average FROM w, range(8) AS r(k) WHERE leaf_key >> k > 0 GROUP BY ALL",
    "node_interpolation": f"WITH {CORNERS}, {ARRAYS}, {PROBES}, {LOCATED}, {PLACED} SELECT probe_id, 'count' AS name, round({_between(('pl.x', 'pl.y', 'pl.z'), 'n', 'ca.c')} + 1e-7, 4) AS sample FROM pl JOIN nodes AS n ON n.node_key = leaf_key JOIN ca ON ca.node_key = leaf_key",
    "continuous_values": f"WITH {CONTINUOUS} SELECT of_ AS probe_id, 'count' AS name, round(sum(w * {_between(('ch.x', 'ch.y', 'ch.z'), 'n', 'ca.c')}) / sum(w) + 1e-7, 4) AS sample FROM ch JOIN nodes AS n ON n.node_key = chosen JOIN ca ON ca.node_key = chosen GROUP BY of_",
    "frontier_corners": f"WITH {CORNERS}, {ARRAYS}, {FRONT.split(', fs AS')[0]} SELECT node_key, list_transform(c, lambda e: round(e, 6)) AS corners FROM ca SEMI JOIN fr ON fr.node_key = ca.node_key",
    "derivative_points": f"WITH {VOLUME}, {PROBES}, {_shifted([('x', STEP), ('x', -STEP)])} SELECT probe_id, round(coalesce((s1 - s0) / {STEP}, (s0 - s2) / {STEP}, 0), 6) AS d FROM sh",
    "gradient_points": f"WITH {VOLUME}, {PROBES}, {_shifted([(a, s * 0.5) for a in 'xyz' for s in (-1, 1)])} SELECT probe_id, {', '.join(f'round((CASE WHEN {a} > 0.5 THEN s{2 * i + 1} - s0 ELSE s0 - s{2 * i + 2} END) / 0.5, 6) AS g{a}' for i, a in enumerate('xyz'))} FROM sh",
    "points_in_box": f"WITH {VOLUME}, {PROBES} SELECT probe_id FROM pr WHERE x BETWEEN ({SX} - 1) / 4.0 AND 3 * ({SX} - 1) / 4.0 AND y BETWEEN 2.5 AND 7.5 AND z BETWEEN 2 AND 6",
    "overlapping_boxes": f"WITH {PART}, {PROBES} SELECT probe_id AS left_id, node_key AS right_id FROM pr JOIN nodes AS n ON is_leaf AND pr.x - 0.5 <= n.x1 AND n.x0 <= pr.x + 0.5 AND pr.y - 0.5 <= n.y1 AND n.y0 <= pr.y + 0.5 AND pr.z - 0.5 <= n.z1 AND n.z0 <= pr.z + 0.5",
    "leaf_colours": f"WITH {PART}, t AS (SELECT node_key, least(1.0::DOUBLE, cell_count / 128.0::DOUBLE) AS t FROM nodes WHERE is_leaf) SELECT node_key, round({_TRI.format(a=0, b=1, c=1)}, 6) AS red, round({_TRI.format(a=0, b=1, c=0)}, 6) AS green, round({_TRI.format(a=1, b=1, c=0)}, 6) AS blue FROM t",
    "camera_rays": f"WITH {CAMERAS}, r AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS rn, uy * rz - uz * ry AS fx, uz * rx - ux * rz AS fy, ux * ry - uy * rx AS fz FROM cm), f AS (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS fn FROM r), g AS (SELECT *, p % 8 AS px, p // 8 AS py, 2 * (p % 8 + 0.5::DOUBLE) / 8 - 1 AS across, 2 * (p // 8 + 0.5::DOUBLE) / 6 - 1 AS down FROM f, range(48) AS q(p)), d AS (SELECT *, {', '.join(f'f{a} / fn + across * tan(fovy / 2) * fovx / fovy * r{a} / rn - down * tan(fovy / 2) * u{a} AS d{a}' for a in 'xyz')} FROM g) SELECT camera_id, px::INT AS px, py::INT AS py, ox, oy, oz, {', '.join(f'round(d{a} / sqrt(dx * dx + dy * dy + dz * dz), 6) AS d{a}' for a in 'xyz')} FROM d",
    "ray_intervals": f"WITH {VOLUME}, {RAYS}, t AS (SELECT ray_id, {_slab('x', f'({SX} - 1)')}, {_slab('y', '10')}, {_slab('z', '8')} FROM ry), u AS (SELECT ray_id, greatest(nx, ny, nz) AS near, least(fx, fy, fz) AS far FROM t) SELECT ray_id, round(near, 6) AS near, round(far, 6) AS far FROM u WHERE near <= far AND far >= 0",
    "node_scores": f"WITH {SCORES} SELECT view_id, node_key, is_leaf, round(score, 9) AS score FROM sc",
    "axis_scores": f"WITH {FULL}, {VIEWS} SELECT view_id, n.node_key, n.is_leaf, round({BOX_SCORE} * {_iso_score('n.y0', 'n.y1', '0', '10')}, 9) AS score FROM nodes AS n, (SELECT view_id, ex, ey, ez, view_id * 3.0::DOUBLE AS iso FROM vw)",
    "sorted_scores": f"WITH {SCORES}, {FRONT} SELECT view_id, node_key, round(score, 9) AS score, row_number() OVER (PARTITION BY view_id ORDER BY score, node_key)::INT AS place FROM fs",
    "frontier_depth_first": f"WITH {PART}, {ORDERED}, e AS (SELECT node_key FROM p WHERE NOT is_leaf ORDER BY this_ptr LIMIT 3), f AS (SELECT 1 AS node_key UNION SELECT 2 * node_key FROM e UNION SELECT 2 * node_key + 1 FROM e) SELECT node_key, is_leaf FROM nodes WHERE node_key IN (SELECT node_key FROM f) AND node_key NOT IN (SELECT node_key FROM e)",
    "frontier_step": f"""WITH {SCORES}, {FRONT}, rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, node_key) AS place FROM fs),
sp AS MATERIALIZED (SELECT view_id, node_key, place FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY place) AS r FROM rk WHERE NOT is_leaf) WHERE r <= 1),
pa AS (SELECT view_id, node_key // 2 AS parent_key, min(place) AS best, max(place) AS worst FROM rk WHERE node_key > 1 GROUP BY ALL HAVING count(*) = 2),
mg AS (SELECT view_id, parent_key FROM (SELECT pa.*, row_number() OVER (PARTITION BY pa.view_id ORDER BY worst DESC) AS r FROM pa JOIN sp USING (view_id) WHERE best > sp.place AND parent_key <> sp.node_key // 2) WHERE r <= 1),
ok AS (SELECT sp.view_id, sp.node_key, mg.parent_key FROM sp JOIN mg USING (view_id)),
gone AS (SELECT view_id, node_key FROM ok UNION ALL SELECT view_id, unnest([2 * parent_key, 2 * parent_key + 1]) FROM ok)
SELECT view_id, node_key, 'NONE' AS state FROM fs ANTI JOIN gone USING (view_id, node_key) UNION ALL SELECT view_id, unnest([2 * node_key, 2 * node_key + 1]), 'SPLIT' FROM ok UNION ALL SELECT view_id, parent_key, 'MERGED' FROM ok""",
    "blocks_to_load": f"WITH {SCORES}, fa AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, node_key) AS r FROM sc WHERE is_leaf AND score > 0 AND node_key % 2 = 0) SELECT view_id, node_key AS leaf_key, round(score, 9) AS score FROM fa WHERE r <= 10 AND NOT (view_id = 1 AND node_key % 5 = 0)",
    "resident_scores": f"WITH {SCORES}, {FRONT} SELECT 1::BIGINT AS view_id, n.node_key AS leaf_key, coalesce(round(fs.score, 9), '-infinity'::DOUBLE) AS score FROM nodes AS n LEFT JOIN fs ON fs.node_key = n.node_key AND fs.view_id = 1 WHERE n.is_leaf",
    "states_reset": f"WITH {PART}, {FRONT.split(', fs AS')[0]} SELECT view_id::BIGINT AS view_id, node_key, CASE WHEN view_id = 1 THEN 'SPLIT' ELSE 'NONE' END AS state FROM fr, (VALUES (1), (2)) AS w(view_id)",
    "padded_positions": f"WITH {PART}, {BLOCKS} SELECT leaf_key, (3 * (SELECT max(verts) FROM bs))::INT AS length, sum((local_id * 3 + 1) * x + (local_id * 3 + 2) * y + (local_id * 3 + 3) * z)::DOUBLE AS total FROM bp JOIN v USING (point_id) GROUP BY leaf_key",
    "padded_values": f"WITH {PART}, {BLOCKS} SELECT leaf_key, 'count' AS name, (SELECT max(verts) FROM bs)::INT AS length, sum((local_id + 1) * value)::DOUBLE AS total FROM bp JOIN v USING (point_id) GROUP BY leaf_key",
    "block_requests": f"WITH {FULL}, {BLOCKS}, r AS (SELECT c_custkey AS leaf_key FROM customer), rb AS (SELECT (row_number() OVER (ORDER BY leaf_key) - 1) // 1000 AS batch FROM r) SELECT batch, count(*) AS blocks, (count(*) * 4 * (3 * (SELECT max(verts) FROM bs) + 4 * (SELECT max(cells) FROM bs) + 2 * (SELECT max(verts) FROM bs)))::BIGINT AS bytes FROM rb GROUP BY batch",
    "interior_vertices": f"WITH {PART}, {BLOCKS} SELECT leaf_key, count(*) FILTER (v.x BETWEEN x0 AND x1 AND v.y BETWEEN y0 AND y1 AND v.z BETWEEN z0 AND z1) AS interior FROM bp JOIN v USING (point_id) JOIN nodes ON node_key = leaf_key GROUP BY leaf_key",
    "function_volume": f"WITH {VOLUME}, m AS (SELECT *, greatest(0.0::DOUBLE, 20 - x + 0.5::DOUBLE * y * z) AS f FROM v) SELECT x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, f AS value, f - value AS over FROM m",
    "unstructured": f"WITH {VOLUME} SELECT x::DOUBLE * 2 AS x, y::DOUBLE * 0.5::DOUBLE AS y, z::DOUBLE AS z, point_id, value FROM v",
    "axis_limits": f"WITH {VOLUME}, q AS (SELECT * FROM v WHERE value > {ISO}) " + " UNION ALL ".join(f"SELECT '{a}' AS name, min({a})::DOUBLE AS lo, max({a})::DOUBLE AS hi FROM q" for a in "xyz"),
    "size_labels": f"WITH {GRID}, {CV}, {BOUNDS}, {HELD} SELECT {SX} || 'x11x9' AS structured, (SELECT count(*) FROM h) || ' u' AS unstructured",
    "scalar_choices": "WITH k AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1) SELECT 'all' AS choice, name, n FROM k UNION ALL SELECT 'first', name, n FROM k WHERE name = (SELECT min(name) FROM k)",
    "plane_sides": f"WITH {VOLUME},{T6}, {CV}, {BOUNDS}, m AS (SELECT floor(4 * sum(x * value) / sum(value)) / 4 AS p FROM v) SELECT cell_id, (CASE WHEN x0 <= p THEN 1 ELSE 0 END + CASE WHEN x1 > p THEN 2 ELSE 0 END)::INT AS side FROM b, m",
    "derived_limits": f"WITH {VOLUME}, f AS (SELECT sqrt(value * value + x * x::DOUBLE + z * z * value * value) AS m FROM v) SELECT 'magnitude' AS name, round(min(m), 6) AS lo, round(max(m), 6) AS hi FROM f",
    "ingest": f"""WITH {VOLUME}, s AS (SELECT sx // 2 AS n FROM gs), d AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, value FROM v, s WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0 AND x < 2 * n AND y < 10 AND z < 8)
SELECT (SELECT count(*) FROM d) AS points, (SELECT (n - 1) * 4 * 3 * 5 FROM s)::BIGINT AS cells, min(value) AS lo, max(value) AS hi FROM d""",
}
