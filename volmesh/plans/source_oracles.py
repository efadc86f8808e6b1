"""DuckDB SQL for the queries that write files and read them back."""

from __future__ import annotations

from volmesh.plans.oracles import ISO, SX, SQL as _SQL, T6, VOLUME

SQL = {
    "raw_slabs": f"WITH {VOLUME} SELECT x, y, z, value::FLOAT AS value FROM v WHERE z BETWEEN 2 AND 5 AND value > {ISO}",
    "mesh_file": f"WITH {VOLUME},{T6} SELECT cell_id, v0, v1, v2, v3, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM t6 JOIN v ON point_id = v0",
    "volume_steps": f"""WITH {VOLUME}, n AS (SELECT l_linenumber - 1 AS t, ((l_quantity - 1)::INT * k + l_partkey % k)::BIGINT + {SX} * (round(l_discount * 100)::INT + 11 * round(l_tax * 100)::INT) AS point_id, count(*) AS n FROM lineitem, gs GROUP BY ALL)
SELECT s.t::INT AS t, v.point_id, 'lines' AS name, coalesce(n.n, 0)::DOUBLE AS value FROM range(2, 5) AS s(t) CROSS JOIN v LEFT JOIN n ON n.t = s.t AND n.point_id = v.point_id""",
    "stored_blocks": _SQL["block_cells"],
}
