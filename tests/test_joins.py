"""Joins and searches whose tables grow with the mesh."""

from pyspark.sql import functions as F

from volmesh import registry
from volmesh.common import shuffled
from volmesh.operators import blocks, mesh, probe, sampling, structured, tree
from volmesh.plans import fixtures

SIZE = (6, 5, 4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast(spark):
    points = structured.grid_points(spark, SIZE)
    cells = structured.grid_tets(spark, SIZE).select("cell_id", *mesh.VERTICES)
    volume = points.select("x", "y", "z", F.col("x").alias("value"))
    rays = spark.range(5).select(F.col("id").alias("ray_id"), *(F.lit(v).alias(n) for n, v in {"ox": 0.0, "oy": 1.0, "oz": 0.0, "dx": 1.0, "dy": 0.0, "dz": 0.1}.items()))
    steps = probe.steps(rays, ((0.0,) * 3, tuple(s - 1.0 for s in SIZE)), 1.0)
    boxes = spark.range(40).select("id", *((F.col("id") * (i + 1) % 5 / 2.0 + side).alias(f"{a}{side}") for i, a in enumerate("xyz") for side in (0, 1)))
    _, leaf_cells = tree.build_tree(structured.grid_cell_bounds(spark, SIZE), ((0.0,) * 3, tuple(s - 1.0 for s in SIZE)), max_cells=64, max_depth=4)
    long = cells.select("cell_id", F.explode(F.array(*mesh.VERTICES)).alias("point_id"))
    made = {
        "line_probe": structured.trilinear(steps, volume, SIZE), "overlapping_boxes": sampling.overlapping(boxes, boxes), "leaf_values": leaf_cells.join(long, "cell_id"),
        "mesh_gradients": sampling.geometry_of(cells, points), "cell_bounds": mesh.cell_bounds(cells, points), "cell sums": shuffled(long).join(points, "point_id"),
    }
    assert [name for name, df in made.items() if "Broadcast" in plan_of(df)] == []


def _leaf(spark, n):
    """n cells in a row in one leaf."""
    points = structured.grid_points(spark, (n, 2, 2))
    cells = structured.grid_tets(spark, (n, 2, 2)).select("cell_id", *mesh.VERTICES)
    return cells.select(F.lit(1).cast("long").alias("leaf_key"), "cell_id"), sampling.geometry_of(cells, points)


def test_cells_meet_probes_in_grids_within_a_leaf(spark):
    leaf_cells, geometry = _leaf(spark, 2)
    assert "at_x" in plan_of(sampling.containing_cell(spark.createDataFrame([(1, 1, 0.5, 0.5, 0.5)], "probe_id long, leaf_key long, x double, y double, z double"), leaf_cells, geometry)).split("SortMergeJoin")[1].split("\n")[0]


def test_nearest_vertices_against_all_pairs(spark):
    leaf_cells, geometry = _leaf(spark, 12)
    rows = [(i, 1 if i % 9 else 2, (i * 7 % 40) / 2.0 - 5, (i % 11) - 4.0, (i * i % 60) / 4.0) for i in range(120)] + [(500, 1, 900.0, 0.5, -700.0), (501, 1, 0.5, 0.5, 0.5), (502, None, 1.0, 1.0, 1.0)]
    probes = spark.createDataFrame(rows, "probe_id long, leaf_key long, x double, y double, z double")
    got = {r.probe_id: (r.point_id, round(r.distance, 9)) for r in sampling.nearest_in_leaf(probes, leaf_cells, geometry).collect()}
    vertices = [(x + 12 * y + 24 * z, (x, y, z)) for x in range(12) for y in range(2) for z in range(2)]
    want = {}
    for i, leaf, *p in rows:
        if leaf == 1:
            d, point = min((sum((a - b) ** 2 for a, b in zip(p, v, strict=True)) ** 0.5, k) for k, v in vertices)
            want[i] = point, round(d, 9)
    assert got == want


def test_the_removed_share_is_of_all_cells(spark):
    folder = "/root/testdata/sf0.001"
    sx, sy, sz = fixtures.size(spark, folder)
    row = registry.removed_share(spark, folder).first()
    assert row.cells == 6 * (sx - 1) * (sy - 1) * (sz - 1) and 0 < row.removed < row.cells


def test_blocks_are_ranked_in_buckets(spark, monkeypatch):
    leaf_cells, _ = _leaf(spark, 9)
    cells = structured.grid_tets(spark, (9, 2, 2)).select("cell_id", *mesh.VERTICES)
    monkeypatch.setattr(blocks, "RANKED", 7)
    points, local = blocks.split_blocks(leaf_cells, cells)
    assert "[leaf_key#" in plan_of(points) and "bucket#" in [line for line in plan_of(points).split("\n") if "Window [row_number" in line][0]
    order, want = {}, []
    for r in sorted(cells.collect()):
        want.append(tuple(order.setdefault(v, len(order)) for v in r[1:]))
    assert {r.point_id: r.local_id for r in points.collect()} == order
    assert [tuple(r[2:]) for r in sorted(local.collect())] == want and sorted(r.local_cell for r in local.collect()) == list(range(len(want)))
