"""Invariants of mesh jobs on small grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.functions import geometry as geo
from volmesh.operators import fields, lod, mesh, nodevalues, probe, reports, sampling, structured, tree
from volmesh.sources import binary

SIZE = (4, 4, 4)
BOX = ((0.0, 0.0, 0.0), (3.0, 3.0, 3.0))


@pytest.fixture(scope="module")
def grid(spark):
    points = structured.grid_points(spark, SIZE)
    values = points.select("point_id", F.lit("f").alias("name"), (1 + 2 * F.col("x") + 3 * F.col("y") + 5 * F.col("z")).alias("value"))
    return points, structured.grid_tets(spark, SIZE).select("cell_id", *mesh.VERTICES), values


@pytest.mark.parametrize("tets", [5, 6])
def test_tetrahedra_fill_a_cube(spark, tets):
    points = {r.point_id: np.array([r.x, r.y, r.z]) for r in structured.grid_points(spark, (2, 2, 2)).collect()}
    volumes = [abs(np.linalg.det([points[r[f"v{i}"]] - points[r.v0] for i in (1, 2, 3)])) / 6 for r in structured.grid_tets(spark, (2, 2, 2), tets).collect()]
    assert len(volumes) == tets and sum(volumes) == pytest.approx(1)


def test_analytic_bounds_are_the_joined_ones(spark, grid):
    points, cells, _ = grid
    assert structured.grid_cell_bounds(spark, SIZE).exceptAll(mesh.cell_bounds(cells, points)).count() == 0


def test_plane_side(spark):
    # The plane x = -1 lies below a cell from 0 to 1: right only.
    assert spark.range(1).select(geo.plane_side(F.lit(0.0), F.lit(1.0), F.lit(-1.0))).first()[0] == 2


@pytest.mark.parametrize("strategy", [tree.NODE_MEDIAN, tree.VERT_MEDIAN, tree.VERT_AVERAGE, tree.SURFACE_AREA, tree.VOLUME])
def test_trees_hold_every_cell_and_tile_the_box(spark, grid, strategy):
    nodes, leaf_cells = tree.build_tree(structured.grid_cell_bounds(spark, SIZE), BOX, strategy, 40, 6, grid[0])
    assert leaf_cells.select("cell_id").distinct().count() == grid[1].count()
    low, high = tuple(F.col(c) for c in geo.LOW), tuple(F.col(c) for c in geo.HIGH)
    assert nodes.where("is_leaf").agg(F.sum(geo.box_volume(low, high))).first()[0] == pytest.approx(27)
    assert leaf_cells.count() == nodes.where("is_leaf").agg(F.sum("cell_count")).first()[0]


def test_linear_field_is_exact(spark, grid):
    points, cells, values = grid
    nodes, leaf_cells = tree.build_tree(structured.grid_cell_bounds(spark, SIZE), BOX, tree.NODE_MEDIAN, 40, 6)
    probes = spark.createDataFrame([(i, i * 0.37 % 3, i * 0.71 % 3, i * 0.13 % 3) for i in range(40)] + [(99, 5.0, 0.0, 0.0)], "probe_id long, x double, y double, z double")
    at = sampling.locate(probes, nodes)
    assert at.where("leaf_key IS NULL").count() == 1
    shapes = sampling.geometry_of(cells, points)
    held = sampling.containing_cell(at, leaf_cells, shapes)
    got = sampling.sampled(held, values).join(probes, "probe_id").collect()
    assert len(got) == 40
    assert all(r["sample"] == pytest.approx(1 + 2 * r.x + 3 * r.y + 5 * r.z) for r in got)
    corners = nodevalues.corner_values(nodes, nodevalues.leaf_corners(nodes.where("is_leaf"), leaf_cells, shapes, values))
    rows = corners.join(nodes, "node_key").collect()
    assert len(rows) == 8 * nodes.count()
    for r in rows:
        x, y, z = (r[f"{a}{r.corner >> i & 1}"] for i, a in enumerate("xyz"))
        assert r.value == pytest.approx(1 + 2 * x + 3 * y + 5 * z)


def test_decimation_has_no_cycles(spark):
    found = structured.decimation_map(spark, (6, 6, 6), 0.2)
    moved = structured.resolved_map(found)
    assert found.count() == 43 and moved.count() == 43
    assert moved.join(found.select(F.col("src").alias("dst")), "dst", "left_semi").count() == 0


def test_mirror_twice_is_identity(spark, grid):
    points, cells, values = grid
    once, _, _ = mesh.mirrored(points, cells, values, {"x": 1.5})
    assert once.count() == 2 * points.count()
    images = once.where(F.col("point_id") >= points.count()).select("x", "y", "z")
    assert images.exceptAll(points.select("x", "y", "z")).count() == 0


def test_flow_fields(spark):
    flow = structured.grid_points(spark, (5, 5, 5)).select("x", "y", "z", F.col("y").alias("vx"), (-F.col("x")).alias("vy"), F.lit(0.0).alias("vz"), F.lit(4.0).alias("sound2"))
    out = fields.derive(flow, ["divergence", "vorticity", "q_criterion", "mach"]).collect()
    assert all(r.divergence == 0 and r.vorticity == 2 and r.q_criterion == 1 for r in out)
    assert all(r.mach == pytest.approx(np.hypot(r.x, r.y) / 2) for r in out)
    assert fields.possible(["vx", "vy", "vz"]) == ["magnitude", "divergence", "vorticity", "q_criterion"]


def test_iso_crossing_and_budget(spark):
    line = spark.range(5).select(F.lit(1).alias("ray_id"), F.col("id").cast("int").alias("step"), F.col("id").cast("double").alias("value"))
    r = probe.first_crossing(line, 2.5, 1.0).first()
    assert (r.direction, r.t) == (1, 2.5)
    assert [mesh.as_absolute(v, 1000) for v in ("30%", 5000, -1)] == [300, 1000, 0]


def test_frontier_holds_its_budget(spark):
    nodes, _ = tree.build_tree(structured.grid_cell_bounds(spark, SIZE), BOX, tree.NODE_MEDIAN, 20, 6)
    for budget in (1, 3, 4, 7, 12):
        n = lod.frontier(nodes, budget).count()
        assert n == 1 + max(0, -(-(budget - 3) // 2)) <= max(1, budget)


def test_late_metrics_win(spark):
    rows = [(1, f, "gpu", float(f), f) for f in range(1, 2003)] + [(1, 2000, "gpu", -5.0, 9999)]
    out = reports.frame_table(spark.createDataFrame(rows, "run_id long, frame_num long, metric string, value double, seq long"), ["gpu"])
    assert out.count() == 2000 and out.where("frame_num = 2000").first().gpu == -5.0


def test_binary_readers(spark, tmp_path):
    raw = np.arange(24, dtype="<i2")
    raw.tofile(tmp_path / "v.raw")
    got = {(r.x, r.y, r.z): r.value for r in binary.read_raw_volume(spark, str(tmp_path / "v.raw"), "<i2", (2, 3, 4)).collect()}
    assert got[1, 2, 3] == 23 and got[1, 0, 0] == 1 and len(got) == 24
    points = np.array([[x, y, z] for z in (0, 1) for y in (0, 1) for x in (0, 1)], "<f4")
    tets = np.array(structured.SIX_TETS, "<i4") + 1
    (tmp_path / "m.ugrid").write_bytes(np.array([8, 1, 0, 6, 0, 0, 0], "<i4").tobytes() + points.tobytes() + np.array([1, 2, 3, 7], "<i4").tobytes() + tets.tobytes())
    p, c, e = binary.read_ugrid(spark, str(tmp_path / "m.ugrid"))
    assert p.count() == 8 and e.count() == 7
    assert sorted(tuple(r)[1:] for r in c.collect()) == sorted(structured.SIX_TETS)
    data = np.arange(16, dtype="<f4").reshape(8, 2)
    (tmp_path / "d.bin").write_bytes(np.array([binary.VOLUME_DATA_MAGIC, 1, 2, 8], "<i4").tobytes() + b"".join(np.array([t], "<i4").tobytes() + (data + t).tobytes() for t in (0, 1)))
    d = binary.read_volume_data(spark, str(tmp_path / "d.bin"), ["a", "b"])
    assert d.count() == 32 and d.where("t = 1 AND point_id = 3 AND name = 'b'").first().value == 8
