"""Rays that end early are sampled in rounds of steps, from cells near the steps alone."""

import pytest
from pyspark.sql import functions as F

from volmesh.operators import mesh, meshrays, nodevalues, probe, sampling, structured, tree

SIZE, BOX, LENGTH = (40, 3, 3), ((0.0,) * 3, (39.0, 2.0, 2.0)), 0.5
RAYS = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


@pytest.fixture(scope="module")
def world(spark):
    cells = structured.grid_tets(spark, SIZE).select("cell_id", *mesh.VERTICES)
    nodes, leaf_cells = tree.build_tree(structured.grid_cell_bounds(spark, SIZE), BOX, tree.NODE_MEDIAN, 200, 4)
    rays = spark.createDataFrame([(1, -1.0, 0.7, 0.6, 1.0, 0.0, 0.0), (2, 40.0, 1.2, 0.4, -1.0, 0.01, 0.02), (3, -1.0, 0.7, 0.6, 1.0, 0.0, 0.0), (4, 5.5, -1.0, 1.0, 0.1, 1.0, 0.0), (5, 0.0, 9.0, 9.0, 1.0, 0.0, 0.0)], RAYS)
    return nodes.cache(), leaf_cells.cache(), structured.grid_geometry(spark, SIZE).cache(), rays, cells


def values(spark, of):
    x = F.col("point_id") % SIZE[0]
    return structured.grid_points(spark, SIZE).select("point_id", F.lit("f").alias("name"), of(x).cast("double").alias("value"))


def test_geometry_of_a_grid_is_that_of_its_cells(spark, world):
    found = sampling.geometry_of(world[4], structured.grid_points(spark, SIZE))
    assert sorted(map(tuple, world[2].collect())) == sorted(map(tuple, found.collect()))


def test_only_cells_near_probes_are_taken(spark, world):
    _, leaf_cells, geometry, _, _ = world
    leaf = leaf_cells.first().leaf_key
    probes = spark.createDataFrame([(1, leaf, 0.5, 0.25, 0.75), (2, leaf, 2.0, 1.0, 1.0)], "probe_id long, leaf_key long, x double, y double, z double")
    near = sampling.near_cells(probes, geometry, sampling.cell_levels(geometry))
    assert 0 < near.count() < geometry.count() / 4
    whole, few = (sorted(map(tuple, sampling.containing_cell(probes, leaf_cells, g).collect())) for g in (geometry, near))
    assert whole == few


@pytest.mark.parametrize(("of", "ends"), [(lambda x: 6 + x % 3, True), (lambda x: F.when(x < 12, 6).otherwise(-3), False)])
def test_light_ends_where_nothing_more_can_be_seen(spark, world, monkeypatch, of, ends):
    nodes, leaf_cells, geometry, rays, _ = world
    field = values(spark, of)
    want = {r.ray_id: (round(r.light, 6), round(r.transmittance, 9)) for r in probe.gathered(meshrays.line_samples(rays, nodes, leaf_cells, geometry, field, LENGTH), LENGTH, 48.0).collect()}
    taken, samples = [], meshrays._samples

    def counting(steps, *rest):
        taken.append(steps.agg(F.sum(F.size("steps"))).first()[0] or 0)
        return samples(steps, *rest)

    monkeypatch.setattr(meshrays, "_samples", counting)
    monkeypatch.setattr(meshrays, "FIRST_STEPS", 16)
    got = {r.ray_id: (round(r.light, 6), round(r.transmittance, 9)) for r in meshrays.light(rays, nodes, leaf_cells, geometry, field, LENGTH, 48.0).collect()}
    assert got == want and len(got) == 4
    assert (sum(taken) < 90) == ends  # 160 steps in all


def test_crossings_at_any_step_of_a_round(spark, world, monkeypatch):
    nodes, leaf_cells, geometry, rays, cells = world
    field = values(spark, lambda x: F.when(x >= 9, 1).otherwise(0))
    ranges = nodevalues.leaf_ranges(leaf_cells, cells, field, nodes.where("is_leaf")).withColumnRenamed("leaf_key", "node_key")
    want = {}
    for steps in (2, 3, 512):
        monkeypatch.setattr(meshrays, "FIRST_STEPS", steps)
        found, _ = meshrays.first_crossing(rays, nodes, leaf_cells, geometry, field, ranges, 0.4, LENGTH)
        want[steps] = sorted((r.ray_id, r.step, r.direction, round(r.t, 6)) for r in found.collect())
    assert want[2] == want[3] == want[512] and [(r[0], r[2]) for r in want[2]] == [(1, 1), (2, -1), (3, 1)]


def test_what_is_found_for_rays_is_not_moved_for_their_rows(spark):
    found = spark.range(90).select((F.col("id") % 3).alias("ray_id"), F.lit(1).alias("step"), F.col("id").cast("double").alias("value"))
    rows = spark.range(6).select(F.col("id").alias("ray_id"), (F.col("id") % 3).alias("of"))
    whole = meshrays._for_rows(found, rows)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BuildRight" in plan
    assert whole.count() == 180 and {r.ray_id for r in whole.where("value = 4").collect()} == {1, 4}
