"""Rays and derivatives in an unstructured mesh, node-median trees without a level loop, and samples of repeated rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from volmesh.functions.geometry import hashed_number
from volmesh.operators import fields, mesh, meshfields, meshrays, nodevalues, sampling, structured, tree

SIZE, BOX = (6, 5, 7), ((0.0,) * 3, (5.0, 4.0, 6.0))
RAYS = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


@pytest.fixture(scope="module")
def world(spark):
    points = structured.grid_points(spark, SIZE)
    # A mesh with a hole: the cells of two cubes are missing.
    cells = structured.grid_tets(spark, SIZE).where("NOT (cx = 2 AND cy = 1 AND cz IN (2, 3))").select("cell_id", *mesh.VERTICES)
    linear = points.select("point_id", F.lit("f").alias("name"), (1 + 2 * F.col("x") + 3 * F.col("y") - 5 * F.col("z")).alias("value"))
    wild = points.select("point_id", F.lit("w").alias("name"), ((F.col("point_id") * 37) % 11).cast("double").alias("value"))
    bounds = structured.grid_cell_bounds(spark, SIZE).join(cells.select("cell_id"), "cell_id", "left_semi")
    nodes, leaf_cells = tree.build_tree(bounds, BOX, tree.NODE_MEDIAN, 60, 6)
    geometry = sampling.geometry_of(cells, points)
    return nodes.cache(), leaf_cells.cache(), geometry.cache(), linear.union(wild).cache(), bounds.cache(), cells.cache()


@pytest.fixture(scope="module")
def rays(spark):
    rng = random.Random(4)
    rows = [(i, *(rng.uniform(-2, 7) for _ in range(3)), *(rng.uniform(-1, 1) for _ in range(3))) for i in range(40)]
    rows += [(100, -1.0, 2.0, 3.0, 1.0, 0.0, 0.0), (101, 2.5, 4.0, 9.0, 0.0, 0.0, -1.0), (102, 2.5, 2.0, 3.0, 0.0, 1.0, 0.0), (103, 9.0, 9.0, 9.0, 1.0, 0.0, 0.0), (104, None, 1.0, 1.0, 1.0, 0.0, 0.0), (105, 1.25, 2.0, 3.0, 0.5, 0.25, -0.75)]
    return spark.createDataFrame(rows, RAYS).withColumn("leaf_key", F.lit("clash"))


LENGTH = 0.4


def along(rays):
    """Every place of every ray, one by one."""
    out = {}
    for r in rays.collect():
        if r.ox is None:
            continue
        near, far = -float("inf"), float("inf")
        for a, lo, hi in zip("xyz", *BOX, strict=True):
            o, d = r[f"o{a}"], r[f"d{a}"]
            t = ((-float("inf"), float("inf")) if lo <= o <= hi else (float("inf"), -float("inf"))) if d == 0 else sorted(((lo - o) / d, (hi - o) / d))
            near, far = max(near, t[0]), min(far, t[1])
        begin = max(near, 0.0)
        if begin <= far:
            for step in range(math.floor((far - begin) / LENGTH) + 1):
                p = tuple(r[f"o{a}"] + (begin + step * LENGTH) * r[f"d{a}"] for a in "xyz")
                if all(lo <= v <= hi for v, lo, hi in zip(p, *BOX, strict=True)):
                    out[r.ray_id, step] = p
    return out


@pytest.fixture(scope="module")
def dense(spark, world, rays):
    nodes, leaf_cells, geometry, values, _, _ = world
    places = spark.createDataFrame([(i * 1000 + s, *p) for (i, s), p in along(rays).items()], "probe_id long, x double, y double, z double")
    at = sampling.locate(places, nodes)
    found = sampling.sampled(sampling.containing_cell(at, leaf_cells, geometry), values)
    leaves = {(r.probe_id // 1000, r.probe_id % 1000): r.leaf_key for r in at.collect()}
    return leaves, {(r.probe_id // 1000, r.probe_id % 1000, r.name): r["sample"] for r in found.collect()}


def test_steps_are_in_the_leaves_of_their_places(world, rays, dense):
    got = {}
    for r in meshrays.leaf_steps(rays, world[0], LENGTH).collect():
        for step in range(r["first"], r["last"] + 1):
            assert got.setdefault((r.ray_id, step), r.leaf_key) == r.leaf_key
    assert {k: got[k] for k in dense[0]} == dense[0]
    assert len(got) - len(dense[0]) <= 3  # places that rounding puts outside of the box


def test_values_along_rays(world, rays, dense):
    nodes, leaf_cells, geometry, values, _, _ = world
    got = {(r.ray_id, r.step, r.name): r.value for r in meshrays.line_samples(rays, nodes, leaf_cells, geometry, values, LENGTH).collect()}
    assert got.keys() == dense[1].keys() and all(abs(v - dense[1][k]) < 1e-9 for k, v in got.items())
    places = along(rays)
    assert all(abs(v - (1 + 2 * x + 3 * y - 5 * z)) < 1e-9 for (i, s, n), v in got.items() if n == "f" for x, y, z in [places[i, s]])


@pytest.mark.parametrize("iso", [4.0, 100.0])
def test_first_crossings_and_an_early_stop(world, rays, dense, iso, monkeypatch):
    nodes, leaf_cells, geometry, values, _, cells = world
    own = values.where("name = 'w'")
    ranges = nodevalues.leaf_ranges(leaf_cells, cells, own, nodes.where("is_leaf")).withColumnRenamed("leaf_key", "node_key")
    want = {}
    for (i, s, n), v in sorted(dense[1].items()):
        before = dense[1].get((i, s - 1, n))
        if n == "w" and before is not None and (before > iso) != (v > iso) and i not in want:
            want[i] = (s, 1 if v > iso else -1, round(s * LENGTH - LENGTH + LENGTH * (before - iso) / (before - v), 6))
    monkeypatch.setattr(meshrays, "FIRST_LEAVES", 1)
    found, leaves = meshrays.first_crossing(rays, nodes, leaf_cells, geometry, own, ranges, iso, LENGTH)
    assert {r.ray_id: (r.step, r.direction, round(r.t, 6)) for r in found.collect()} == want
    every = meshrays.leaf_steps(rays, nodes, LENGTH).count()
    assert (want and leaves < every) if iso == 4.0 else (not want and leaves == every)


def test_gradients_of_linear_fields_are_exact(spark, world):
    _, _, geometry, values, _, _ = world
    assert all((round(r.gx, 9), round(r.gy, 9), round(r.gz, 9)) == (2, 3, -5) for r in meshfields.cell_gradients(geometry, values.where("name = 'f'")).collect())
    flat = spark.createDataFrame([(900, [0, 1, 2, 2], [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.0, 0.0, 0.0)])], geometry.schema)
    got = meshfields.vertex_gradients(geometry.unionByName(flat), values.where("name = 'f'")).collect()
    assert len(got) == 6 * 5 * 7 and all((round(r.gx, 9), round(r.gy, 9), round(r.gz, 9)) == (2, 3, -5) for r in got)


def test_derived_fields_on_a_mesh(spark, world):
    _, _, geometry, _, _, _ = world
    p = structured.grid_points(spark, SIZE)
    flow = {"value": F.col("x") + 2 * F.col("y"), "vx": F.col("y"), "vy": -F.col("x"), "vz": 3 * F.col("z"), "sound2": F.lit(4.0)}
    made = p.select("point_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in flow.items()))).alias("f")).select("point_id", "f.*")
    got = meshfields.derive(geometry, made, list(fields.registry())).collect()
    for r, (x, y, z) in zip(sorted(got, key=lambda r: r.point_id), ((i % 6, i // 6 % 5, i // 30) for i in range(210)), strict=True):
        size = x * x + y * y + 9 * z * z
        want = (size**0.5, 5**0.5, (size / 4) ** 0.5, 3.0, 2.0, 1.0)
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[1:], want, strict=True))
    missing = meshfields.derive(geometry, made.where("name <> 'sound2'"), ["mach", "magnitude"]).first()
    assert missing.mach is None and missing.magnitude is not None
    assert meshfields.derive(geometry, made.limit(0), ["divergence"]).count() == 0


def test_derivatives_at_probes_fall_back(spark, world):
    nodes, leaf_cells, geometry, values, _, _ = world
    rows = [(1, 0.3, 0.4, 0.5), (2, 5.0, 2.0, 2.0), (3, 2.5, 1.5, 2.5), (4, 9.0, 0.0, 0.0), (5, None, 1.0, 1.0), (1, 0.3, 0.4, 0.5), (1, 1.3, 0.4, 0.5)]
    probes = spark.createDataFrame(rows, "probe_id long, x double, y double, z double").withColumn("leaf_key", F.lit("clash"))
    got = sorted((r.probe_id, round(r.d, 9)) for r in meshfields.derivative_at(probes, nodes, leaf_cells, geometry, values.where("name = 'f'"), "x", eps=0.0).collect())
    assert got == [(1, 2.0), (1, 2.0), (1, 2.0), (2, 2.0), (3, 0.0), (4, 0.0), (5, 0.0)]


@pytest.mark.parametrize(("max_cells", "max_depth"), [(60, 6), (10, 9), (7, 14), (5000, 8), (1, 3), (20, 0)])
def test_median_trees_are_those_of_the_level_loop(spark, world, max_cells, max_depth):
    bounds = world[4]
    a, b = tree.median_tree(bounds, BOX, max_cells, max_depth), tree.level_tree(bounds, BOX, tree.NODE_MEDIAN, max_cells, max_depth)
    columns = ["node_key", "parent_key", "depth", "split_dim", "split_val", "is_leaf", "cell_count", *tree.BOUNDS]
    assert sorted(map(tuple, a[0].select(columns).collect())) == sorted(map(tuple, b[0].select(columns).collect()))
    assert sorted(map(tuple, a[1].select("leaf_key", "cell_id").collect())) == sorted(map(tuple, b[1].select("leaf_key", "cell_id").collect()))


def test_median_trees_move_no_cells(spark, world):
    import numpy as np

    counts = tree._counted(world[4].select("*"), np.array([[*BOX[0], *BOX[1]]]), np.array([1]), 0, 4)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    assert tree.median_tree(world[4].limit(0), BOX, 5, 4)[0].count() == 1


def test_samples_of_repeated_and_null_rows(spark):
    voxels = structured.grid_points(spark, SIZE).select("x", "y", "z", (1 + 2 * F.col("x") + 3 * F.col("y") - 5 * F.col("z")).alias("value"))
    rows = [(1, 1.5, 2.0, 3.0, None), (1, 1.5, 2.0, 3.0, None), (2, 1.5, 2.0, 3.0, "a"), (None, 0.5, 0.5, 0.5, None), (3, None, 1.0, 1.0, "b"), (4, 9.0, 1.0, 1.0, "b"), (5, -0.0, 0.0, 0.0, None)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, note string").withColumns({"sample": F.lit("clash"), "gx": F.lit(1)})
    want = sorted([(1, -5.0), (1, -5.0), (2, -5.0), (None, 1.0), (3, None), (4, None), (5, 1.0)], key=repr)
    assert sorted([(r.point_id, r["sample"]) for r in structured.trilinear(points, voxels, SIZE).collect()], key=repr) == want
    moved = structured.transfer(points, BOX, voxels, SIZE)
    assert sorted([(r.point_id, r.value) for r in moved.collect()], key=repr) == want
    slopes = {(r.point_id, r.d) for r in structured.derivative_at(points.drop("sample", "gx"), voxels, SIZE, "y").collect()}
    assert slopes == {(1, 3.0), (2, 3.0), (None, 3.0), (3, 0.0), (4, 0.0), (5, 3.0)}
    shade = structured.gradient_at(points.drop("sample", "gx"), voxels, SIZE).where("point_id <= 2").collect()
    assert len(shade) == 3 and all((r.gx, r.gy, r.gz) == (-2.0, -3.0, 5.0) for r in shade)


def test_derivatives_of_an_axis_share_a_window(spark):
    grid = structured.grid_points(spark, SIZE).withColumns({"value": F.col("x"), "vx": F.col("x"), "vy": F.col("y"), "vz": F.col("z"), "sound2": F.lit(1.0)})
    plan = fields.derive(grid, list(fields.registry()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_decimation_takes_a_cutoff(spark):
    size = (12, 11, 10)
    found = structured.decimation_map(spark, size, 0.2)
    assert "limit=264" not in found._jdf.queryExecution().executedPlan().toString()
    every = structured.decimation_map(spark, size, 1.0)
    order = every.select("src", hashed_number(F.lit(3), F.col("src")).alias("h")).orderBy("h", "src").limit(264)
    assert {r.src for r in found.collect()} == {r.src for r in order.collect()} and found.count() == 264
    ties = spark.range(100).select(F.col("id").alias("src"), (F.col("id") % 3 * (1 << 20)).alias("h"))
    assert sorted(r.src for r in structured.least_rows(ties, "h", "src", 40).collect()) == sorted([*range(0, 100, 3), 1, 4, 7, 10, 13, 16])
    assert [structured.least_rows(ties, "h", "src", n).count() for n in (0, 1, 99, 100, 500)] == [0, 1, 99, 100, 100]


def test_lower_medians_are_exact(spark):
    rng = random.Random(6)
    sets = {1: [5.0], 2: [1.0, 2.0], 3: [2.0] * 9, 4: [rng.gauss(0, 1) for _ in range(3001)], 5: [10.0**i for i in range(-200, 200)], 6: [-1e308, 1e308, 0.5, 0.25], 7: [float(i % 3) for i in range(100)], 8: [2.0**-i for i in range(60)] + [0.0, -0.0]}
    values = spark.createDataFrame([(k, v) for k, own in sets.items() for v in own], "node_key long, v double").repartition(3)
    got = {r.node_key: r.v for r in tree.lower_medians(values).collect()}
    assert got == {k: sorted(own)[len(own) // 2 - 1] for k, own in sets.items() if len(own) > 1}
    assert tree.lower_medians(values.limit(0)).count() == 0


def test_boxes_of_all_sizes_overlap_as_in_all_pairs(spark):
    rng = random.Random(7)

    def boxes(n, first):
        out = []
        for i in range(n):
            low = [rng.uniform(-50, 50) for _ in range(3)]
            size = [rng.choice([0.0, 0.01, 1.0, 8.0, 40.0]) * rng.random() for _ in range(3)]
            out.append((first + i, *low, *(a + s for a, s in zip(low, size, strict=True))))
        return out

    schema = "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    left = [*boxes(150, 0), (900, -1e6, -1e6, -1e6, 1e6, 1e6, 1e6), (901, None, 0.0, 0.0, 1.0, 1.0, 1.0), (902, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (903, 5.0, 5.0, 5.0, 4.0, 6.0, 6.0)]
    right = [*boxes(150, 0), (902, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (904, 0.0, -3.0, -3.0, 4.0, 3.0, 3.0), (905, -1e-9, 0.0, 0.0, 0.0, 1e-9, 0.0)]
    meets = lambda a, b: None not in (*a, *b) and a[1] <= a[4] and all(a[i + 1] <= b[i + 4] and b[i + 1] <= a[i + 4] for i in range(3))
    want = sorted((a[0], b[0]) for a in left for b in right if meets(a, b))
    found = sampling.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert sorted(map(tuple, found.collect())) == want
    assert sampling.overlapping(spark.createDataFrame(left, schema).limit(0), spark.createDataFrame(right, schema)).count() == 0


def test_a_box_over_everything_does_not_explode(spark):
    small = spark.range(100_000).select("id", *((F.col("id") % n * 0.5 + i * 0.25).alias(f"{a}{i}") for a, n in (("x", 100), ("y", 101), ("z", 10)) for i in (0, 1)))
    whole = spark.createDataFrame([(1, *(-1e9,) * 3, *(1e9,) * 3)], "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert sampling.overlapping(small, whole).count() == 100_000


def test_camera_segments_may_overlap_and_leave_gaps(spark):
    from volmesh.operators import reports

    rng = random.Random(8)
    rows = [(a, a + rng.choice([0.001, 0.7, 1.0, 30.0, 500.0]), 1.0 + i, 2.0, 0.0, 1.0, 0.0, 0.5) for i, a in enumerate(rng.uniform(-100, 100) for _ in range(60))] + [(3.0, 3.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0), (-900.0, -899.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    segments = spark.createDataFrame(rows, "t0 double, t1 double, r0 double, r1 double, az0 double, az1 double, el0 double, el1 double")
    at = [rng.uniform(-950, 650) for _ in range(300)] + [r[0] for r in rows] + [r[1] for r in rows]
    found = reports.camera_at(spark.createDataFrame([(t,) for t in at], "t double"), segments)
    assert sorted(r.t for r in found.collect()) == sorted(t for t in at for r in rows if r[0] <= t < r[1])
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
