"""Mesh operators at their edges, and streams."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from volmesh.functions import geometry as geo
from volmesh.operators import blocks, fields, ingest, lod, mesh, nodevalues, probe, sampling, structured, tree
from volmesh.streaming import views

SIZE, BOX = (5, 5, 5), ((0.0,) * 3, (4.0,) * 3)


@pytest.fixture(scope="module")
def small(spark):
    points = structured.grid_points(spark, SIZE)
    cells = structured.grid_tets(spark, SIZE).select("cell_id", *mesh.VERTICES)
    values = points.select("point_id", F.lit("f").alias("name"), (1 + 2 * F.col("x") + 3 * F.col("y") + 5 * F.col("z")).alias("value"))
    nodes, leaf_cells = tree.build_tree(structured.grid_cell_bounds(spark, SIZE), BOX, tree.NODE_MEDIAN, 40, 5)
    return points, cells, values, nodes, leaf_cells


def test_rays_that_are_parallel_to_axes(spark):
    rays = spark.createDataFrame([(1, 1.0, 1.0, -2.0, 0.0, 0.0, 1.0), (2, 9.0, 1.0, -2.0, 0.0, 0.0, 1.0), (3, -1.0, 4.0, 4.0, 1.0, 0.0, 0.0), (4, 1.0, 1.0, 9.0, 0.0, 0.0, 1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    near, far = probe.box_interval(*BOX)
    got = {r.ray_id: (r.near, r.far) for r in rays.select("ray_id", near.alias("near"), far.alias("far")).where("near <= far AND far >= 0").collect()}
    assert got == {1: (2.0, 6.0), 3: (1.0, 5.0)}
    steps = probe.steps(rays, BOX, 1.0).where("ray_id = 1").orderBy("step").collect()
    assert [r.z for r in steps] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_scores_at_their_edges(spark, small):
    *_, nodes, _ = small
    ranges = nodes.select("node_key", F.lit("f").alias("name"), F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"))
    limits = spark.createDataFrame([("f", 1.0, 1.0)], "name string, lo double, hi double")
    unit, flat = [float(i % 5 == 0) for i in range(16)], [0.0] * 16
    rows = [(1, 2.0, 2.0, 2.0, unit, "f", 1.0), (2, 2.0, 2.0, 2.0, flat, "f", 1.0), (3, 9.0, 2.0, 2.0, unit, None, None), (4, None, None, None, None, None, None), (5, 9.0, 2.0, 2.0, unit, "f", 7.0), (6, 9.0, 2.0, 2.0, unit, "x", 2.0)]
    view = spark.createDataFrame(rows, "view_id long, ex double, ey double, ez double, mat array<double>, iso_name string, iso double")
    root = {r.view_id: r.score for r in lod.scores(view, nodes, ranges, limits).where("node_key = 1").collect()}
    assert root[1] == float("inf") and root[2] == 0 and root[3] == pytest.approx(16 / 49) and 0 <= root[4] < 1 and root[5] == 0 and root[6] == pytest.approx(16 / 49)
    many = spark.range(10_001).select(F.col("id").alias("view_id"), *(F.lit(9.0).alias(f"e{a}") for a in "xyz"), F.array(*map(F.lit, unit)).alias("mat"), F.lit("f").alias("iso_name"), F.lit(1.0).alias("iso"))
    assert lod.scores(many, nodes.where("node_key = 1"), ranges, limits).count() == 10_001


def test_many_names(spark, small):
    points, cells, _, nodes, leaf_cells = small
    names = spark.range(1001).select(F.concat(F.lit("n"), "id").alias("name"))
    values = points.limit(1).select("point_id", F.lit(1.0).alias("value")).crossJoin(names)
    leaves = nodes.where("is_leaf")
    assert nodevalues.leaf_ranges(leaf_cells, cells, values, leaves).count() == 1001 * leaves.count()


def test_wrong_choices_are_errors(spark, small):
    _, cells, _, nodes, leaf_cells = small
    bounds = structured.grid_cell_bounds(spark, SIZE)
    with pytest.raises(ValueError, match="no such strategy"):
        tree.build_tree(bounds, BOX, "NODE_MEDIUM")
    with pytest.raises(ValueError, match="needs points"):
        tree.build_tree(bounds, BOX, tree.VERT_MEDIAN)
    ids = nodes.where("is_leaf").select(F.col("node_key").alias("leaf_key"))
    _, block_cells = blocks.split_blocks(leaf_cells, cells)
    with pytest.raises(KeyError, match="1"):
        blocks.fetch(block_cells, nodes.select(F.col("node_key").alias("leaf_key")), known=ids)
    assert blocks.fetch(block_cells, ids.limit(2), ["local_cell"], known=ids).select("leaf_key").distinct().count() == 2
    with pytest.raises(ValueError, match="no corner values"):
        nodevalues.frontier_corners(nodes, spark.createDataFrame([], "node_key long, name string, corner int, value double"), "f")


def test_deep_keys(spark):
    """Keys of 58 bits, beyond what a double holds."""
    key = (1 << 57) + 3
    nodes = spark.createDataFrame([(key, 57, True, 1)], "node_key long, depth int, is_leaf boolean, cell_count long")
    ranges = spark.createDataFrame([(key, "f", 0.0, 1.0)], "leaf_key long, name string, lo double, hi double")
    assert {r.node_key for r in nodevalues.node_ranges(nodes, ranges).collect()} == {key >> k for k in range(58)}
    corners = spark.createDataFrame([(key, "f", c, float(c)) for c in range(8)], "node_key long, name string, corner int, value double")
    got = {(r.node_key, r.corner) for r in nodevalues.corner_values(nodes, corners).collect()}
    want = set()
    for c in range(8):
        for up in range(58):
            if any((key >> (56 - d) & 1) != (c >> (d % 3) & 1) for d in range(57 - up, 57)):
                break
            want.add((key >> up, c))
    assert got == want


def test_linear_fields_are_kept(spark, small):
    points, cells, values, nodes, leaf_cells = small
    shapes = sampling.geometry_of(cells, points)
    at = nodevalues.random_points(nodes.where("is_leaf"), 32)
    samples = sampling.sampled_or_nearest(at, leaf_cells, shapes, values).withColumnRenamed("sample", "value").join(at, "probe_id")
    fitted = nodevalues.refitted(nodes, nodevalues.fit_polynomials(samples)).join(nodes, "node_key").collect()
    assert len(fitted) == nodes.count()
    for r in fitted:
        assert r.coefficients == pytest.approx([1, 2, 3, 5, 0, 0, 0, 0], abs=1e-6)
    averages = nodevalues.sampled_averages(nodes.where("is_leaf"), leaf_cells, shapes, values, k=20)
    assert averages.count() == nodes.where("is_leaf").count()
    corners = nodevalues.corner_values(nodes, nodevalues.leaf_corners(nodes.where("is_leaf"), leaf_cells, shapes, values))
    where = sampling.locate(at.select("probe_id", "x", "y", "z"), nodes)
    for found in (nodevalues.interpolated(where, nodes, corners), nodevalues.continuous(where, nodes, corners, nodes.where("is_leaf").select("node_key"))):
        rows = found.join(at, "probe_id").limit(60).collect()
        exact = [1 + 2 * r.x + 3 * r.y + 5 * r.z for r in rows]
        if "face" not in found.columns and found.columns == ["probe_id", "name", "sample"]:
            assert [r["sample"] for r in rows] == pytest.approx(exact, abs=3)


def test_fits_without_enough_samples(spark):
    few = spark.createDataFrame([(1, "f", 0.0, 0.0, 0.0, 4.0), (2, "f", 1.0, 2.0, 3.0, 0.0)], "leaf_key long, name string, x double, y double, z double, value double")
    assert [r.coefficients for r in nodevalues.fit_polynomials(few).collect()] == [[0.0] * 8] * 2


def test_overlaps_against_all_pairs(spark):
    box = lambda i, k: (i, *(float((i * p) % 11) for p in (3, 5, 7)), *(float((i * p) % 11 + 1 + (i * k) % 4) for p in (3, 5, 7)))
    left, right = [box(i, 1) for i in range(30)], [box(i, 2) for i in range(30, 70)]
    schema = "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    want = {(a[0], b[0]) for a in left for b in right if all(a[1 + k] <= b[4 + k] and b[1 + k] <= a[4 + k] for k in range(3))}
    got = [tuple(r) for r in sampling.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()]
    assert sorted(got) == sorted(want)


def test_treelets_and_rebuilt_trees(spark, small):
    *_, nodes, leaf_cells = small
    bounds = structured.grid_cell_bounds(spark, SIZE)
    below, lowest = tree.treelets(nodes, leaf_cells, bounds, 2)
    leaves = nodes.where("is_leaf").count()
    assert below.count() == leaves * (2**3 - 2) and lowest.select("leaf_key", "cell_id").distinct().count() == leaf_cells.count()
    buffer = tree.serialised(nodes)
    assert tree.rebuilt(buffer, BOX).select("node_key", "depth", "is_leaf", *tree.BOUNDS).exceptAll(nodes.select("node_key", "depth", "is_leaf", *tree.BOUNDS)).count() == 0
    assert sorted(r.leaf_index for r in tree.leaf_index(buffer).collect()) == list(range(leaves))


def test_ingests(spark):
    voxels = structured.grid_points(spark, SIZE).select(*(F.col(a).cast("int").alias(a) for a in "xyz"), F.col("x").alias("value"))
    plain = ingest.ingest(voxels, SIZE)
    assert plain.voxels is voxels and not plain.tables
    whole = ingest.ingest(voxels, SIZE, ingest.Options(force_unstructured=True, leaf_cells=100, block_mesh=True), (2.0, 1.0, 1.0))
    assert whole.tables["points"].agg(F.max("x")).first()[0] == 8.0
    assert whole.tables["cells"].count() == 320 and whole.tables["block_values"].select("leaf_key").distinct().count() == whole.tables["nodes"].where("is_leaf").count()
    assert whole.tables["corners"].where("node_key = 1 AND corner = 1").first().value == pytest.approx(4.0)


def test_flat_boxes_and_still_air(spark):
    voxels = structured.grid_points(spark, SIZE).select("x", "y", "z", F.col("y").alias("value"))
    points = spark.createDataFrame([(1, 0.5, 0.5, 7.0)], "point_id long, x double, y double, z double")
    assert structured.transfer(points, ((0.0, 0.0, 7.0), (1.0, 1.0, 7.0)), voxels, SIZE).first().value == 2.0
    flow = voxels.withColumns({"vx": F.lit(1.0), "vy": F.lit(0.0), "vz": F.lit(0.0), "sound2": F.lit(0.0)})
    assert fields.derive(flow, ["mach"]).where("mach IS NOT NULL").count() == 0
    assert [tuple(r) for r in fields.limits(flow, ["vx"]).collect()] == [("vx", 1.0, 1.0)]


def test_states_of_changed_views(spark):
    now = spark.createDataFrame([(1, 5, "SPLIT"), (2, 5, "SPLIT"), (3, 5, "MERGED")], "view_id long, node_key long, state string")
    before = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 2.0)], "view_id long, ex double, iso double")
    after = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 3.0), (3, 1.0, 1.0)], "view_id long, ex double, iso double")
    assert {r.view_id: r.state for r in lod.reset(now, before, after).collect()} == {1: "SPLIT", 2: "NONE", 3: "NONE"}


def test_batches_of_requests(spark):
    got = blocks.batches(spark.range(2500).select((F.col("id") * 7).alias("leaf_key")).repartition(9)).groupBy("batch").agg(F.count("*").alias("n"), F.min("leaf_key").alias("least")).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 1000, 0), (1, 1000, 7000), (2, 500, 14000)]


def test_box_predicates(spark):
    row = spark.range(1).select(geo.boxes_overlap((F.lit(0),) * 3, (F.lit(1),) * 3, (F.lit(1),) * 3, (F.lit(2),) * 3), geo.in_box((F.lit(1.0),) * 3, (F.lit(0),) * 3, (F.lit(1),) * 3)).first()
    assert tuple(row) == (True, True)


def write(folder, name, rows):
    """Files are read in the order of their times, which are set here."""
    (folder / name).write_text("\n".join(json.dumps({"ts": str(t), "run_id": 1, "frame_num": f, "metric": "gpu", "value": v, "seq": s}) for t, f, v, s in rows))
    os.utime(folder / name, (1_700_000_000 + int(name[0]),) * 2)


def test_late_writes_win_across_hours(spark, tmp_path):
    hour = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    source = tmp_path / "in"
    source.mkdir()
    write(source, "0.json", [(hour(10, 50), 1, 1.0, 1), (hour(11, 5), 1, 9.0, 2), (hour(10, 55), 2, 3.0, 3)])
    write(source, "1.json", [(hour(11, 6), 2, 4.0, 2)])
    write(source, "2.json", [(hour(15), 3, 5.0, 4)])
    write(source, "3.json", [(hour(15, 1), 4, 5.0, 4)])
    stream = spark.readStream.schema("ts timestamp, run_id long, frame_num long, metric string, value double, seq long").option("maxFilesPerTrigger", 1).json(str(source))
    query = views.frame_stream(stream).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.frame_num, r.value) for r in spark.table("frames").collect()) == [(1, 9.0), (2, 3.0)]


def test_requests_of_views(spark, small, tmp_path):
    *_, nodes, _ = small
    ranges = nodes.select("node_key", F.lit("f").alias("name"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    limits = spark.createDataFrame([("f", 0.0, 1.0)], "name string, lo double, hi double")
    unit = [float(i % 5 == 0) for i in range(16)]
    rows = [{"view_id": 1, "seq": s, "ex": 9.0 + s, "ey": 2.0, "ez": 2.0, "mat": unit, "iso_name": "f", "iso": 0.5} for s in (1, 2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("view_id long, seq long, ex double, ey double, ez double, mat array<double>, iso_name string, iso double").json(str(tmp_path / "in"))
    views.run_requests(stream, nodes, ranges, limits, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == nodes.count() and got.where("node_key = 1").first().score == pytest.approx(16 / 81)
