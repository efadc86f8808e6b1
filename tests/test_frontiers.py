"""Views' frontiers as a stream against batch steps, and leaves by culling against all scores."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from volmesh.common import checkpointed
from volmesh.operators import lod, mesh, nodevalues, structured, tree
from volmesh.streaming import frontiers

SIZE, BOX = (9, 9, 9), ((0.0,) * 3, (8.0,) * 3)
REQUESTS = "ts timestamp, view_id long, seq long, " + frontiers.CAMERA_TYPES
BUDGET = 20


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = str(tmp_path_factory.mktemp("tree"))
    cells = structured.grid_tets(spark, SIZE).select("cell_id", *mesh.VERTICES)
    values = structured.grid_points(spark, SIZE).select("point_id", F.lit("f").alias("name"), (F.col("x") * F.col("x") + 3 * F.col("y") + (F.col("z") * 7) % 5).alias("value"))
    nodes, leaf_cells = tree.build_tree(structured.grid_cell_bounds(spark, SIZE), BOX, tree.NODE_MEDIAN, 60, 8)
    ranges = nodevalues.node_ranges(nodes, nodevalues.leaf_ranges(leaf_cells, cells, values, nodes.where("is_leaf")))
    out = {}
    for name, df in (("nodes", nodes), ("ranges", ranges), ("limits", mesh.limits(values))):
        df.coalesce(2).write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def requests(seed=3, views=3, each=6):
    rng = random.Random(seed)
    out = []
    for v in range(1, views + 1):
        camera = None
        for seq in range(1, each + 1):
            if camera is None or rng.random() < 0.4:
                matrix = [float(i % 5 == 0) for i in range(16)]
                matrix[15] = rng.choice([5.0, 40.0])
                camera = (rng.uniform(-9, 15), rng.uniform(-9, 15), 4.5, matrix, rng.choice(["f", "f", "y"]), rng.choice([10.0, 30.0, 90.0]))
                if rng.random() < 0.15:
                    camera = (*camera[:3], None, None, None)
            out.append((dt.datetime(2024, 1, 1, 0, 0, len(out) % 60), v, seq, *camera))
    return out


def in_batches(spark, world, rows):
    """Every view's frontier after each request, step by step."""
    now = spark.createDataFrame([], "view_id long, node_key long, state string")
    before = spark.createDataFrame([], "view_id long, " + frontiers.CAMERA_TYPES)
    out = set()
    for seq in range(1, max(r[2] for r in rows) + 1):
        views = spark.createDataFrame([r for r in rows if r[2] == seq], REQUESTS).drop("ts")
        now = checkpointed(frontiers.stepped(now, before, views.drop("seq"), world["nodes"], world["ranges"], world["limits"], BUDGET))
        before = views.drop("seq")
        out |= {(r.view_id, seq, r.node_key, r.state) for r in now.collect()}
    return out


def written(folder, rows, number):
    os.makedirs(folder, exist_ok=True)
    names = ["ts", "view_id", "seq", *frontiers.CAMERA]
    with open(f"{folder}/{number:03}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(names, (r[0].isoformat(), *r[1:]), strict=True))) + "\n" for r in rows)


@pytest.fixture(scope="module")
def expected(spark, world):
    return in_batches(spark, world, requests())


def test_requests_out_of_order_and_a_restart(spark, world, expected, tmp_path):
    rows = requests()
    random.Random(1).shuffle(rows)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run(parts, first):
        for i, part in enumerate(parts):
            written(source, part, first + i)
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).json(source)
        frontiers.run(stream, world["nodes"], world["ranges"], world["limits"], BUDGET, out, check).awaitTermination()
        return {tuple(r) for r in spark.read.parquet(out).select("view_id", "seq", "node_key", "state").collect()}

    half = run([rows[:5], rows[5:10]], 0)
    assert half < expected and half
    # The rest after a restart, with requests that were answered or are waiting already among it.
    got = run([rows[10:] + rows[:3]], 2)
    assert got == expected
    assert spark.read.parquet(out).count() == len(expected)
    assert {r[3] for r in got} == {"NONE", "SPLIT", "MERGED"}
    counts = {}
    for view, seq, *_ in got:
        counts[view, seq] = counts.get((view, seq), 0) + 1
    assert len(set(counts.values())) == 1  # the budget holds


def test_requests_by_tables(spark, world, expected, tmp_path):
    rows = [r for r in requests() if r[2] <= 4]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for i, seqs in enumerate([(1, 2), (3, 4)]):
        part = [r for r in rows if r[2] in seqs]
        random.Random(2).shuffle(part)
        written(source, part + part[:2] + [r for r in rows if r[2] < seqs[0]][:3], i)
        stream = spark.readStream.schema(REQUESTS).json(source)
        frontiers.run_by_tables(stream, world["nodes"], world["ranges"], world["limits"], BUDGET, out, check).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{out}/answers").select("view_id", "seq", "node_key", "state").collect()]
    assert len(got) == len(set(got)) and set(got) == {r for r in expected if r[1] <= 4}


def test_a_missing_request_is_waited_for_until_the_watermark(spark, world, tmp_path):
    rows = [r for r in requests() if r[1] == 1]
    at = lambda r, minute: (dt.datetime(2024, 1, 1, 0, minute), *r[1:])
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run(part, number):
        written(source, part, number)
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).json(source)
        frontiers.run(stream, world["nodes"], world["ranges"], world["limits"], BUDGET, out, check, wait="10 minutes").awaitTermination()
        return sorted({r.seq for r in spark.read.parquet(out).collect()})

    assert run([at(rows[0], 0), at(rows[2], 1)], 0) == [1]
    assert run([at(rows[3], 30)], 1) == [1, 3, 4]  # the third is due, and the fourth follows on it
    assert run([at(rows[1], 2), at(rows[4], 31)], 2) == [1, 3, 4, 5]  # the second comes too late


@pytest.mark.parametrize("budget", [3, 40])
def test_best_leaves_are_those_of_all_scores(spark, world, budget):
    views = spark.createDataFrame([(i, *r[3:]) for i, r in enumerate(requests(8, 3, 3))], "view_id long, " + frontiers.CAMERA_TYPES)
    nodes = world["nodes"]
    every = lod.scores(views, nodes, world["ranges"], world["limits"])
    want = lod.blocks_to_load(every, spark.createDataFrame([], "view_id long, leaf_key long"), budget)
    got, looked = lod.best_leaves(views, nodes, world["ranges"], world["limits"], budget)
    assert sorted(map(tuple, got.select("view_id", "leaf_key", "score").collect())) == sorted(map(tuple, want.select("view_id", "leaf_key", "score").collect()))
    pairs = views.where("mat IS NOT NULL").count() * nodes.count()
    if budget < 40:
        assert looked - views.where("mat IS NULL").count() * nodes.count() < pairs / 2
