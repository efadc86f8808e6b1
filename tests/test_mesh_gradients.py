"""Gradients at vertices: by a plain loop over cells, and how much they move."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.operators import fields, meshfields, sampling, structured


def plain_gradients(cells, places, values):
    sums = {}
    for _, v in cells:
        if any(p not in places for p in v):
            continue
        corners = np.array([places[p] for p in v])
        e = corners[1:] - corners[0]
        whole = np.linalg.det(e)
        if abs(whole) < 1e-12:
            continue
        for name in {n for _, n in values}:
            f = [values.get((p, name)) for p in v]
            if None not in f:
                slope = np.linalg.solve(e, np.array(f[1:]) - f[0])
                for p in v:
                    g, w = sums.get((p, name), (0, 0))
                    sums[p, name] = g + abs(whole) * slope, w + abs(whole)
    return {k: tuple(g / w) for k, (g, w) in sums.items()}


@pytest.mark.parametrize("own_corners", [False, True])
@pytest.mark.parametrize("block", [4, 1 << 12])
def test_means_at_vertices_are_those_of_a_plain_loop(spark, monkeypatch, own_corners, block):
    monkeypatch.setattr(meshfields, "BLOCK", block)
    monkeypatch.setattr(meshfields, "GROUP", 20)
    rng = np.random.default_rng(3)
    places = {int(i) * 7 - 50: tuple(map(float, rng.integers(-9, 10, 3))) for i in range(60)}
    ids = list(places)
    cells = [(int(i), [int(p) for p in rng.choice(ids, 4, replace=False)]) for i in rng.choice(10**9, 150, replace=False)]
    cells += [(-1, [ids[0], ids[1], ids[2], ids[2]]), (-2, [ids[0], ids[1], ids[2], 10**6])]
    values = {(p, n): float(rng.integers(-9, 10)) for p in ids for n in "ab"}
    values |= {(ids[3], "a"): None, (10**6, "a"): 1.0, (ids[6], "b"): math.nan}
    del values[ids[4], "a"], values[ids[4], "b"], values[ids[5], "b"]
    frames = spark.createDataFrame(cells, "cell_id long, v array<long>").repartition(3), spark.createDataFrame([(p, *c) for p, c in places.items()], "point_id long, x double, y double, z double")
    given = spark.createDataFrame([(p, n, v) for (p, n), v in values.items()], "point_id long, name string, value double")
    geometry, points = frames
    if own_corners:
        geometry, points = sampling.geometry_of(geometry.where("cell_id <> -2").select("cell_id", *(F.element_at("v", i + 1).alias(f"v{i}") for i in range(4))), points), None
    got = {(r.point_id, r.name): (r.gx, r.gy, r.gz) for r in meshfields.vertex_gradients(geometry, given, points).collect()}
    want = plain_gradients(cells, places, values)
    assert got.keys() == want.keys() and len(want) > 80
    for k, g in want.items():
        assert np.allclose(got[k], g, atol=1e-9, equal_nan=True), k
    assert any(math.isnan(g[0]) for g in want.values())
    assert meshfields.vertex_gradients(geometry, given.limit(0), points).count() == 0 == meshfields.vertex_gradients(geometry.limit(0), given, points).count()


def written(spark):
    time.sleep(1)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_block_moves_its_vertices_once(spark):
    size = (400, 6, 5)
    points = structured.grid_points(spark, size)
    cells = structured.grid_tets(spark, size, 6)
    geometry = cells.select("cell_id", F.array("v0", "v1", "v2", "v3").alias("v"))
    flow = {"value": F.col("x") * F.col("y"), "vx": F.col("y"), "vy": -F.col("x"), "vz": 3 * F.col("z"), "sound2": F.lit(4.0)}
    made = points.select("point_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in flow.items()))).alias("f")).select("point_id", "f.*")
    n, before = cells.count(), written(spark)
    meshfields.derive(geometry, made, list(fields.registry()), points=points).write.format("noop").mode("overwrite").save()
    moved = (written(spark) - before) / n
    assert 0 < moved < 100  # bytes; 215 when each cell got its vertices by rows of its own
