"""Readers by byte range, catalogs and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.operators import mesh, structured, tree
from volmesh.sources import binary, catalog


def test_time_steps_and_schemes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BATCH_ROWS", 3)
    data = np.arange(16, dtype=">f4").reshape(8, 2)
    (tmp_path / "d.bin").write_bytes(np.array([binary.VOLUME_DATA_MAGIC, 1, 2, 8], ">i4").tobytes() + b"".join(np.array([t], ">i4").tobytes() + (data + 100 * t).astype(">f4").tobytes() for t in range(3)))
    for path in (str(tmp_path / "d.bin"), f"file://{tmp_path}/d.bin"):
        rows = {(r.t, r.point_id, r.name): r.value for r in binary.read_volume_data(spark, path, ["a", "b"], ">").collect()}
        assert rows == {(t, p, n): 100 * t + 2 * p + i for t in range(3) for p in range(8) for i, n in enumerate("ab")}
    one = binary.read_volume_data(spark, str(tmp_path / "d.bin"), ["a", "b"], ">", t_index=2)
    assert one.select("t").distinct().collect() == [(2,)] and one.where("point_id = 7 AND name = 'b'").first().value == 215
    with pytest.raises(ValueError, match="3 time steps"):
        binary.read_volume_data(spark, str(tmp_path / "d.bin"), ["a", "b"], ">", t_index=3)
    (tmp_path / "x.bin").write_bytes(bytes(16))
    with pytest.raises(ValueError, match="begin with"):
        binary.read_volume_data(spark, str(tmp_path / "x.bin"), ["a"])


def test_catalogs(spark, tmp_path):
    entry = {"name": "Engine", "path": "/e.raw", "type": "raw", "size": {"x": 2, "y": 3, "z": 4}, "availableTrees": [{"kdTreeType": "NODE_MEDIAN", "maxTreeDepth": 20, "leafCells": 64, "nodesPath": "/e.nodes"}], "cornerValues": [{"array": "v", "type": "sample", "path": "/e.corners"}]}
    (tmp_path / "c.json").write_text(json.dumps({"engine": entry, "other": {"name": "Other", "path": "/o"}}, indent=1))
    found = catalog.read_catalog(spark, str(tmp_path / "c.json"))
    assert {r.id: (r.name, r.path) for r in found.collect()} == {"engine": ("Engine", "/e.raw"), "other": ("Other", "/o")}
    assert found.where("id = 'engine'").first()["size"].y == 3
    assert catalog.find_tree(found, "engine", "NODE_MEDIAN", 20, 64).first().nodesPath == "/e.nodes"
    assert catalog.find_tree(found, "engine", "NODE_MEDIAN", 20, 65).count() == 0 == catalog.find_tree(found, "other", "NODE_MEDIAN", 20, 64).count()
    assert catalog.corner_path(found, "engine", "v", "sample").first().path == "/e.corners"
    assert catalog.corner_path(found, "engine", "v", "polynomial").count() == 0


def test_writers(spark, tmp_path):
    size = (4, 4, 4)
    nodes, leaf_cells = tree.build_tree(structured.grid_cell_bounds(spark, size), ((0.0,) * 3, (3.0,) * 3), max_cells=40, max_depth=5)
    catalog.write_tree(f"{tmp_path}/tree", nodes=nodes, meta=tree.statistics(nodes))
    assert spark.read.parquet(f"{tmp_path}/tree/nodes").exceptAll(nodes).count() == 0
    catalog.write_blocks(f"{tmp_path}/blocks", 3, cells=leaf_cells)
    again = spark.read.parquet(f"{tmp_path}/blocks/cells")
    assert again.exceptAll(leaf_cells).count() == 0 == leaf_cells.exceptAll(again).count()
    catalog.write_report(nodes.groupBy("depth").count(), f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == nodes.select("depth").distinct().count()
    values = structured.grid_points(spark, size).select("point_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"), F.lit(1.0).alias("value"))
    assert sorted(map(tuple, mesh.arrays(values).collect())) == [("a", "data"), ("b", "data")]


def test_blocks_are_read_from_their_files(spark, tmp_path):
    table = spark.range(1000).select((F.col("id") % 50 + 1).alias("leaf_key"), F.col("id").alias("local_cell"), F.lit("x").alias("other"))
    catalog.write_blocks(str(tmp_path), 10, cells=table)
    wanted = spark.createDataFrame([(7,), (7,), (8,), (99,), (None,)], "leaf_key long")
    found = catalog.read_blocks(spark, str(tmp_path), "cells", wanted, ["local_cell"])
    assert found.exceptAll(table.where("leaf_key IN (7, 8)").select("leaf_key", "local_cell")).count() == 0 and found.count() == 40
    held = {f.split("/")[-1] for f in spark.read.parquet(f"{tmp_path}/cells").inputFiles()}
    opened = {f.split("/")[-1] for f in found.inputFiles() if "part-" in f}
    assert len(held) == 10 and 1 <= len(opened & held) <= 2
    assert catalog.read_blocks(spark, str(tmp_path), "cells", wanted.where("leaf_key > 50")).count() == 0
    catalog.write_blocks(str(tmp_path), 10, none=table.limit(0))
    assert catalog.read_blocks(spark, str(tmp_path), "none", wanted).count() == 0
