"""Blocks: a leaf's cells with vertices numbered within the leaf, as they first appear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volmesh.common import checkpointed
from volmesh.functions.geometry import in_box

#: Blocks in a request at most; fixed value.
BATCH = 1000
#: Numbers of cells that a task ranks together.
RANKED = 1 << 16


def _ranks(rows: DataFrame, counted: DataFrame, order: Column, bucket: Column, name: str) -> DataFrame:
    """rows with ``name``: their place from 0 on within their leaf_key by ``order``, whose leading part ``bucket`` is.
    counted: the same rows' leaf_key and bucket.

    Ranks are those within a bucket of a leaf plus what stands before, so no task ranks a whole leaf.
    """
    before = Window.partitionBy("leaf_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("leaf_key", "bucket").agg(F.count("*").alias("n")).select("leaf_key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("bucket", bucket)
    local = placed.withColumn(name, F.row_number().over(Window.partitionBy("leaf_key", "bucket").orderBy(order)) - 1)
    return local.join(starts, ["leaf_key", "bucket"]).withColumn(name, (F.col(name) + F.col("start")).cast("int")).drop("bucket", "start")


def split_blocks(leaf_cells: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block_points: leaf_key, local_id, point_id; block_cells: leaf_key, local_cell, v0 .. v3, all local)."""
    ordered = leaf_cells.join(cells.select("cell_id", "v0", "v1", "v2", "v3"), "cell_id")
    long = ordered.select("leaf_key", "cell_id", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("i", "point_id"))
    first = checkpointed(long.groupBy("leaf_key", "point_id").agg(F.min(F.struct("cell_id", "i")).alias("at")))
    bucket = lambda c: F.floor(F.col(c) / RANKED)
    points = _ranks(first, first.select("leaf_key", bucket("at.cell_id").alias("bucket")), F.col("at"), bucket("at.cell_id"), "local_id").select("leaf_key", "local_id", "point_id")
    local = long.join(points, ["leaf_key", "point_id"]).groupBy("leaf_key", "cell_id").agg(*(F.max(F.when(F.col("i") == i, F.col("local_id"))).alias(f"v{i}") for i in range(4)))
    ranked = _ranks(local, ordered.select("leaf_key", bucket("cell_id").alias("bucket")), F.col("cell_id"), bucket("cell_id"), "local_cell")
    return points, ranked.select("leaf_key", "local_cell", "v0", "v1", "v2", "v3")


def block_values(block_points: DataFrame, fields: DataFrame) -> DataFrame:
    return block_points.join(fields, "point_id").select("leaf_key", "local_id", "name", "value")


def block_sizes(nodes: DataFrame, leaf_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """leaf_key, depth, cells, verts for every leaf, empty ones too."""
    vertices = leaf_cells.join(cells.select("cell_id", F.array("v0", "v1", "v2", "v3").alias("v")), "cell_id").select("leaf_key", F.explode("v").alias("point_id")).distinct()
    verts = vertices.groupBy("leaf_key").agg(F.count("*").alias("verts"))
    return nodes.where("is_leaf").select(F.col("node_key").alias("leaf_key"), "depth", F.col("cell_count").alias("cells")).join(verts, "leaf_key", "left").withColumn("verts", F.coalesce("verts", F.lit(0)))


def interior_vertices(block_points: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """leaf_key, interior: how many of a block's vertices lie inside its leaf's box."""
    boxes = nodes.where("is_leaf").select(F.col("node_key").alias("leaf_key"), *(f"{a}{i}" for a in "xyz" for i in "01"))
    inside = in_box(tuple(F.col(a) for a in "xyz"), tuple(F.col(f"{a}0") for a in "xyz"), tuple(F.col(f"{a}1") for a in "xyz"))
    return block_points.join(points.select("point_id", "x", "y", "z"), "point_id").join(boxes, "leaf_key").groupBy("leaf_key").agg(F.count_if(inside).alias("interior"))


def fetch(blocks: DataFrame, wanted: DataFrame, columns: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows of the blocks whose leaf_key is wanted; only the columns that are needed are read.

    known: leaf_key of all leaves; with it, ids that aren't among them are an error.
    """
    if known is not None:
        missing = [r.leaf_key for r in wanted.select("leaf_key").distinct().join(known, "leaf_key", "left_anti").limit(10).collect()]
        if missing:
            raise KeyError(f"no such blocks: {missing}")
    return (blocks if columns is None else blocks.select("leaf_key", *columns)).join(wanted.select("leaf_key").distinct(), "leaf_key", "left_semi")


def _filled(flat: Column, filler: Column, length: int) -> Column:
    return F.slice(F.concat(flat, F.array_repeat(filler, length)), 1, length)


def padded(block_cells: DataFrame, stride: int) -> DataFrame:
    """leaf_key, connectivity: the local vertices of all cells in order, filled with 0 up to 4 * stride."""
    ordered = block_cells.groupBy("leaf_key").agg(F.sort_array(F.collect_list(F.struct("local_cell", F.array("v0", "v1", "v2", "v3").alias("v")))).alias("c"))
    return ordered.select("leaf_key", _filled(F.flatten(F.transform("c", lambda s: s["v"])), F.lit(0), 4 * stride).alias("connectivity"))


def padded_positions(block_points: DataFrame, points: DataFrame, stride: int) -> DataFrame:
    """leaf_key, positions: x, y, z of all vertices in their local order, filled with 0 up to 3 * stride."""
    placed = block_points.join(points.select("point_id", "x", "y", "z"), "point_id").groupBy("leaf_key").agg(F.sort_array(F.collect_list(F.struct("local_id", F.array("x", "y", "z").alias("p")))).alias("c"))
    return placed.select("leaf_key", _filled(F.flatten(F.transform("c", lambda s: s["p"])), F.lit(0.0), 3 * stride).alias("positions"))


def padded_values(values: DataFrame, stride: int) -> DataFrame:
    """leaf_key, name, values: of ``block_values``, in the vertices' local order, filled with 0 up to stride."""
    ordered = values.groupBy("leaf_key", "name").agg(F.sort_array(F.collect_list(F.struct("local_id", F.col("value").cast("double").alias("value")))).alias("c"))
    return ordered.select("leaf_key", "name", _filled(F.transform("c", lambda s: s["value"]), F.lit(0.0), stride).alias("values"))


def response_bytes(blocks: int | Column, max_verts: int, max_cells: int, scalars: int, geometry: bool) -> int | Column:
    return blocks * (4 * ((3 * max_verts + 4 * max_cells if geometry else 0) + max_verts * scalars))


def batches(wanted: DataFrame) -> DataFrame:
    """leaf_key, batch: ids in order, BATCH to a request. Ranks are those within ranges of ids plus what stands before,
    so no task ranks all of them."""
    ids = checkpointed(wanted.select("leaf_key").distinct().repartitionByRange("leaf_key").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("leaf_key"))
    return ids.join(starts, "part").select("leaf_key", F.floor((F.col("start") + rank - 1) / BATCH).alias("batch"))


def requests(wanted: DataFrame, max_verts: int, max_cells: int, scalars: int, geometry: bool) -> DataFrame:
    """batch, blocks, bytes of each request for the wanted blocks."""
    sizes = batches(wanted).groupBy("batch").agg(F.count("*").alias("blocks"))
    return sizes.select("batch", "blocks", response_bytes(F.col("blocks"), max_verts, max_cells, scalars, geometry).alias("bytes"))
