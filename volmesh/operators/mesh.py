"""Meshes of points, cells and fields: mirror, bounds, limits, boundary geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volmesh.common import shuffled

VERTICES = ("v0", "v1", "v2", "v3")
#: Boundary parts that aren't shown unless asked for; fixed values.
HIDDEN_PARTS = ("symmetry", "downstream", "upstream", "side", "lower", "upper")
#: Element code of tetrahedra and of triangles in element sections; fixed values.
TET, TRIANGLE = 10, 5


def mirrored(points: DataFrame, cells: DataFrame, fields: DataFrame, planes: dict[str, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """2 ** k copies over k planes (axis to coordinate); copy i is flipped along the j-th plane if bit j of i is set."""
    if not planes:
        return points, cells, fields
    n = points.agg(F.max("point_id") + 1).first()[0] or 0
    m = cells.agg(F.max("cell_id") + 1).first()[0] or 0
    copies = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(planes) - 1))).alias("copy")
    flips = {a: F.when(F.col("copy").bitwiseAND(1 << j) != 0, 2 * float(p) - F.col(a)).otherwise(F.col(a)) for j, (a, p) in enumerate(sorted(planes.items()))}
    new_points = points.select("*", copies).withColumns(flips).withColumn("point_id", F.col("point_id") + F.col("copy") * n).drop("copy")
    new_cells = cells.select("*", copies).withColumns({"cell_id": F.col("cell_id") + F.col("copy") * m, **{v: F.col(v) + F.col("copy") * n for v in VERTICES}}).drop("copy")
    new_fields = fields.select("*", copies).withColumn("point_id", F.col("point_id") + F.col("copy") * n).drop("copy")
    return new_points, new_cells, new_fields


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*(F.min(a).alias(f"{a}0") for a in "xyz"), *(F.max(a).alias(f"{a}1") for a in "xyz"))


def limits(fields: DataFrame) -> DataFrame:
    return fields.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def select_scalars(fields: DataFrame, choice: str | list[str] = "all") -> DataFrame:
    """all, none, first (by name), or the named ones that exist."""
    if choice == "all":
        return fields
    if choice == "none":
        return fields.where(F.lit(False))
    if choice == "first":
        least = fields.agg(F.min("name").alias("name"))
        return fields.join(F.broadcast(least), "name", "left_semi")
    return fields.where(F.col("name").isin(list(choice)))


def arrays(fields: DataFrame) -> DataFrame:
    return fields.select("name", F.lit("data").alias("array_type")).distinct()


def tetrahedra(elements: DataFrame) -> DataFrame:
    """cells from element sections (section, elem_type, elem_id, verts from 1 on): tetrahedra only."""
    return elements.where(F.col("elem_type") == TET).select(F.col("elem_id").alias("cell_id"), *((F.element_at("verts", i + 1) - 1).alias(v) for i, v in enumerate(VERTICES)))


def _place(corner: Column) -> Column:
    return F.struct(*(corner[a].cast("double").alias(a) for a in "xyz"))


def cell_corners(cells: DataFrame, points: DataFrame) -> DataFrame:
    """cell_id and an array ``corners`` of struct<x, y, z>, by one join on points for all four vertices."""
    long = cells.select("cell_id", F.posexplode(F.array(*VERTICES)).alias("i", "point_id"))
    found = shuffled(long).join(points.select("point_id", "x", "y", "z"), "point_id").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y", "z"))).alias("c"))
    return found.select("cell_id", F.transform("c", _place).alias("corners"))


def cell_bounds(cells: DataFrame, points: DataFrame) -> DataFrame:
    """cell_id, x0 .. z1."""
    long = cells.select("cell_id", F.explode(F.array(*VERTICES)).alias("point_id"))
    return shuffled(long).join(points.select("point_id", "x", "y", "z"), "point_id").groupBy("cell_id").agg(*(F.min(a).cast("double").alias(f"{a}0") for a in "xyz"), *(F.max(a).cast("double").alias(f"{a}1") for a in "xyz"))


def boundary_geometry(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tris: name, tri_id, a, b, c, show_by_default; vertices: local_id, point_id) from name, tri_id, verts.

    Vertices are numbered as they first appear in order of name, triangle and corner. Order within each part is
    ranked per part, parts are offset by the counts before them.
    """
    long = triangles.select("name", "tri_id", F.posexplode("verts").alias("i", "point_id"))
    first = long.groupBy("point_id").agg(F.min(F.struct("name", "tri_id", "i")).alias("at"))
    within = first.withColumn("rank", F.row_number().over(Window.partitionBy("at.name").orderBy("at")))
    counts = within.groupBy(F.col("at.name").alias("part")).agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    vertices = within.join(F.broadcast(offsets), F.col("at.name") == F.col("part")).select((F.col("before") + F.col("rank") - 1).alias("local_id"), "point_id")
    tris = long.join(vertices, "point_id").groupBy("name", "tri_id").agg(*(F.max(F.when(F.col("i") == i, F.col("local_id"))).alias(c) for i, c in enumerate("abc")))
    return tris.withColumn("show_by_default", ~F.lower("name").isin(*HIDDEN_PARTS)), vertices


def as_absolute(value: str | float, largest: int) -> int:
    """A count, or a percentage of the largest; clamped to 0 .. largest."""
    number = round(largest * float(value.rstrip("%")) / 100) if isinstance(value, str) and value.endswith("%") else int(float(value))
    return max(0, min(largest, number))


def size_label(sizes: Column | None, count: Column | None = None) -> Column:
    return F.array_join(sizes.cast("array<string>"), "x") if sizes is not None else F.concat(count.cast("string"), F.lit(" u"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
