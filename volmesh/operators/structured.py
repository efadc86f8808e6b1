"""Regular grids: points, tetrahedra, downsampling, sampling and decimation. x runs fastest in every index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volmesh.common import checkpointed, shuffled
from volmesh.functions.geometry import hashed_number

Size = tuple[int, int, int]

#: Corners of a cube (bit 0: x, bit 1: y, bit 2: z) in each tetrahedron; fixed values.
SIX_TETS = ((1, 0, 5, 7), (0, 5, 7, 4), (0, 7, 6, 4), (0, 7, 2, 6), (0, 3, 2, 7), (0, 1, 3, 7))
FIVE_TETS = ((0, 1, 2, 4), (1, 3, 2, 7), (4, 7, 5, 1), (4, 7, 2, 6), (1, 2, 4, 7))


def grid_points(spark: SparkSession, size: Size) -> DataFrame:
    """point_id, x, y, z of every vertex."""
    sx, sy, sz = size
    i = F.col("id")
    return spark.range(sx * sy * sz).select(i.alias("point_id"), (i % sx).cast("double").alias("x"), (F.expr(f"id div {sx}") % sy).cast("double").alias("y"), F.expr(f"id div {sx * sy}").cast("double").alias("z"))


def function_volume(spark: SparkSession, size: Size, value: Column) -> DataFrame:
    """x, y, z, value: a function of the columns x, y, z, zero where it is below."""
    return grid_points(spark, size).select("x", "y", "z", F.greatest(F.lit(0.0), value).alias("value"))


def grid_tets(spark: SparkSession, size: Size, tets: int = 6) -> DataFrame:
    """cell_id, v0 .. v3, and the cell's cube (cx, cy, cz) and pattern: six or five tetrahedra a cube.

    Cubes are numbered with x fastest; cell_id is the cube's number times ``tets`` plus the pattern.
    """
    sx, sy, sz = size
    patterns = SIX_TETS if tets == 6 else FIVE_TETS
    cubes = spark.range((sx - 1) * (sy - 1) * (sz - 1)).select(F.col("id").alias("cube"), (F.col("id") % (sx - 1)).alias("cx"), (F.expr(f"id div {sx - 1}") % (sy - 1)).alias("cy"), F.expr(f"id div {(sx - 1) * (sy - 1)}").alias("cz"))
    first = F.col("cx") + F.col("cy") * sx + F.col("cz") * sx * sy
    offset = lambda c: (c & 1) + (c >> 1 & 1) * sx + (c >> 2) * sx * sy
    shapes = F.array(*(F.struct(*(F.lit(offset(c)).cast("long").alias(f"o{i}") for i, c in enumerate(p))) for p in patterns))
    return cubes.select("cube", "cx", "cy", "cz", first.alias("first"), F.posexplode(shapes).alias("pattern", "o")).select(
        (F.col("cube") * tets + F.col("pattern")).alias("cell_id"), *((F.col("first") + F.col(f"o.o{i}")).alias(f"v{i}") for i in range(4)), "cx", "cy", "cz", "pattern"
    )


def grid_cell_bounds(spark: SparkSession, size: Size) -> DataFrame:
    """cell_id, x0 .. z1 of six tetrahedra a cube, from the cube alone: each of these fills its cube's box or
    leaves out no extent, so no vertex is looked up."""
    cells = grid_tets(spark, size, 6)
    low = {a: F.array(*(F.lit(min(c >> i & 1 for c in p)) for p in SIX_TETS)) for i, a in enumerate("xyz")}
    high = {a: F.array(*(F.lit(max(c >> i & 1 for c in p)) for p in SIX_TETS)) for i, a in enumerate("xyz")}
    at = F.col("pattern") + 1
    return cells.select("cell_id", *((F.col(f"c{a}") + F.element_at(low[a], at)).cast("double").alias(f"{a}0") for a in "xyz"), *((F.col(f"c{a}") + F.element_at(high[a], at)).cast("double").alias(f"{a}1") for a in "xyz"))


def grid_geometry(spark: SparkSession, size: Size) -> DataFrame:
    """cell_id, v, corners (see ``sampling``) of six tetrahedra a cube, from the cube alone: no vertex is looked up."""
    at = F.col("pattern") + 1
    bit = lambda i, axis: F.element_at(F.array(*(F.lit(p[i] >> axis & 1) for p in SIX_TETS)), at)
    corner = lambda i: F.struct(*((F.col(f"c{a}") + bit(i, axis)).cast("double").alias(a) for axis, a in enumerate("xyz")))
    return grid_tets(spark, size, 6).select("cell_id", F.array(*(f"v{i}" for i in range(4))).alias("v"), F.array(*map(corner, range(4))).alias("corners"))


def downsample(voxels: DataFrame, size: Size, scale: int) -> tuple[DataFrame, Size]:
    """Every scale-th voxel along each axis; the size is divided and rounded down."""
    new = tuple(s // scale for s in size)
    if scale <= 1:
        return voxels, size
    kept = voxels.where(" AND ".join(f"{a} % {scale} = 0 AND {a} < {n * scale}" for a, n in zip("xyz", new, strict=True)))
    return kept.withColumns({a: (F.col(a) / scale).cast(voxels.schema[a].dataType) for a in "xyz"}), new


def scaled(points: DataFrame, cell_size: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({a: F.col(a) * float(s) for a, s in zip("xyz", cell_size, strict=True)})


def to_unstructured(voxels: DataFrame, size: Size, tets: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points, cells, fields of a structured volume."""
    spark = voxels.sparkSession
    fields = voxels.select((F.col("x") + F.col("y") * size[0] + F.col("z") * size[0] * size[1]).cast("long").alias("point_id"), F.lit("value").alias("name"), F.col("value").cast("double").alias("value"))
    return grid_points(spark, size), grid_tets(spark, size, tets).select("cell_id", "v0", "v1", "v2", "v3"), fields


def trilinear(points: DataFrame, voxels: DataFrame, size: Size, *, swapped_weights: bool = False) -> DataFrame:
    """points (x, y, z and any columns) with sample: the trilinear value, null outside the volume; every row of points,
    repeated ones too, is a row.

    swapped_weights: the lower corner gets the fraction and the upper one its complement, as in transferred fields
    of older data.
    """
    # A sample depends on the place alone: repeated places are looked up once, and no other column takes part.
    inside = " AND ".join(f"{a} BETWEEN 0 AND {s - 1}" for a, s in zip("xyz", size, strict=True))
    places = points.where(inside).select(*(F.col(a).cast("double").alias(f"at_{a}") for a in "xyz")).distinct()
    corners = F.array(*(F.struct(*(F.lit(c >> i & 1).alias(f"d{a}") for i, a in enumerate("xyz"))) for c in range(8)))
    wide = places.select("*", F.explode(corners).alias("c"))
    base = lambda a, s: F.least(F.floor(f"at_{a}"), F.lit(max(0, s - 2)))
    weight = F.lit(1.0)
    for a, s in zip("xyz", size, strict=True):
        part = F.col(f"at_{a}") - base(a, s)
        upper = F.col(f"c.d{a}") == 1
        weight = weight * F.when(upper != F.lit(swapped_weights), part).otherwise(1 - part)
    at = [f"at_{a}" for a in "xyz"]
    wide = wide.select(*at, weight.alias("w"), *((base(a, s) + F.col(f"c.d{a}")).cast("long").alias(f"g{a}") for a, s in zip("xyz", size, strict=True)))
    grid = voxels.select(*(F.col(a).cast("long").alias(f"g{a}") for a in "xyz"), F.col("value").cast("double").alias("corner"))
    # Corners with weight 0 may lie outside a volume that is one voxel thick.
    summed = shuffled(wide.where("w <> 0")).join(grid, ["gx", "gy", "gz"], "left").groupBy(*at).agg(F.sum(F.col("w") * F.col("corner")).alias("its_sample"))
    same = reduce(lambda p, q: p & q, (F.col(a).cast("double") == F.col(f"at_{a}") for a in "xyz"))
    return shuffled(points).join(summed, same, "left").select(*(c for c in points.columns if c != "sample"), F.col("its_sample").alias("sample"))


def transfer(points: DataFrame, box: tuple[tuple, tuple], voxels: DataFrame, size: Size, *, swapped_weights: bool = False) -> DataFrame:
    """point_id, value: a volume's field at points of a mesh, its box mapped onto the whole volume; of an axis along
    which the box is flat, onto the volume's near side."""
    along = lambda a, lo, hi, s: (F.col(a) - float(lo)) / float(hi - lo) * (s - 1) if hi > lo else F.lit(0.0)
    mapped = points.select("point_id", *(along(a, lo, hi, s).alias(a) for a, lo, hi, s in zip("xyz", *box, size, strict=True)))
    return trilinear(mapped, voxels, size, swapped_weights=swapped_weights).select("point_id", F.col("sample").alias("value"))


def decimation_map(spark: SparkSession, size: Size, share: float, seed: int = 1) -> DataFrame:
    """src, dst: inner vertices that collapse onto one of their six neighbours.

    Each vertex has a hashed rank, the boundary below all; a vertex goes to a hashed choice of its lower-ranked
    neighbours, so there are no cycles. The round(share * all) sources of the least second hash are taken, by a cutoff.
    """
    sx, sy, sz = size
    steps = (1, -1, sx, -sx, sx * sy, -sx * sy)
    at = lambda i: ((i % sx), (F.floor(i / sx) % sy), F.floor(i / (sx * sy)))

    def inner(i: Column) -> Column:
        x, y, z = at(i)
        return (x > 0) & (x < sx - 1) & (y > 0) & (y < sy - 1) & (z > 0) & (z < sz - 1)

    rank = lambda i: F.when(inner(i), hashed_number(F.lit(seed), i.cast("long"))).otherwise(F.lit(-1).cast("long"))
    points = spark.range(sx * sy * sz).select(F.col("id").alias("src")).where(inner(F.col("src")))
    choices = F.array(*(F.col("src") + s for s in steps))
    lower = F.filter(choices, lambda n: rank(n) < rank(F.col("src")))
    pick = F.element_at("lower", (hashed_number(F.lit(seed + 1), F.col("src")) % F.size("lower") + 1).cast("int"))
    chosen = points.withColumn("lower", lower).where("size(lower) > 0").select("src", pick.alias("dst"), hashed_number(F.lit(seed + 2), F.col("src")).alias("order"))
    return least_rows(chosen, "order", "src", round(sx * sy * sz * share)).drop("order")


def least_rows(rows: DataFrame, order: str, tie: str, count: int, bits: int = 32) -> DataFrame:
    """The ``count`` rows of least ``order`` (from 0 to 2 ** bits - 1), ties by ``tie``; all, if there are no more.

    A cutoff is found by counting: rows by the leading half of their order's bits, then those of the bin where the count
    is reached by the other half. Rows below it stay where they are; only those of one order are ranked.
    """
    half = bits // 2
    rows = checkpointed(rows)

    def cut(some: DataFrame, bin_: Column, want: int) -> tuple[int, int]:
        """The bin where ``want`` rows are reached (-1: none), and how many of them it has to give."""
        counts = some.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        row = counts.withColumn("upto", before).where(F.col("upto") >= want).orderBy("bin").limit(1).first()  # at most 2 ** half bins
        return (row["bin"], want - (row.upto - row.n)) if row else (-1, 0)

    if count <= 0:
        return rows.limit(0)
    high, rest = F.shiftright(order, half), F.col(order).bitwiseAND(F.lit((1 << half) - 1))
    first, left = cut(rows, high, count)
    if first < 0:
        return rows
    second, left = cut(rows.where(high == first), rest, left)
    value = first << half | second
    ties = rows.where(F.col(order) == value).withColumn("place", F.row_number().over(Window.orderBy(tie))).where(F.col("place") <= left).drop("place")
    return rows.where(F.col(order) < value).unionByName(ties)


def resolved_map(collapses: DataFrame) -> DataFrame:
    """src, dst with every chain followed to its end, by doubling: each round joins the map with itself."""
    now = checkpointed(collapses)
    while True:
        onward = now.select(F.col("src").alias("dst"), F.col("dst").alias("further"))
        now = checkpointed(now.join(onward, "dst", "left").select("src", F.coalesce("further", "dst").alias("dst"), F.col("further").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("src", "dst")
        now = now.select("src", "dst")


def collapsed(cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """cells with vertices replaced; those with two equal vertices go."""
    long = cells.select("cell_id", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("i", "src"))
    moved = shuffled(long).join(resolved, "src", "left").select("cell_id", "i", F.coalesce("dst", "src").alias("v"))
    wide = moved.groupBy("cell_id").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(4)))
    return wide.where(F.size(F.array_distinct(F.array("v0", "v1", "v2", "v3"))) == 4)


def difference(value: Column, axis: str) -> Column:
    """The forward difference of a column along an axis of a grid, the backward one at the far side."""
    along = Window.partitionBy(*(a for a in "xyz" if a != axis)).orderBy(axis)
    return F.coalesce(F.lead(value).over(along) - value, value - F.lag(value).over(along), F.lit(0.0))


def grid_derivative(voxels: DataFrame, axis: str) -> DataFrame:
    """voxels with d: the difference of value along an axis."""
    return voxels.withColumn("d", difference(F.col("value"), axis))


def _shifted(points: DataFrame, voxels: DataFrame, size: Size, moves: list[tuple[str, float]]) -> DataFrame:
    """points with s0, s1 ...: the volume's value at each point and moved along an axis by so much; null outside."""
    of = [f"of_{a}" for a in "xyz"]
    places = points.select(*(F.col(a).cast("double").alias(f"of_{a}") for a in "xyz")).dropna().distinct()
    at = lambda a, m: F.col(f"of_{a}") + m[1] if m and m[0] == a else F.col(f"of_{a}")
    every = F.array(*(F.struct(F.lit(i).alias("move"), *(at(a, m).alias(a) for a in "xyz")) for i, m in enumerate([None, *moves])))
    long = places.select(*of, F.explode(every).alias("p")).select(*of, "p.move", "p.x", "p.y", "p.z")
    found = trilinear(long, voxels, size).groupBy(*of).agg(*(F.max(F.when(F.col("move") == i, F.col("sample"))).alias(f"s{i}") for i in range(len(moves) + 1)))
    same = reduce(lambda p, q: p & q, (F.col(a).cast("double") == F.col(f"of_{a}") for a in "xyz"))
    return shuffled(points).join(found, same, "left").drop(*of)


#: Steps of the derivative at points, and of the gradient that shades surfaces; fixed values.
DERIVATIVE_STEP, GRADIENT_STEP = 2.0**-6, 0.5


def derivative_at(points: DataFrame, voxels: DataFrame, size: Size, axis: str) -> DataFrame:
    """points (a key, x, y, z) with d: the forward difference; where that leaves the volume, the backward one; where
    neither is there, 0."""
    found = _shifted(points, voxels, size, [(axis, DERIVATIVE_STEP), (axis, -DERIVATIVE_STEP)])
    return found.withColumn("d", F.coalesce((F.col("s1") - F.col("s0")) / DERIVATIVE_STEP, (F.col("s0") - F.col("s2")) / DERIVATIVE_STEP, F.lit(0.0))).drop("s0", "s1", "s2")


def gradient_at(points: DataFrame, voxels: DataFrame, size: Size) -> DataFrame:
    """points (a key, x, y, z) with gx, gy, gz for normals: along each axis the difference from a step before; close to
    the near side, that to a step after, which keeps its sign turned (value here less value there)."""
    moves = [(a, s * GRADIENT_STEP) for a in "xyz" for s in (-1, 1)]
    found = _shifted(points, voxels, size, moves)
    parts = {f"g{a}": F.when(F.col(a) > GRADIENT_STEP, (F.col(f"s{2 * i + 1}") - F.col("s0"))).otherwise(F.col("s0") - F.col(f"s{2 * i + 2}")) / GRADIENT_STEP for i, a in enumerate("xyz")}
    return found.withColumns(parts).drop(*(f"s{i}" for i in range(7)))


def axis_source(points: DataFrame, axis: str) -> DataFrame:
    """point_id, name, value: a coordinate as a field of that name."""
    return points.select("point_id", F.lit(axis).alias("name"), F.col(axis).cast("double").alias("value"))
