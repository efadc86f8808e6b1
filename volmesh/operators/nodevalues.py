"""Summaries of tree nodes: value ranges, corner values, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volmesh.common import broadcast_if_few, checkpointed
from volmesh.functions.geometry import hashed_unit, polynomial
from volmesh.operators.sampling import containing_cell, locate, nearest_in_leaf, sampled, sampled_or_nearest


def leaf_ranges(leaf_cells: DataFrame, cells: DataFrame, fields: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf_key, name, lo, hi over the vertices of a leaf's cells; a leaf without cells has 0 and 0."""
    vertices = leaf_cells.join(cells, "cell_id").select("leaf_key", F.explode(F.array("v0", "v1", "v2", "v3")).alias("point_id")).distinct()
    found = vertices.join(fields, "point_id").groupBy("leaf_key", "name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    names = fields.select("name").distinct()
    every = leaves.select(F.col("node_key").alias("leaf_key")).join(broadcast_if_few(names, 1000))
    return every.join(found, ["leaf_key", "name"], "left").select("leaf_key", "name", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"))


def _ancestors(key: Column, depth: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.call_function("shiftright", key, k))


def node_ranges(nodes: DataFrame, ranges: DataFrame, *, ignore_empty: bool = False) -> DataFrame:
    """node_key, name, lo, hi for every node: leaves feed all their ancestors at once.

    ignore_empty: leaves without cells don't widen the ranges above them.
    """
    leaves = nodes.where("is_leaf").select(F.col("node_key").alias("leaf_key"), "depth", "cell_count")
    fed = ranges.join(leaves, "leaf_key")
    if ignore_empty:
        fed = fed.where("cell_count > 0")
    return fed.select(F.explode(_ancestors(F.col("leaf_key"), F.col("depth"))).alias("node_key"), "name", "lo", "hi").groupBy("node_key", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def leaf_corners(leaves: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, values: DataFrame, missing: str = "zero", eps: float = 0.005) -> DataFrame:
    """node_key, name, corner, value: fields at the eight corners of each leaf's box (bit 0: x, 1: y, 2: z; set:
    the far side), from the containing cell with the smallest id.

    missing: what a corner outside all cells gets, zero or the value of the leaf's nearest vertex.
    """
    corners = leaves.select(F.col("node_key").alias("leaf_key"), F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), *(F.col(f"{a}{c >> i & 1}").alias(a) for i, a in enumerate("xyz"))) for c in range(8)))).alias("c")).select(
        (F.col("leaf_key") * 8 + F.col("c.corner")).alias("probe_id"), "leaf_key", "c.corner", "c.x", "c.y", "c.z"
    )
    held = containing_cell(corners, leaf_cells, geometry, eps)
    got = sampled(held, values).select("probe_id", "name", "sample")
    names = broadcast_if_few(values.select("name").distinct(), 1000)
    every = corners.join(names)
    if missing == "nearest":
        near = nearest_in_leaf(corners, leaf_cells, geometry).join(values, "point_id").select("probe_id", "name", F.col("value").alias("near"))
        every = every.join(near, ["probe_id", "name"], "left")
    else:
        every = every.withColumn("near", F.lit(0.0))
    return every.join(got, ["probe_id", "name"], "left").select(F.col("leaf_key").alias("node_key"), "name", "corner", F.coalesce("sample", "near", F.lit(0.0)).alias("value"))


def corner_values(nodes: DataFrame, corners: DataFrame) -> DataFrame:
    """node_key, name, corner, value for all nodes: a node's corner is that of the child on the corner's side.

    A leaf's corner feeds ancestors up to the first step of its path that leads away from the corner, so every
    node gets each corner once and nothing is iterated.
    """
    deep = nodes.select("node_key", "depth")
    fed = corners.join(deep, "node_key")
    key, depth, corner = F.col("node_key"), F.col("depth"), F.col("corner")
    bit = lambda value, at: F.call_function("shiftright", value, at).bitwiseAND(1)
    # Steps up (0: the leaf itself) while the path's bit at that step is the corner's bit of its axis.
    fits = lambda up: F.forall(F.filter(F.sequence(F.lit(0), depth), lambda d: (d >= depth - up) & (d < depth)), lambda d: bit(key, depth - 1 - d) == bit(corner, d % 3))
    ups = F.filter(F.sequence(F.lit(0), depth), fits)
    return fed.select(F.explode(F.transform(ups, lambda up: F.call_function("shiftright", key, up))).alias("node_key"), "name", "corner", "value")


def node_averages(nodes: DataFrame, leaf_averages: DataFrame) -> DataFrame:
    """node_key, name, average: leaves' averages weighted by the share of the node's volume."""
    volume = F.expr("(x1 - x0) * (y1 - y0) * (z1 - z0)")
    leaves = nodes.where("is_leaf").select(F.col("node_key").alias("leaf_key"), "depth", volume.alias("leaf_volume"))
    fed = leaf_averages.join(leaves, "leaf_key").select(F.explode(_ancestors(F.col("leaf_key"), F.col("depth"))).alias("node_key"), "name", "average", "leaf_volume")
    return fed.groupBy("node_key", "name").agg((F.sum(F.col("average") * F.col("leaf_volume")) / F.sum("leaf_volume")).alias("average"))


def random_points(leaves: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """probe_id (leaf's key times k plus the number), leaf_key, i, x, y, z: k points in each leaf's box."""
    each = leaves.select(F.col("node_key").alias("leaf_key"), *(f"{a}{i}" for a in "xyz" for i in "01"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    at = lambda a, n: F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * hashed_unit(F.lit(seed), F.col("leaf_key"), F.col("i"), F.lit(n))
    return each.select((F.col("leaf_key") * k + F.col("i")).alias("probe_id"), "leaf_key", "i", *(at(a, n).alias(a) for n, a in enumerate("xyz")))


def random_vertices(block_points: DataFrame, seed: int = 1) -> DataFrame:
    """leaf_key, local_id, point_id: a vertex of each block that has some."""
    counts = block_points.groupBy("leaf_key").agg(F.count("*").alias("n"))
    chosen = counts.select("leaf_key", F.floor(F.col("n") * hashed_unit(F.lit(seed), F.col("leaf_key"))).alias("local_id"))
    return block_points.join(chosen, ["leaf_key", "local_id"]).select("leaf_key", "local_id", "point_id")


def sampled_averages(leaves: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, values: DataFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """leaf_key, name, average: the mean of k random samples in each leaf's box; ``node_averages`` takes it upwards."""
    at = random_points(leaves, k, seed)
    samples = sampled_or_nearest(at, leaf_cells, geometry, values).join(at.select("probe_id", "leaf_key"), "probe_id")
    return samples.groupBy("leaf_key", "name").agg(F.avg("sample").alias("average"))


TERMS = 8


def fit_polynomials(samples: DataFrame) -> DataFrame:
    """leaf_key, name, coefficients (8) by least squares on samples (leaf_key, name, x, y, z, value), some tens of
    each leaf; a singular system or samples that are all zero give zeros. Many leaves are solved in one batch."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("leaf_key", pa.int64()), ("name", pa.string()), ("coefficients", pa.list_(pa.float64()))])

    def solve(rows: np.ndarray) -> list[float]:
        x, y, z, v = rows.T
        m = np.stack([np.ones_like(x), x, y, z, x * y, x * z, y * z, x * y * z], axis=1)
        if not v.any() or np.linalg.matrix_rank(m) < TERMS:
            return [0.0] * TERMS
        return np.linalg.lstsq(m, v, rcond=None)[0].tolist()

    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            ends = np.cumsum([len(s) for s in batch.column(2)]) // 4
            fitted = [solve(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fitted, schema.field(2).type)], schema=schema)

    grouped = samples.groupBy("leaf_key", "name").agg(F.flatten(F.collect_list(F.array(*(F.col(c).cast("double") for c in ("x", "y", "z", "value"))))).alias("s"))
    return grouped.mapInArrow(run, "leaf_key long, name string, coefficients array<double>")


def refitted(nodes: DataFrame, fitted: DataFrame, samples: int = 32, seed: int = 2) -> DataFrame:
    """node_key, name, coefficients for all nodes: those of the leaves (fitted: leaf_key, name, coefficients), and above
    them, level by level from the deepest, fits to random samples of the children's polynomials."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    known = checkpointed(fitted.select(F.col("leaf_key").alias("node_key"), "name", "coefficients"))
    for depth in range(deepest - 1, -1, -1):
        inner = nodes.where((F.col("depth") == depth) & ~F.col("is_leaf"))
        axis = F.col("xyz"[depth % 3])
        at = random_points(inner, samples, seed).join(inner.select(F.col("node_key").alias("leaf_key"), "split_val"), "leaf_key")
        child = F.col("leaf_key") * 2 + (axis > F.col("split_val").cast("double")).cast("long")
        values = at.withColumn("node_key", child).join(known, "node_key").select("leaf_key", "name", "x", "y", "z", polynomial(F.col("coefficients"), F.col("x"), F.col("y"), F.col("z")).alias("value"))
        known = checkpointed(known.unionByName(fit_polynomials(values).withColumnRenamed("leaf_key", "node_key")))
    return known


def corner_arrays(corners: DataFrame) -> DataFrame:
    """node_key, name, corners: the eight corner values as an array."""
    return corners.groupBy("node_key", "name").agg(*(F.max(F.when(F.col("corner") == c, F.col("value"))).alias(f"c{c}") for c in range(8))).select("node_key", "name", F.array(*(f"c{c}" for c in range(8))).alias("corners"))


def between_corners(point: tuple[Column, Column, Column], corners: Column) -> Column:
    """The trilinear value of the corners of the box x0 .. z1 at a point; points outside count as at the box's side."""
    part = lambda a, p: F.when(F.col(f"{a}1") > F.col(f"{a}0"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(p - F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"{a}0"))))).otherwise(F.lit(0.0))
    x, y, z = (part(a, p) for a, p in zip("xyz", point, strict=True))
    mix = lambda a, b, t: a * (1 - t) + b * t
    c = [F.element_at(corners, i + 1) for i in range(8)]
    in_z = [mix(c[i], c[i + 4], z) for i in range(4)]
    in_y = [mix(in_z[i], in_z[i + 2], y) for i in range(2)]
    return mix(in_y[0], in_y[1], x)


def interpolated(located: DataFrame, nodes: DataFrame, corners: DataFrame) -> DataFrame:
    """probe_id, name, sample at located points (probe_id, x, y, z, leaf_key) from the corner values of their leaf."""
    boxes = nodes.select(F.col("node_key").alias("leaf_key"), *(f"{a}{i}" for a in "xyz" for i in "01"))
    arrays = corner_arrays(corners).withColumnRenamed("node_key", "leaf_key")
    return located.join(boxes, "leaf_key").join(arrays, "leaf_key").select("probe_id", "name", between_corners(tuple(F.col(a) for a in "xyz"), F.col("corners")).alias("sample"))


#: How far beyond a leaf's sides neighbours are probed, and the least distance that counts; fixed values.
FACE_STEP, FACE_LEAST = 0.1, 0.01


def continuous(located: DataFrame, nodes: DataFrame, corners: DataFrame, loaded: DataFrame) -> DataFrame:
    """probe_id, name, sample: corner values smoothed across the leaves' faces.

    Six points just beyond the leaf's faces are weighted by the inverse of the face's distance. Each takes its value
    from the leaf that holds it if that one lies deeper and isn't loaded (loaded: node_key of leaves with cells at
    hand), otherwise from the point's own leaf.
    """
    sides = [(a, i) for a in "xyz" for i in (1, 0)]
    own = nodes.select(F.col("node_key").alias("leaf_key"), "depth", *(f"{a}{i}" for a in "xyz" for i in "01"))
    faced = located.where("leaf_key IS NOT NULL").join(own, "leaf_key")
    weight = lambda a, i: 1 / F.greatest(F.col(f"{a}1") - F.col(a) if i else F.col(a) - F.col(f"{a}0"), F.lit(FACE_LEAST))
    place = lambda a, i: [(F.col(f"{a}1") + FACE_STEP if i else F.col(f"{a}0") - FACE_STEP) if b == a else F.col(b) for b in "xyz"]
    faces = F.array(*(F.struct(F.lit(n).alias("face"), weight(a, i).alias("weight"), *(c.alias(f"p{b}") for b, c in zip("xyz", place(a, i), strict=True))) for n, (a, i) in enumerate(sides)))
    six = checkpointed(faced.select(F.col("probe_id").alias("of"), F.col("leaf_key").alias("own"), F.col("depth").alias("own_depth"), F.explode(faces).alias("f")).select("of", "own", "own_depth", (F.col("of") * 6 + F.col("f.face")).alias("probe_id"), "f.weight", *(F.col(f"f.p{a}").alias(a) for a in "xyz")))
    at = locate(six, nodes).select("probe_id", "leaf_key")
    about = nodes.select(F.col("node_key").alias("leaf_key"), F.col("depth").alias("near_depth")).join(loaded.select(F.col("node_key").alias("leaf_key"), F.lit(True).alias("loaded")), "leaf_key", "left")
    chosen = six.join(at, "probe_id").join(about, "leaf_key", "left")
    chosen = chosen.withColumn("leaf_key", F.when((F.col("near_depth") > F.col("own_depth")) & F.col("loaded").isNull(), F.col("leaf_key")).otherwise(F.col("own")))
    values = interpolated(chosen.select("probe_id", "x", "y", "z", "leaf_key"), nodes, corners).join(six.select("probe_id", "of", "weight"), "probe_id")
    return values.groupBy(F.col("of").alias("probe_id"), "name").agg((F.sum(F.col("weight") * F.col("sample")) / F.sum("weight")).alias("sample"))


def frontier_corners(frontier: DataFrame, corners: DataFrame, name: str) -> DataFrame:
    """node_key, corners of each node of a frontier for a field; an error if the field has none."""
    arrays = corner_arrays(corners.where(F.col("name") == name))
    if arrays.isEmpty():
        raise ValueError(f"{name} has no corner values")
    return frontier.select("node_key").join(arrays, "node_key").select("node_key", "corners")
