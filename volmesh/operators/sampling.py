"""Points in a mesh: the leaf and the cell that hold them, and values there.

geometry: cell_id, v (array of the four point ids), corners (array of struct<x, y, z>).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volmesh.common import broadcast_if_few, checkpointed, shuffled
from volmesh.functions.geometry import tet_volume
from volmesh.operators.mesh import VERTICES, all_of, cell_corners


def geometry_of(cells: DataFrame, points: DataFrame) -> DataFrame:
    return shuffled(cells.select("cell_id", F.array(*VERTICES).alias("v"))).join(cell_corners(cells, points), "cell_id")


def locate(probes: DataFrame, nodes: DataFrame, tie: str = "left") -> DataFrame:
    """probes (probe_id, x, y, z) with leaf_key: the leaf that holds them, null outside the root's box.

    A point on a split plane is in the left child (tie: left) or in the right one. Points go down one level a
    round, all at once; each round joins the splits of one level, which are few for most of the way.
    """
    root = nodes.where("node_key = 1").select(*(F.col(f"{a}{i}").alias(f"r{a}{i}") for a in "xyz" for i in "01"))
    inside = all_of([(F.col(a) >= F.col(f"r{a}0")) & (F.col(a) <= F.col(f"r{a}1")) for a in "xyz"])
    at = probes.join(F.broadcast(root)).withColumn("leaf_key", F.when(inside, F.lit(1).cast("long"))).select("probe_id", "x", "y", "z", "leaf_key")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    splits = nodes.where("NOT is_leaf").select(F.col("node_key").alias("leaf_key"), F.col("split_val").cast("double").alias("s"), "depth")
    for depth in range(deepest):
        level = splits.where(F.col("depth") == depth).drop("depth")
        coordinate = F.col("xyz"[depth % 3])
        right = coordinate > F.col("s") if tie == "left" else coordinate >= F.col("s")
        small = depth < 18  # at most 2 ** depth splits
        at = at.join(F.broadcast(level) if small else level, "leaf_key", "left").select("probe_id", "x", "y", "z", F.when(F.col("s").isNull(), F.col("leaf_key")).otherwise(F.col("leaf_key") * 2 + right.cast("long")).alias("leaf_key"))
    return at


def _once(df: DataFrame, columns: list[Column]) -> DataFrame:
    """df with these (named) columns, computed once: filters that Spark infers from later joins stop at a generator, and
    don't compute them again."""
    return df.withColumn("once", F.explode(F.array(F.struct(*columns)))).select(*df.columns, "once.*")


_CORNER = [tuple(f"{a}_{i}" for a in "xyz") for i in range(4)]


def _volumes() -> list[Column]:
    """p_0 .. p_3, whole: six times the signed volumes of a cell (x_0 .. z_3) with the point x, y, z for each of its corners
    in turn, and its own; plain arithmetic, for which Spark generates code."""
    p, v = tuple(F.col(a) for a in "xyz"), [tuple(map(F.col, c)) for c in _CORNER]
    return [*(tet_volume(*(p if i == j else v[j] for j in range(4))).alias(f"p_{i}") for i in range(4)), tet_volume(*v).alias("whole")]


def _wide(geometry: DataFrame, eps: float) -> DataFrame:
    """cell_id, v, x_0 .. z_3 (the corners), lx .. hz: where a weight of -eps may lie at most."""
    flat = _once(geometry.select("cell_id", "v", "corners"), [F.col("corners")[i][a].alias(_CORNER[i][k]) for i in range(4) for k, a in enumerate("xyz")]).drop("corners")
    least, most = ([f(*(c[k] for c in _CORNER)) for k in range(3)] for f in (F.least, F.greatest))
    # A weight of -eps lies within eps times the cell's extent of its bounds, three times over at the corners.
    low, high = ([f(p, q) for p, q in zip(least, most, strict=True)] for f in (lambda l, h: l - 4 * eps * (h - l), lambda l, h: h + 4 * eps * (h - l)))
    return _once(flat, [c.alias(f"{n}{a}") for n, side in (("l", low), ("h", high)) for a, c in zip("xyz", side, strict=True)])


def cells_of_leaves(leaf_cells: DataFrame, geometry: DataFrame, eps: float = 0.005) -> DataFrame:
    """leaf_key and what _wide gives of the leaves' cells."""
    wide = _wide(geometry, eps)
    return leaf_cells.join(wide, "cell_id").select("leaf_key", *wide.columns)


#: Exponent of the least step of a grid: places under 2 ** 13 are told apart by 53 bits.
LEAST_LEVEL = -40


def _step(level: str = "level") -> Column:
    return F.pow(F.lit(2.0), F.col(level))


def _level() -> Column:
    """The exponent of the step of a cell's grid: the power of two from its longest side on."""
    longest = F.greatest(*(F.col(f"h{a}") - F.col(f"l{a}") for a in "xyz")) * (1 + 1e-9)
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.when(longest > 0, longest)))).cast("int")


def _placed(cells: DataFrame) -> DataFrame:
    """cells (of _wide) with level and gx, gy, gz: their grid, and the grid's cell that holds their low corner."""
    return _once(_once(cells, [_level().alias("level")]), [F.floor(F.col(f"l{a}") / _step()).alias(f"g{a}") for a in "xyz"])


def cell_levels(geometry: DataFrame, eps: float = 0.005) -> DataFrame:
    """level: the grids that cells lie in, as many as there are exponents."""
    return _wide(geometry, eps).select(_level().alias("level")).distinct()


def _dealt(probes: DataFrame, levels: DataFrame) -> DataFrame:
    """in_leaf, probe_id, x, y, z of probes (with leaf_key) with at_level, at_x, at_y, at_z: where cells that hold them may
    lie in each grid."""
    p = probes.where("leaf_key IS NOT NULL").select("probe_id", F.col("leaf_key").alias("in_leaf"), *(F.col(a).cast("double").alias(a) for a in "xyz")).join(F.broadcast(levels.withColumnRenamed("level", "at_level")))
    for a in "xyz":
        here = F.floor(F.col(a) / _step("at_level"))
        p = p.withColumn(f"at_{a}", F.explode(F.sequence(here - 1, here)))
    return p


def _meets() -> list[Column]:
    return [F.col("at_level") == F.col("level"), *(F.col(f"at_{a}") == F.col(f"g{a}") for a in "xyz")]


#: Up to so many places of grids are broadcast to find the cells there.
MOST_PLACES = 200_000


def near_cells(probes: DataFrame, geometry: DataFrame, levels: DataFrame, eps: float = 0.005) -> DataFrame | None:
    """The cells of geometry that may hold some probe (with leaf_key), by their place in their grid (levels: of cell_levels).
    No cell is moved for that; None where probes are in over MOST_PLACES places."""
    places = checkpointed(_dealt(probes, levels).select("at_level", *(f"at_{a}" for a in "xyz")).distinct())
    if places.limit(MOST_PLACES + 1).count() > MOST_PLACES:
        return None
    near = _placed(_wide(geometry, eps)).join(F.broadcast(places), all_of(_meets()), "left_semi")
    corners = F.array(*(F.struct(*(F.col(n).alias(a) for n, a in zip(c, "xyz", strict=True))) for c in _CORNER))
    return checkpointed(near.select("cell_id", "v", corners.alias("corners")))


def containing_cell(probes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, eps: float = 0.005) -> DataFrame:
    """probe_id, cell_id, v, weights of the cell with the smallest id that holds each probe (with leaf_key).

    eps: how far below zero a barycentric weight may be. Cells without volume hold nothing. Cells are brought to
    their leaves first, and there they meet probes in grids, however many cells a leaf has: a cell lies in the grid whose
    step is the power of two from its longest side on, at its low corner, which is one step at most before a probe that it
    holds. The box test is part of the join, so only cells near a probe come out.
    """
    cells = _placed(cells_of_leaves(leaf_cells, geometry, eps))
    p = shuffled(_dealt(probes, cell_levels(geometry, eps)))
    near = all_of([F.col(a).between(F.col(f"l{a}"), F.col(f"h{a}")) for a in "xyz"])
    met = p.join(cells, all_of([F.col("in_leaf") == F.col("leaf_key"), *_meets()]) & near)
    weights = [F.col(f"p_{i}") / F.col("whole") for i in range(4)]
    # The volumes are computed after the box test of the join.
    held = _once(met, _volumes()).where("whole <> 0").where(all_of([w >= -eps for w in weights])).select("probe_id", "cell_id", "v", F.array(*weights).alias("weights"))
    return held.groupBy("probe_id").agg(F.min(F.struct("cell_id", "v", "weights")).alias("m")).select("probe_id", "m.cell_id", "m.v", "m.weights")


def sampled(held: DataFrame, fields: DataFrame) -> DataFrame:
    """probe_id, name, sample: the vertices' values by the weights."""
    long = held.select("probe_id", F.explode(F.arrays_zip("v", "weights")).alias("z")).select("probe_id", F.col("z.v").alias("point_id"), F.col("z.weights").alias("w"))
    return shuffled(long).join(fields, "point_id").groupBy("probe_id", "name").agg(F.sum(F.col("w") * F.col("value")).alias("sample"))


def sampled_or_nearest(probes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, fields: DataFrame, eps: float = 0.005) -> DataFrame:
    """probe_id, name, sample, found: the value in the cell that holds a probe (found: cell), else that of the nearest
    vertex in its leaf (vertex), else 0 (none), for every probe and field."""
    inside = checkpointed(sampled(containing_cell(probes, leaf_cells, geometry, eps), fields))
    every = shuffled(probes.select("probe_id").join(broadcast_if_few(fields.select("name").distinct(), 1000)))
    # Only probes that lack the sample of some field are brought to vertices.
    lacking = every.join(inside.where("sample IS NOT NULL"), ["probe_id", "name"], "left_anti").select("probe_id").distinct()
    alone = probes.join(lacking, "probe_id", "left_semi")
    near = nearest_in_leaf(alone, leaf_cells, geometry).join(fields, "point_id").select("probe_id", "name", F.col("value").alias("near"))
    both = every.join(inside, ["probe_id", "name"], "left").join(near, ["probe_id", "name"], "left")
    found = F.when(F.col("sample").isNotNull(), "cell").when(F.col("near").isNotNull(), "vertex").otherwise("none")
    return both.select("probe_id", "name", F.coalesce("sample", "near", F.lit(0.0)).alias("sample"), found.alias("found"))


def leaves_at(located: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """located (of ``locate``) with depth, cell_count, box (x0 .. z1) and leaf_index (of tree.leaf_index) of the leaf."""
    about = nodes.join(index.select("node_key", "leaf_index"), "node_key").select(F.col("node_key").alias("leaf_key"), "depth", "cell_count", "leaf_index", *(f"{a}{i}" for i in "01" for a in "xyz"))
    return located.join(about, "leaf_key", "left")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id: boxes (id, x0 .. z1) that overlap, touching included. Boxes with nulls overlap nothing.

    A box's level is that of the grid whose cells are as large as its longest side, the next power of two, so it lies in
    eight cells at most. Two boxes meet in the grid of the larger one: each box is dealt to its own level and to the
    coarser ones that the other table has. A pair comes from the first cell that both cover, once.
    """
    bounds = [f"{a}{i}" for a in "xyz" for i in "01"]
    sides = [df.select("id", *(F.col(b).cast("double").alias(b) for b in bounds)).dropna().where(" AND ".join(f"{a}0 <= {a}1" for a in "xyz")) for df in (left, right)]
    extent = F.greatest(*(F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"))
    widest = [df.agg(F.max(F.greatest(*(F.abs(b) for b in bounds)))).first()[0] or 1.0 for df in sides]
    # Cells that are numbered by more than 50 bits would not be told apart.
    least = math.ceil(math.log2(max(*widest, 1e-300))) - 50
    level = F.greatest(F.lit(least), F.ceil(F.log2(F.when(extent > 0, extent)))).cast("int")
    graded = [df.withColumn("own", level) for df in sides]
    levels = [[r.own for r in df.select("own").distinct().collect()] for df in graded]  # at most 51 and the exponents over them

    def dealt(df: DataFrame, others: list[int], name: str) -> DataFrame:
        up = F.array_union(F.array("own"), F.filter(F.array(*(F.lit(v) for v in others)).cast("array<int>"), lambda v: v > F.col("own")))
        wide = df.select("*", F.explode(up).alias("level")).withColumn("cell", F.pow(F.lit(2.0), F.col("level")))
        over = lambda a: F.sequence(F.floor(F.col(f"{a}0") / F.col("cell")), F.floor(F.col(f"{a}1") / F.col("cell")))
        for a in "xyz":
            wide = wide.withColumn(f"g{a}", F.explode(over(a)))
        return wide.select("level", "gx", "gy", "gz", F.col("own").alias(f"{name}_own"), F.col("id").alias(f"{name}_id"), *(F.col(b).alias(f"{name}_{b}") for b in bounds))

    first = lambda a: F.floor(F.greatest(f"l_{a}0", f"r_{a}0") / F.pow(F.lit(2.0), F.col("level")))
    meet = all_of([(F.col(f"l_{a}0") <= F.col(f"r_{a}1")) & (F.col(f"r_{a}0") <= F.col(f"l_{a}1")) & (F.col(f"g{a}") == first(a)) for a in "xyz"])
    both = shuffled(dealt(graded[0], levels[1], "l")).join(dealt(graded[1], levels[0], "r"), ["level", "gx", "gy", "gz"])
    return both.where(meet & (F.col("level") == F.greatest("l_own", "r_own"))).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


def nearest_in_leaf(probes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame) -> DataFrame:
    """probe_id, point_id, distance of the nearest vertex among the cells of the probe's leaf; ties by point_id.

    Vertices lie in a grid, and a probe sees the grid's cells around it. What it finds within a step is nearest; others
    are looked up again in a grid of twice the step, until all are found. The first step is such that a grid's cell has
    about one vertex.
    """
    cast = [F.col(f"c.corners.{a}").cast("double").alias(f"v{a}") for a in "xyz"]
    vertices = checkpointed(leaf_cells.join(geometry, "cell_id").select("leaf_key", F.explode(F.arrays_zip("v", "corners")).alias("c")).select("leaf_key", F.col("c.v").alias("point_id"), *cast).distinct())
    n = vertices.agg(F.count("*").alias("n"), *(f(f"v{a}").alias(f"{k}{a}") for a in "xyz" for k, f in (("l", F.min), ("h", F.max)))).first()
    some = vertices.select("leaf_key").distinct()
    left = checkpointed(probes.select("probe_id", "leaf_key", *(F.col(a).cast("double").alias(a) for a in "xyz")).where(all_of([F.abs(F.col(a)) < F.lit(math.inf) for a in "xyz"])).join(some, "leaf_key", "left_semi"))
    if not n.n or left.isEmpty():
        return left.select("probe_id", F.lit(None).cast(vertices.schema["point_id"].dataType).alias("point_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    sides = [n[f"h{a}"] - n[f"l{a}"] for a in "xyz"]
    wide = [s for s in sides if s > 0]
    far = left.agg(*(F.max(F.greatest(F.abs(F.col(a) - n[f"l{a}"]), F.abs(F.col(a) - n[f"h{a}"]))).alias(a) for a in "xyz")).first()
    furthest = math.sqrt(sum(v * v for v in far)) * 2
    step = 2.0 ** math.ceil(math.log2((math.prod(wide) / n.n) ** (1 / len(wide)))) if wide else 1.0
    away = F.sqrt(sum(((F.col(a) - F.col(f"v{a}")) * (F.col(a) - F.col(f"v{a}")) for a in "xyz"), F.lit(0.0)))
    done = []
    while True:
        whole = step > furthest  # a ball of this radius holds all vertices
        around = left
        for a in "xyz":
            around = around.withColumn(f"g{a}", F.explode(F.sequence(F.floor((F.col(a) - step) / step), F.floor((F.col(a) + step) / step))))
        placed = vertices.withColumns({f"g{a}": F.floor(F.col(f"v{a}") / step) for a in "xyz"})
        pairs = shuffled(around).join(placed, ["leaf_key", "gx", "gy", "gz"]).withColumn("distance", away)
        if not whole:
            pairs = pairs.where(F.col("distance") <= step * (1 - 1e-9))
        found = checkpointed(pairs.groupBy("probe_id").agg(F.min(F.struct("distance", "point_id")).alias("m")).select("probe_id", "m.point_id", "m.distance"))
        done.append(found)
        left = checkpointed(left.join(found.select("probe_id"), "probe_id", "left_anti"))
        if whole or left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        step *= 2
