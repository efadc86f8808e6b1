"""Derivatives and derived fields on an unstructured mesh.

In a tetrahedron a field is linear, so its gradient is one vector: the sum over the vertices of the value times the
gradient of the vertex's weight. At a vertex it is the mean of its cells' gradients by their volumes. Both are exact for
linear fields. Places between the vertices have the difference of two samples instead.

For means at vertices cells are dealt out in blocks of consecutive ids, which share most of their vertices in the usual
meshes: a block gets each of its vertices once, with all fields, and gives one sum for each. Any other order of ids
gives the same means with more rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volmesh.common import checkpointed, shuffled
from volmesh.functions.geometry import minus
from volmesh.operators.fields import Derived, registry
from volmesh.operators.sampling import containing_cell, locate, sampled
from volmesh.operators.structured import DERIVATIVE_STEP

#: Consecutive cell_ids of a block; cells of a group of blocks, about.
BLOCK, GROUP = 1 << 12, 1 << 16


def _cross(a: tuple, b: tuple) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def weight_gradients(geometry: DataFrame) -> DataFrame:
    """cell_id, volume (six times it), point_id, nx, ny, nz: the gradient of each vertex's barycentric weight in each cell
    (cell_id, v, corners). Cells without volume have none."""
    corner = [tuple(F.element_at("corners", i + 1)[a] for a in "xyz") for i in range(4)]
    edges = [minus(corner[i], corner[0]) for i in (1, 2, 3)]
    normals = [_cross(edges[1], edges[2]), _cross(edges[2], edges[0]), _cross(edges[0], edges[1])]
    whole = reduce(lambda a, b: a + b, (e * n for e, n in zip(edges[0], normals[0], strict=True)))
    flat = [c.alias(f"m{i}{a}") for i, n in enumerate(normals, 1) for a, c in zip("xyz", n, strict=True)]
    cells = geometry.select("cell_id", "v", whole.alias("whole"), *flat).where("whole <> 0")
    unit = lambda i, a: F.col(f"m{i}{a}") / F.col("whole")
    first = {a: -(unit(1, a) + unit(2, a) + unit(3, a)) for a in "xyz"}
    each = F.array(*(F.struct(F.element_at("v", i + 1).alias("point_id"), *((first[a] if i == 0 else unit(i, a)).alias(f"n{a}") for a in "xyz")) for i in range(4)))
    return cells.select("cell_id", F.abs("whole").alias("volume"), F.explode(each).alias("w")).select("cell_id", "volume", "w.*")


def cell_gradients(geometry: DataFrame, fields: DataFrame) -> DataFrame:
    """cell_id, volume, name, gx, gy, gz of fields (point_id, name, value) in every cell that has volume and, at all of its
    vertices, a value."""
    parts = weight_gradients(geometry).join(fields.select("point_id", "name", F.col("value").cast("double").alias("value")), "point_id")
    sums = [F.sum(F.col("value") * F.col(f"n{a}")).alias(f"g{a}") for a in "xyz"]
    return parts.groupBy("cell_id", "name").agg(F.max("volume").alias("volume"), F.count("value").alias("n"), *sums).where("n = 4").drop("n")


def _array(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _sums_in_cells(cells: pa.Table, points: pa.Table, fields: int) -> list[np.ndarray]:
    """point_id and, for each field, the sums of volume times gradient (three) and of volume over the vertex's cells among
    these. Coordinates are the points', or else the cells' own."""
    corners = cells if "x0" in cells.column_names else points
    ids, first = np.unique(_array(points["point_id"]), return_index=True)
    vertices = np.stack([_array(cells[f"v{i}"]) for i in range(4)], axis=1)
    at = np.minimum(np.searchsorted(ids, vertices), len(ids) - 1)
    known = ids[at] == vertices
    at = first[at]
    if corners is cells:
        xyz = np.stack([np.stack([_array(cells[f"{a}{i}"]) for a in "xyz"], axis=1) for i in range(4)], axis=1)
    else:
        xyz = np.stack([_array(points[a]) for a in "xyz"], axis=1)[at]
    e = xyz[:, 1:] - xyz[:, :1]
    normals = np.stack([np.cross(e[:, i], e[:, j]) for i, j in ((1, 2), (2, 0), (0, 1))], axis=1)
    whole = (e[:, 0] * normals[:, 0]).sum(axis=1)
    on = known.all(axis=1) & (whole != 0)
    vertices, at, volume, unit = vertices[on], at[on], np.abs(whole[on]), normals[on] / whole[on, None, None]
    weights = np.concatenate([-unit.sum(axis=1, keepdims=True), unit], axis=1)
    found, place = np.unique(vertices, return_inverse=True)
    place, out = place.reshape(-1), [found]
    add = lambda of_cell: np.bincount(place, np.repeat(of_cell, 4), len(found))
    for f in range(fields):
        column = points[f"f{f}"].combine_chunks()
        value = column.to_numpy(zero_copy_only=False)[at]
        held = column.is_valid().to_numpy(zero_copy_only=False)[at].all(axis=1)
        slope = (value[:, :, None] * weights).sum(axis=1) * volume[:, None]
        out += [add(np.where(held, slope[:, a], 0.0)) for a in range(3)]
        out.append(add(np.where(held, volume, 0.0)))
    return out


def _vertex_slopes(geometry: DataFrame, values: DataFrame, fields: int, points: DataFrame | None) -> DataFrame:
    """point_id, g0x .. : the gradients of so many fields (point_id, f0 ..) at vertices, null where no cell gives one."""
    v = [F.element_at("v", i + 1).cast("long").alias(f"v{i}") for i in range(4)]
    own = [] if points is not None else [F.element_at("corners", i + 1)[a].cast("double").alias(f"{a}{i}") for i in range(4) for a in "xyz"]
    at = values if points is None else values.join(points.select(F.col("point_id").cast("long").alias("point_id"), *(F.col(a).cast("double").alias(a) for a in "xyz")).dropna(), "point_id")
    groups = max(1, geometry.count() // GROUP)
    cells = geometry.select(F.pmod(F.xxhash64(F.floor(F.col("cell_id") / BLOCK)), F.lit(groups)).alias("part"), *v, *own).dropna()
    needed = pa.schema([("part", pa.int64()), ("point_id", pa.int64())])

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            pairs = np.stack([np.tile(part, 4), np.concatenate([batch.column(i + 1).to_numpy() for i in range(4)])], axis=1)
            pairs = pairs[np.lexsort(pairs.T)]
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs[new].T.copy()], schema=needed)

    names = [f"{n}{f}{a}" for f in range(fields) for n, a in (("s", "x"), ("s", "y"), ("s", "z"), ("w", ""))]
    arrow = pa.schema([("point_id", pa.int64()), *((n, pa.float64()) for n in names)])

    def group(cells: pa.Table, points: pa.Table) -> pa.Table:
        if not cells.num_rows or not points.num_rows:
            return arrow.empty_table()
        with np.errstate(all="ignore"):
            return pa.table([pa.array(c) for c in _sums_in_cells(cells, points, fields)], schema=arrow)

    placed = shuffled(cells.select("part", "v0", "v1", "v2", "v3").mapInArrow(vertices, "part long, point_id long")).join(at, "point_id")
    sums = cells.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(group, "point_id long, " + ", ".join(f"{n} double" for n in names))
    total = sums.groupBy("point_id").agg(*(F.sum(n).alias(n) for n in names))
    return total.select("point_id", *(F.when(F.col(f"w{f}") != 0, F.col(f"s{f}{a}") / F.col(f"w{f}")).alias(f"g{f}{a}") for f in range(fields) for a in "xyz"))


def _one_value(name: str) -> Column:
    """The value of a field at a point, if there is one."""
    mine = F.when(F.col("name") == name, F.col("value"))
    return F.when(F.count(mine) == 1, F.max(mine))


def vertex_gradients(geometry: DataFrame, fields: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """point_id, name, gx, gy, gz: the mean of the gradients of a vertex's cells by their volumes; vertices of no such cell
    have none.

    With points (point_id, x, y, z) the geometry's corners aren't read, and cell_id and v will do.
    """
    names = [r.name for r in fields.where("name IS NOT NULL").select("name").distinct().orderBy("name").collect()]
    wanted = fields.select(F.col("point_id").cast("long").alias("point_id"), "name", F.col("value").cast("double").alias("value"))
    if not names:
        return wanted.select("point_id", "name", *(F.col("value").alias(f"g{a}") for a in "xyz")).where(F.lit(False))
    values = wanted.groupBy("point_id").agg(*(_one_value(n).alias(f"f{i}") for i, n in enumerate(names)))
    slopes = _vertex_slopes(geometry, values, len(names), points)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), *(F.col(f"g{i}{a}").alias(f"g{a}") for a in "xyz")) for i, n in enumerate(names)))).alias("g")
    return slopes.select("point_id", each).select("point_id", "g.*").where("gx IS NOT NULL")


def derive(geometry: DataFrame, fields: DataFrame, names: list[str], known: dict[str, Derived] | None = None, points: DataFrame | None = None) -> DataFrame:
    """point_id and the named fields (see ``fields.registry``) as columns, of every vertex that has a value of some input.

    Where an input or a derivative is missing, so is what is made of it. Only fields that are derived are differentiated.
    With points (point_id, x, y, z) the geometry's corners aren't read, and cell_id and v will do.
    """
    known = known or registry()
    inputs = list(dict.fromkeys(i for n in names for i in known[n].inputs))
    derived = list(dict.fromkeys(f for n in names for f, _ in known[n].derivatives))
    wanted = fields.where(F.col("name").isin(inputs)).select(F.col("point_id").cast("long").alias("point_id"), "name", F.col("value").cast("double").alias("value"))
    wide = wanted.groupBy("point_id").agg(*(F.max(F.when(F.col("name") == i, F.col("value"))).alias(i) for i in inputs), *(_one_value(f).alias(f"f{i}") for i, f in enumerate(derived)))
    if derived:
        wide = checkpointed(wide)
        slopes = _vertex_slopes(geometry, wide.select("point_id", *(f"f{i}" for i in range(len(derived)))), len(derived), points)
        wide = wide.join(slopes.select("point_id", *(F.col(f"g{i}{a}").alias(f"d{f}_d{a}") for i, f in enumerate(derived) for a in "xyz")), "point_id", "left")
    return wide.select("point_id", *(known[n].formula.alias(n) for n in names))


def derivative_at(probes: DataFrame, nodes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, fields: DataFrame, axis: str, eps: float = 0.005) -> DataFrame:
    """probes (x, y, z and any columns) with name, d, a row for each field: the forward difference of samples
    DERIVATIVE_STEP apart; where no cell holds the place ahead, the backward one; where neither is there, 0.

    A place is looked up once, however many probes it has.
    """
    of = [f"of_{a}" for a in "xyz"]
    places = probes.select(*(F.col(a).cast("double").alias(f"of_{a}") for a in "xyz")).dropna().distinct()
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("move"), F.lit(s).alias("by")) for i, s in enumerate((0.0, DERIVATIVE_STEP, -DERIVATIVE_STEP))))).alias("m")
    moved = places.select(*of, moves).select(F.struct(*of, "m.move").alias("probe_id"), *((F.col(f"of_{a}") + (F.col("m.by") if a == axis else 0.0)).alias(a) for a in "xyz"))
    values = sampled(containing_cell(locate(moved, nodes).where("leaf_key IS NOT NULL"), leaf_cells, geometry, eps), fields)
    s = [F.max(F.when(F.col("probe_id.move") == i, F.col("sample"))) for i in range(3)]
    found = values.groupBy(*(F.col(f"probe_id.{c}") for c in of), F.col("name").alias("its_name")).agg(*(c.alias(f"s{i}") for i, c in enumerate(s)))
    slope = F.coalesce((F.col("s1") - F.col("s0")) / DERIVATIVE_STEP, (F.col("s0") - F.col("s2")) / DERIVATIVE_STEP, F.lit(0.0))
    every = probes.crossJoin(F.broadcast(fields.select(F.col("name").alias("field")).distinct()))  # the fields' names
    same = reduce(lambda p, q: p & q, (F.col(a).cast("double") == F.col(f"of_{a}") for a in "xyz")) & (F.col("field") == F.col("its_name"))
    return every.join(found, same, "left").select(*probes.columns, F.col("field").alias("name"), F.coalesce(slope, F.lit(0.0)).alias("d"))
