"""Rays through an unstructured mesh: the leaves that each ray passes in order, and values in the cells there.

A ray's places are a step's length apart from where it enters the tree's box. Rays go down the tree, not their places: a
node's split cuts the range of steps in two, by the very numbers that the places have, so every step is in the leaf that
a descent of its place would find, and a leaf comes once for each ray, in the order of the ray's steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volmesh.common import broadcast_if_few, checkpointed, shuffled
from volmesh.operators.probe import LEAST_LIGHT, absorption, box_interval, gathered
from volmesh.operators.sampling import cell_levels, containing_cell, near_cells, sampled
from volmesh.operators.tree import BOUNDS

RAY = tuple(f"{n}{a}" for n in "od" for a in "xyz")
#: Leaves of each ray, and steps in them, that are sampled in the first round; four times as many in each one after.
FIRST_LEAVES, FIRST_STEPS = 4, 512
#: Up to so many cells, vertices or rays are broadcast by their keys.
MOST_BROADCAST = 1 << 20


def _place(step: Column, axis: str, length: float) -> Column:
    return F.col(f"o{axis}") + (F.col("begin") + step * length) * F.col(f"d{axis}")


def _near_steps(axis: str, length: float) -> Column:
    """The last step on the near side of the split ``s``; first - 1 if there is none."""
    o, d, first, last = (F.col(c) for c in (f"o{axis}", f"d{axis}", "first", "last"))
    backwards = d < 0
    guess = F.floor((F.try_divide(F.col("s") - o, d) - F.col("begin")) / length)
    guess = F.least(last.cast("double"), F.greatest(first.cast("double") - 1, guess)).cast("int")
    # The guess may be off by rounding; the places themselves decide.
    near = lambda k: (_place(k, axis, length) <= F.col("s")) != backwards
    found = F.transform(F.array(guess), lambda g: F.array_max(F.concat(F.array(g - 3), F.filter(F.sequence(g - 2, g + 2), near))))[0]
    all_or_none = F.when(o <= F.col("s"), last).otherwise(first - 1)
    return F.when(d == 0, all_or_none).otherwise(F.greatest(first - 1, F.least(last, found)))


def leaf_steps(rays: DataFrame, nodes: DataFrame, length: float) -> DataFrame:
    """ray_id, ox .. dz, begin, leaf_key, first, last: the steps of each ray (ray_id, ox .. dz) in each leaf it passes.

    Rays that miss the box of the root, or lack a number, give none. A level of the tree is a join with its splits, which
    are broadcast while they are at most 2 ** 17.
    """
    root = nodes.where("node_key = 1").select(*BOUNDS).first()
    box = (root[:3], root[3:]) if root else ((0.0,) * 3, (-1.0,) * 3)
    near, far = box_interval(*box)
    hit = rays.select("ray_id", *(F.col(c).cast("double").alias(c) for c in RAY)).dropna().withColumns({"begin": F.greatest(near, F.lit(0.0)), "far": far}).where("begin <= far AND far < double('Infinity')")
    at = hit.select("ray_id", *RAY, "begin", F.lit(1).cast("long").alias("leaf_key"), F.lit(0).alias("first"), F.floor((F.col("far") - F.col("begin")) / length).cast("int").alias("last"))
    splits = nodes.where("NOT is_leaf").select(F.col("node_key").alias("leaf_key"), F.col("split_val").cast("double").alias("s"), "depth")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest):
        axis = "xyz"[depth % 3]
        level = splits.where(F.col("depth") == depth).drop("depth")
        joined = at.join(F.broadcast(level) if depth < 18 else level, "leaf_key", "left")
        back = (F.col(f"d{axis}") < 0).cast("long")
        part = lambda side, a, b: F.when(a <= b, F.struct((F.col("leaf_key") * 2 + side).alias("leaf_key"), a.cast("int").alias("first"), b.cast("int").alias("last")))
        both = F.flatten(F.transform(F.array(_near_steps(axis, length)), lambda m: F.array_compact(F.array(part(back, F.col("first"), m), part(1 - back, m + 1, F.col("last"))))))  # noqa: B023
        parts = F.when(F.col("s").isNull(), F.array(F.struct("leaf_key", "first", "last"))).otherwise(both)
        at = joined.select("ray_id", *RAY, "begin", F.explode(parts).alias("p")).select("ray_id", *RAY, "begin", "p.*")
    return at


def _places(steps: DataFrame, nodes: DataFrame, length: float) -> DataFrame:
    """probe_id (struct: ray_id, step), leaf_key, x, y, z of ``steps`` (leaf_steps with an array, steps) in the root's box."""
    # Few rows have many steps: they are dealt to all tasks first.
    tasks = 4 * steps.sparkSession.sparkContext.defaultParallelism
    each = steps.repartition(tasks).select("ray_id", *RAY, "begin", "leaf_key", F.explode("steps").alias("step"))
    places = each.select(F.struct("ray_id", "step").alias("probe_id"), "leaf_key", *(_place(F.col("step"), a, length).alias(a) for a in "xyz"))
    root = nodes.where("node_key = 1").select(*(F.col(b).alias(f"r{b}") for b in BOUNDS))
    inside = " AND ".join(f"{a} BETWEEN r{a}0 AND r{a}1" for a in "xyz")
    return places.join(F.broadcast(root)).where(inside).select("probe_id", "leaf_key", "x", "y", "z")  # one row


def _samples(steps: DataFrame, nodes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, fields: DataFrame, length: float, eps: float, levels: DataFrame | None = None) -> DataFrame:
    """ray_id, step, name, value in the cells that hold the places of ``steps`` (leaf_steps with an array, steps).

    levels (of cell_levels): the places are few, so cells and values are looked for by them, and no others are moved.
    """
    places = _places(steps, nodes, length)
    near = None if levels is None else near_cells(places, geometry, levels, eps)
    if near is None:
        # Only cells of leaves that some ray passes are brought to their leaves.
        leaves = broadcast_if_few(steps.select("leaf_key").distinct(), MOST_BROADCAST)
        held = containing_cell(places, shuffled(leaf_cells.join(leaves, "leaf_key", "left_semi")), geometry, eps)
    else:
        cells = broadcast_if_few(near.select("cell_id"), MOST_BROADCAST)
        held = checkpointed(containing_cell(places, shuffled(leaf_cells.join(cells, "cell_id", "left_semi")), near, eps))
        fields = fields.join(broadcast_if_few(held.select(F.explode("v").alias("point_id")).distinct(), MOST_BROADCAST), "point_id", "left_semi")
    return sampled(held, fields).select("probe_id.ray_id", "probe_id.step", "name", F.col("sample").alias("value"))


def _in_order(steps: DataFrame) -> DataFrame:
    """steps (leaf_steps) with place: a leaf's number along the ray."""
    return steps.withColumn("place", F.row_number().over(Window.partitionBy("ray_id").orderBy("first")) - 1)


def _rounds() -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """How many leaves and steps of each ray are sampled before and after each round."""
    before, now = (0, 0), (FIRST_LEAVES, FIRST_STEPS)
    while True:
        yield before, now
        before, now = now, (4 * now[0], 4 * now[1])


def _part(left: DataFrame, before: tuple[int, int], now: tuple[int, int], again: int = 0) -> DataFrame:
    """The leaves (of _in_order) that a round takes, with start and stop, the first and the last step that it takes there.
    again: 1 if the last step of the round before comes along."""
    first, last, place = (F.col(c) for c in ("first", "last", "place"))
    after = F.greatest(first, F.lit(before[1] - again))
    start = F.when(place >= before[0], first)
    start = (start.when(place == before[0] - 1, F.least(last, after)) if again else start).otherwise(after)
    return left.where(place < now[0]).withColumns({"start": start, "stop": F.least(last, F.lit(now[1] - 1))}).where("start <= stop")


def _going_on(left: DataFrame, now: tuple[int, int], ended: DataFrame) -> DataFrame:
    """What rounds have left of the rays that have further steps and are not among the ended (ray_id), checkpointed."""
    further = left.where((F.col("place") >= now[0]) | (F.col("last") >= now[1])).select("ray_id").distinct()
    rest = left.where((F.col("place") >= now[0] - 1) | (F.col("last") >= now[1] - 1))
    return checkpointed(rest.join(further, "ray_id", "left_semi").join(ended.select("ray_id"), "ray_id", "left_anti"))


def _once(rays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rays: those that lack no number, each place and direction once, with a ray_id of their own; rows: ray_id, of)."""
    whole = rays.select("ray_id", *(F.col(c).cast("double").alias(c) for c in RAY)).dropna(subset=list(RAY))
    rows = checkpointed(whole.distinct())
    each = checkpointed(rows.select(*RAY).distinct().withColumn("of", F.monotonically_increasing_id()))
    return each.withColumnRenamed("of", "ray_id"), checkpointed(rows.join(each, list(RAY)).select("ray_id", "of"))


def _for_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """What was found for rays (ray_id: of) for every row of them. What was found stays where it is while rays are few."""
    return shuffled(found.withColumnRenamed("ray_id", "of")).join(broadcast_if_few(rows, MOST_BROADCAST), "of").select("ray_id", *(c for c in found.columns if c != "ray_id"))


def line_samples(rays: DataFrame, nodes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, fields: DataFrame, length: float, eps: float = 0.005) -> DataFrame:
    """ray_id, step, name, value: the fields along every ray; places that no cell holds have none. Rays that are there more
    than once are sampled once."""
    each, rows = _once(rays)
    return _for_rows(_line_samples(each, nodes, leaf_cells, geometry, fields, length, eps), rows)


def _line_samples(rays: DataFrame, nodes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, fields: DataFrame, length: float, eps: float = 0.005) -> DataFrame:
    steps = leaf_steps(rays, nodes, length).withColumn("steps", F.sequence("first", "last"))
    return _samples(steps, nodes, leaf_cells, geometry, fields, length, eps)


def light(rays: DataFrame, nodes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, fields: DataFrame, length: float, opacity: float = 32.0, eps: float = 0.005) -> DataFrame:
    """ray_id, light, transmittance of one field's values along every ray (see ``probe.gathered``); holes give nothing.

    Steps are taken along the ray in rounds. A ray ends where so little light comes through that the rest of its steps
    can't be seen, even if each of them had the least value that the field and weights of -eps allow.
    """
    rays, rows = _once(rays)
    fields, levels = checkpointed(fields), checkpointed(cell_levels(geometry, eps))
    lo, hi = fields.agg(F.min("value").cast("double"), F.max("value").cast("double")).first()
    known = lo is not None and math.isfinite(lo) and math.isfinite(hi)
    least = (1 + 3 * eps) * min(lo, 0.0) - 3 * eps * max(hi, 0.0) if known else 0.0
    left = checkpointed(_in_order(leaf_steps(rays, nodes, length)))
    furthest = checkpointed(left.groupBy("ray_id").agg(F.max("last").alias("end")))
    found = []
    for before, now in _rounds():
        if left.isEmpty():
            break
        steps = _part(left, before, now).withColumn("steps", F.sequence("start", "stop"))
        found.append(checkpointed(_samples(steps, nodes, leaf_cells, geometry, fields, length, eps, levels)))
        depths = reduce(DataFrame.unionByName, found).groupBy("ray_id").agg((F.sum("value") * absorption(opacity) * length).alias("depth"))
        to = left.groupBy("ray_id").agg(F.max(F.when(F.col("place") < now[0], F.least("last", F.lit(now[1] - 1)))).alias("to"))
        steps_left = (F.col("end") - F.col("to")).cast("double")
        hidden = F.lit(known) & (F.col("depth") + steps_left * F.lit(least * absorption(opacity) * length) > -math.log2(LEAST_LIGHT) + 1e-6)
        left = _going_on(left, now, furthest.join(to, "ray_id").join(depths, "ray_id").where(hidden))
    every = reduce(DataFrame.unionByName, found) if found else rays.sparkSession.createDataFrame([], f"ray_id {rays.schema['ray_id'].dataType.simpleString()}, step int, name string, value double")
    return _for_rows(gathered(every, length, opacity), rows)


def first_crossing(rays: DataFrame, nodes: DataFrame, leaf_cells: DataFrame, geometry: DataFrame, fields: DataFrame, ranges: DataFrame, iso: float, length: float, eps: float = 0.005) -> tuple[DataFrame, int]:
    """(ray_id, step, direction (1: upwards, -1: downwards), t: the first two steps next to each other, both in cells, whose
    values lie on two sides of the iso-value, and how far from the ray's entry the value is reached by secant; how many
    leaves of rays were sampled).

    fields: point_id, name, value of one field; ranges: node_key, lo, hi of its leaves. A leaf whose range (and what
    weights of -eps add to it) doesn't hold the iso-value can only be crossed at its border, so of its steps the first and
    the last are sampled. Steps are taken along the ray: those in FIRST_LEAVES leaves, FIRST_STEPS at most, and four times as many in each
    round after; rays that have crossed are left out. Rays that are there more than once are sampled, and their leaves
    counted, once.
    """
    rays, rows = _once(rays)
    fields, levels = checkpointed(fields), checkpointed(cell_levels(geometry, eps))
    more = 3 * eps * (F.col("hi") - F.col("lo"))
    own = ranges.select(F.col("node_key").alias("leaf_key"), ((F.col("lo") - more <= iso) & (F.col("hi") + more >= iso)).alias("holds"))
    left = checkpointed(_in_order(leaf_steps(rays, nodes, length).join(own, "leaf_key", "left")))
    done, sampled_leaves = None, 0
    along = Window.partitionBy("ray_id").orderBy("step")
    for before, now in _rounds():
        if left.isEmpty():
            break
        ends = F.filter(F.array_distinct(F.array("first", "last")), lambda s: (s >= F.col("start")) & (s <= F.col("stop")))
        # The last step before these goes along: the ray may cross next to it.
        steps = _part(left, before, now, again=1).withColumn("steps", F.when(F.coalesce("holds", F.lit(True)), F.sequence("start", "stop")).otherwise(ends))
        values = _samples(steps, nodes, leaf_cells, geometry, fields, length, eps, levels)
        pairs = values.withColumns({"before": F.lag("value").over(along), "step_before": F.lag("step").over(along)}).where("step_before = step - 1")
        flips = pairs.where((F.col("before") > iso) != (F.col("value") > iso))
        first = flips.groupBy("ray_id").agg(F.min(F.struct("step", "before", "value")).alias("m")).select("ray_id", "m.*")
        found = checkpointed(first)
        sampled_leaves += _part(left, before, now).where("start = first").count()
        done = found if done is None else done.unionByName(found)
        left = _going_on(left, now, found)
    if done is None:
        done = rays.sparkSession.createDataFrame([], f"ray_id {rays.schema['ray_id'].dataType.simpleString()}, step int, before double, value double")
    f1, f2 = F.col("before") - iso, F.col("value") - iso
    x1, x2 = (F.col("step") - 1) * length, F.col("step") * length
    crossed = done.select("ray_id", "step", F.when(F.col("value") > iso, 1).otherwise(-1).alias("direction"), ((x2 * f1 - x1 * f2) / (f1 - f2)).alias("t"))
    return _for_rows(crossed, rows), sampled_leaves
