"""k-d trees over cells: five split strategies.

A node-median split depends on the node's box alone, so every task can follow its cells down on its own: those trees take
a pass over the cells for each STRIDE levels, which only sends counts. The other strategies go level by level. Node keys are heap paths: the root is 1, children of k are 2k (left) and 2k + 1. The axis of a split is the
depth modulo 3. A cell that straddles a plane goes to both sides. A level only counts per node (combined before
the shuffle) and joins the decisions back; finished leaves leave the active set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volmesh.common import broadcast_if_few, checkpointed, shuffled
from volmesh.functions.geometry import HIGH, LOW, box_surface, box_volume

NODE_MEDIAN, VERT_MEDIAN, VERT_AVERAGE, SURFACE_AREA, VOLUME = "NODE_MEDIAN", "VERT_MEDIAN", "VERT_AVERAGE", "SURFACE_AREA_HEURISTIC", "VOLUME_HEURISTIC"
STRATEGIES = (NODE_MEDIAN, VERT_MEDIAN, VERT_AVERAGE, SURFACE_AREA, VOLUME)
BOUNDS = (*LOW, *HIGH)
#: Split places that the surface-area heuristic tries, evenly spaced; the cost of a step down; fixed values.
SURFACE_TRIALS, STEP_COST = 5, 1 / 16
#: Nodes of a serialised tree that are ranked together.
LEAF_PART = 1 << 16
#: Up to so many nodes of a level their decisions are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 200_000


#: Levels that a pass over the cells counts below the nodes that are known to be split; nodes of one level, and of all,
#: that tasks may be given (16 bytes each).
STRIDE, MOST_OPEN, MOST_SPLIT = 6, 1 << 20, 1 << 22


def _descended(cells: np.ndarray, key: np.ndarray, boxes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of its cell, key and box of every copy one level below copies of cells (rows of x0 .. z1) in nodes."""
    axis = depth % 3
    s = ((boxes[:, axis] + boxes[:, axis + 3]) / 2).astype(np.float32).astype(np.float64)
    left, right = np.flatnonzero(cells[:, axis] <= s), np.flatnonzero(cells[:, axis + 3] > s)
    below = [boxes[left], boxes[right]]
    below[0][:, axis + 3], below[1][:, axis] = s[left], s[right]
    return np.concatenate([left, right]), np.concatenate([2 * key[left], 2 * key[right] + 1]), np.concatenate(below)


def _held(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, keys)
    return (at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] == keys) if len(sorted_) else np.zeros(len(keys), bool)


def _ancestors(keys: np.ndarray, depth: int) -> list[np.ndarray]:
    """Those of nodes of one depth, by depth, themselves last."""
    return [np.unique(keys >> (depth - d)) for d in range(depth + 1)]


_COUNTS = pa.schema([("node_key", pa.int64()), ("cell_count", pa.int64())])
#: Cells that a task follows down together.
_CELLS = 1 << 14


def _batches(batches: Iterator[pa.RecordBatch], box: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """cell_ids and bounds, and keys and boxes of the root, of some cells at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, _CELLS):
            part = whole.slice(at, _CELLS)
            cells = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(6)], axis=1)
            yield part.column(0).to_numpy(), cells, np.ones(len(cells), np.int64), np.repeat(box, len(cells), axis=0)


def _counted(bounds: DataFrame, box: np.ndarray, opened: np.ndarray, depth: int, levels: int) -> DataFrame:
    """node_key, cell_count of the nodes of so many levels, from ``depth`` on, at and below the opened nodes there."""
    above = bounds.sparkSession.sparkContext.broadcast(_ancestors(opened, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells, key, boxes in _batches(batches, box):
            for d in range(depth + levels):
                if d <= depth:
                    on = np.flatnonzero(_held(key, above.value[d]))
                    cells, key, boxes = cells[on], key[on], boxes[on]
                if d >= depth:
                    nodes, count = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(count)], schema=_COUNTS)
                if d < depth + levels - 1:
                    of, key, boxes = _descended(cells, key, boxes, d)
                    cells = cells[of]

    counts = bounds.select("cell_id", *BOUNDS).mapInArrow(run, "node_key long, cell_count long")
    return counts.groupBy("node_key").agg(F.sum("cell_count").alias("cell_count"))


def _boxed(keys: DataFrame, box: np.ndarray) -> DataFrame:
    """keys (node_key) with depth, x0 .. z1: the path alone tells a node's box."""
    arrow = pa.schema([("node_key", pa.int64()), ("depth", pa.int32()), *((b, pa.float64()) for b in BOUNDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            depth = np.frexp(key.astype(np.float64))[1] - 1
            boxes = np.repeat(box, len(key), axis=0)
            for d in range(int(depth.max()) if len(key) else 0):
                on, axis = np.flatnonzero(depth > d), d % 3
                s = ((boxes[on, axis] + boxes[on, axis + 3]) / 2).astype(np.float32).astype(np.float64)
                right = (key[on] >> (depth[on] - d - 1) & 1).astype(bool)
                boxes[on[right], axis], boxes[on[~right], axis + 3] = s[right], s[~right]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth.astype(np.int32)), *map(pa.array, boxes.T.copy())], schema=arrow)

    return keys.mapInArrow(run, "node_key long, depth int, " + ", ".join(f"{b} double" for b in BOUNDS))


def median_tree(bounds: DataFrame, box: tuple[tuple, tuple], max_cells: int, max_depth: int) -> tuple[DataFrame, DataFrame] | None:
    """``build_tree`` by node medians without moving cells: a node is split if its count is over ``max_cells``, and its
    ancestors then are too. None if more nodes are split than tasks may be given."""
    spark = bounds.sparkSession
    sides = np.array([[float(v) for v in (*box[0], *box[1])]])
    opened, depth, counts = np.array([1], np.int64), 0, []
    while True:
        levels = min(STRIDE, max_depth - depth + 1)
        counts.append(checkpointed(_counted(bounds, sides, opened, depth, levels)))
        if depth + levels > max_depth:
            break
        # Nodes of the lowest counted level that are over the limit are counted again as the first level of the next pass.
        deepest = counts[-1].where((F.col("node_key") >= 1 << (depth + levels - 1)) & (F.col("cell_count") > max_cells)).select("node_key")
        rows = deepest.limit(MOST_OPEN + 1).collect()
        if len(rows) > MOST_OPEN:
            return None
        if not rows:
            break
        opened, depth = np.sort(np.array([r.node_key for r in rows], np.int64)), depth + levels - 1
        if levels == 1:
            break
    counted = reduce(DataFrame.unionByName, counts).groupBy("node_key").agg(F.max("cell_count").alias("cell_count"))
    splits = checkpointed(counted.where((F.col("cell_count") > max_cells) & (F.col("node_key") < 1 << max_depth)).select("node_key"))
    inner = splits.limit(MOST_SPLIT + 1).toArrow()["node_key"].to_numpy()
    if len(inner) > MOST_SPLIT:
        return None
    root = spark.createDataFrame([(1,)], "node_key long")
    keys = root.union(splits.select(F.explode(F.array(F.col("node_key") * 2, F.col("node_key") * 2 + 1))))
    whole = _boxed(keys, sides).join(counted, "node_key", "left").join(splits.withColumn("split", F.lit(True)), "node_key", "left")
    dim, leaf = F.col("depth") % 3, F.col("split").isNull()
    pick = lambda names: F.element_at(F.array(*names), dim + 1)
    middle = ((pick(LOW) + pick(HIGH)) / 2).cast("float")
    nodes = whole.select("node_key", F.expr("node_key div 2").alias("parent_key"), "depth", F.when(~leaf, dim).alias("split_dim"), F.when(~leaf, middle).alias("split_val"), leaf.alias("is_leaf"), F.coalesce("cell_count", F.lit(0)).alias("cell_count"), *BOUNDS)
    inner = np.sort(inner)
    split = spark.sparkContext.broadcast(inner)
    arrow = pa.schema([("leaf_key", pa.int64()), ("cell_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cells, key, boxes in _batches(batches, sides):
            for d in range(max_depth + 1):
                on = _held(key, split.value)
                yield pa.RecordBatch.from_arrays([pa.array(key[~on]), pa.array(ids[~on])], schema=arrow)
                at = np.flatnonzero(on)
                if not len(at):
                    break
                of, key, boxes = _descended(cells[at], key[at], boxes[at], d)
                cells, ids = cells[at][of], ids[at][of]

    leaves = bounds.select(F.col("cell_id").cast("long").alias("cell_id"), *BOUNDS).mapInArrow(run, "leaf_key long, cell_id long")
    return checkpointed(nodes), checkpointed(leaves)


def _child(side: int, axis: int) -> Column:
    """The child's struct<node_key, x0 .. z1> from a node's columns."""
    at = F.col("split_val").cast("double")
    box = {b: F.col(b) for b in BOUNDS}
    box[(HIGH if side == 0 else LOW)[axis]] = at
    return F.struct((F.col("node_key") * 2 + side).alias("node_key"), *(c.alias(b) for b, c in box.items()))


def _trials(axis: int, n: int) -> list[Column]:
    lo, hi = F.col(f"n.{LOW[axis]}"), F.col(f"n.{HIGH[axis]}")
    return [(lo + (hi - lo) * (i + 1) / (n + 1)).cast("float") for i in range(n)]


def _heuristic(nodes: DataFrame, active: DataFrame, axis: int, strategy: str, near) -> DataFrame:
    """nodes with cell_count, split_val and cost: the first trial of least cost."""
    n = SURFACE_TRIALS if strategy == SURFACE_AREA else 1
    trials = _trials(axis, n)
    lo, hi = F.col(f"c.{LOW[axis]}"), F.col(f"c.{HIGH[axis]}")
    both = active.alias("c").join(near(nodes).alias("n"), "node_key")
    sums = [F.sum((lo <= t.cast("double")).cast("long")).alias(f"a{i}") for i, t in enumerate(trials)] + [F.sum((hi > t.cast("double")).cast("long")).alias(f"b{i}") for i, t in enumerate(trials)]
    counted = nodes.alias("n").join(both.groupBy("node_key").agg(F.count("*").alias("cell_count"), *sums), "node_key", "left")
    measure = box_surface if strategy == SURFACE_AREA else box_volume
    low, high = tuple(F.col(f"n.{b}") for b in LOW), tuple(F.col(f"n.{b}") for b in HIGH)

    def cost(i: int, t: Column) -> Column:
        at = t.cast("double")
        left = measure(low, tuple(at if j == axis else h for j, h in enumerate(high)))
        right = measure(tuple(at if j == axis else x for j, x in enumerate(low)), high)
        return F.lit(STEP_COST) + (left * F.coalesce(f"a{i}", F.lit(0)) + right * F.coalesce(f"b{i}", F.lit(0))) / measure(low, high)

    best = F.array_min(F.array(*(F.struct(cost(i, t).alias("cost"), F.lit(i).alias("i"), t.alias("split_val")) for i, t in enumerate(trials))))
    return counted.select("n.*", F.coalesce("cell_count", F.lit(0)).alias("cell_count"), best["split_val"].alias("split_val"), best["cost"].alias("cost"))


#: Bins that a node's values are counted in at a time.
BINS = 1024


def lower_medians(values: DataFrame) -> DataFrame:
    """node_key, v: value number floor(n / 2) in ascending order of each node's values (node_key, v) of two or more.

    Values are counted in BINS bins between the least and the largest of a node, all nodes at once; then those of the bin
    that holds the median, between the least and the largest there, and so on until they are one. Only counts are
    shuffled, and a node's bins are all that is ranked.
    """
    now = checkpointed(values.groupBy("node_key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.expr("count(v) div 2").alias("rank")).where("rank > 0"))
    by_bin = Window.partitionBy("node_key").orderBy("bin")
    done = []
    while True:
        done.append(now.where("lo = hi").select("node_key", F.col("lo").alias("v")))
        open_ = now.where("lo < hi")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # Halved first, so that differences of large values stay finite.
        at = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
        held = values.join(broadcast_if_few(open_, MOST_BROADCAST), "node_key").where("v BETWEEN lo AND hi").withColumn("bin", F.least(F.lit(BINS - 1), at))
        counts = held.groupBy("node_key", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("rank").alias("rank"))
        upto = counts.withColumn("upto", F.sum("n").over(by_bin)).where("upto >= rank")
        first = upto.groupBy("node_key").agg(F.min_by(F.struct("lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "bin").alias("m"))
        now = checkpointed(first.select("node_key", "m.*"))


def _vertex_pivot(nodes: DataFrame, vertices: DataFrame, axis: int, strategy: str) -> DataFrame:
    """nodes with split_val from their vertices; null where a side would have none."""
    a = "xyz"[axis]
    if strategy == VERT_AVERAGE:
        pivots = vertices.groupBy("node_key").agg(((F.min(a) + F.max(a)) / 2).cast("float").alias("split_val"))
    else:
        pivots = lower_medians(vertices.select("node_key", F.col(a).alias("v"))).select("node_key", F.col("v").cast("float").alias("split_val"))
    sides = vertices.join(pivots, "node_key").groupBy("node_key").agg(F.max(F.col(a) > F.col("split_val").cast("double")).alias("above"), F.max(F.col(a) <= F.col("split_val").cast("double")).alias("below"))
    return nodes.join(pivots.join(sides.where("above AND below"), "node_key").select("node_key", "split_val"), "node_key", "left")


def build_tree(bounds: DataFrame, box: tuple[tuple, tuple], strategy: str = NODE_MEDIAN, max_cells: int = 1024, max_depth: int = 40, points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: node_key, parent_key, depth, split_dim, split_val, is_leaf, cell_count, x0 .. z1;
    leaf_cells: leaf_key, cell_id) over cell bounds (cell_id, x0 .. z1) in a box (low, high).

    points (point_id, x, y, z): needed by the strategies that split at vertices. Nodes without cells are kept.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}; there are {', '.join(STRATEGIES)}")
    if points is None and strategy in (VERT_MEDIAN, VERT_AVERAGE):
        raise ValueError(f"{strategy} needs points")
    if strategy == NODE_MEDIAN:
        found = median_tree(bounds, box, max_cells, max_depth)
        if found:
            return found[0], shuffled(found[1])
    nodes, leaves = level_tree(bounds, box, strategy, max_cells, max_depth, points)
    return nodes, shuffled(leaves)


def level_tree(bounds: DataFrame, box: tuple[tuple, tuple], strategy: str, max_cells: int, max_depth: int, points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``build_tree`` a level at a time, for trees of any size. Cells and vertices are written once at the root, as each level
    reads them several times and what they are made of may cost more."""
    spark = bounds.sparkSession
    root = [(1, *(float(v) for v in (*box[0], *box[1])))]
    nodes = spark.createDataFrame(root, "node_key long, " + ", ".join(f"{b} double" for b in BOUNDS))
    active = checkpointed(bounds.select(F.lit(1).cast("long").alias("node_key"), "cell_id", *BOUNDS))
    vertices = None if points is None else checkpointed(points.select(F.lit(1).cast("long").alias("node_key"), *(F.col(a).cast("double").alias(a) for a in "xyz")))
    done, leaves, depth = [], [], 0
    while True:
        axis = depth % 3
        n = nodes.count() if depth else 1
        near = F.broadcast if n <= MOST_BROADCAST else (lambda df: df)
        if strategy in (SURFACE_AREA, VOLUME):
            level = _heuristic(nodes, active, axis, strategy, near)
        else:
            counts = active.groupBy("node_key").agg(F.count("*").alias("cell_count"))
            level = nodes.join(counts, "node_key", "left").withColumn("cell_count", F.coalesce("cell_count", F.lit(0)))
            if strategy == NODE_MEDIAN:
                level = level.withColumn("split_val", ((F.col(LOW[axis]) + F.col(HIGH[axis])) / 2).cast("float"))
            else:
                level = _vertex_pivot(level, vertices, axis, strategy)
        cells, deep = F.col("cell_count"), F.lit(depth + 1 > max_depth)
        if strategy == SURFACE_AREA:
            leaf = deep | (cells < 4) | ((F.col("cost") > cells) & (cells < max_cells))
        elif strategy == VOLUME:
            leaf = deep | (cells < max_cells) | (F.col("cost") > cells)
        else:
            leaf = deep | (cells <= max_cells) | F.col("split_val").isNull()
        level = checkpointed(level.withColumn("is_leaf", leaf).withColumn("split_val", F.when(~leaf, F.col("split_val"))))
        done.append(level.select("node_key", F.expr("node_key div 2").alias("parent_key"), F.lit(depth).alias("depth"), F.when(~F.col("is_leaf"), F.lit(axis)).alias("split_dim"), "split_val", "is_leaf", "cell_count", *BOUNDS))
        split = level.where("NOT is_leaf").select("node_key", "split_val", *BOUNDS)
        leaves.append(active.join(near(level.where("is_leaf").select("node_key")), "node_key", "left_semi").select(F.col("node_key").alias("leaf_key"), "cell_id"))
        if not split.limit(1).count():
            break
        nodes = checkpointed(split.select(F.explode(F.array(_child(0, axis), _child(1, axis))).alias("c")).select("c.*"))
        at = near(split.select("node_key", F.col("split_val").cast("double").alias("s")))
        go = F.array_compact(F.array(F.when(F.col(LOW[axis]) <= F.col("s"), F.col("node_key") * 2), F.when(F.col(HIGH[axis]) > F.col("s"), F.col("node_key") * 2 + 1)))
        active = active.join(at, "node_key").select(F.explode(go).alias("node_key"), "cell_id", *BOUNDS)
        active = checkpointed(active)
        if vertices is not None:
            side = F.col("node_key") * 2 + (F.col("xyz"[axis]) > F.col("s")).cast("long")
            vertices = checkpointed(vertices.join(at, "node_key").select(side.alias("node_key"), "x", "y", "z"))
        depth += 1
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return checkpointed(union(done)), checkpointed(union(leaves))


def path_text(key: Column) -> Column:
    """The path from the root in an order that puts right subtrees first: R as 0, L as 1."""
    return F.translate(F.substring(F.bin(key), 2, 64), "01", "10")


def serialised(nodes: DataFrame) -> DataFrame:
    """node_key, this_ptr, split_val, cell_count, parent_ptr, left_ptr, right_ptr: nodes in pre-order, the right
    subtree first. A leaf has right_ptr 0 and its left_ptr points at its cells in the leaves' order.

    Places are ranks within the subtrees of depth 6 plus what stands before them, so no task ranks all nodes.
    """
    keyed = nodes.withColumn("path", path_text(F.col("node_key"))).withColumn("part", F.substring(path_text(F.col("node_key")), 1, 6))
    in_part = Window.partitionBy("part").orderBy("path")
    leaf_cells = F.when(F.col("is_leaf"), F.col("cell_count")).otherwise(0)
    local = keyed.withColumn("rank", F.row_number().over(in_part)).withColumn("cells_before", F.sum(leaf_cells).over(in_part) - leaf_cells)
    sums = keyed.groupBy("part").agg(F.count("*").alias("n"), F.sum(leaf_cells).alias("cells"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 127 parts
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("cells").over(before), F.lit(0)).alias("c0"))
    placed = checkpointed(local.join(F.broadcast(starts), "part").select("node_key", "split_val", "cell_count", "is_leaf", (F.col("n0") + F.col("rank") - 1).alias("this_ptr"), (F.col("c0") + F.col("cells_before")).alias("cell_ptr")))
    ptr = lambda name, key: placed.select(key.alias("k"), F.col("this_ptr").alias(name))
    k = F.col("node_key")
    parents = ptr("parent_ptr", k).withColumnRenamed("k", "parent_key")
    lefts = placed.where("node_key % 2 = 0").select(F.expr("node_key div 2").alias("node_key"), F.col("this_ptr").alias("left_at"))
    rights = placed.where("node_key % 2 = 1 AND node_key > 1").select(F.expr("node_key div 2").alias("node_key"), F.col("this_ptr").alias("right_at"))
    whole = placed.withColumn("parent_key", F.expr("node_key div 2")).join(parents, "parent_key", "left").join(lefts, "node_key", "left").join(rights, "node_key", "left")
    return whole.select("node_key", "this_ptr", "split_val", "cell_count", F.coalesce("parent_ptr", F.lit(0)).alias("parent_ptr"), F.when(F.col("is_leaf"), F.col("cell_ptr")).otherwise(F.col("left_at")).alias("left_ptr"), F.coalesce("right_at", F.lit(0)).alias("right_ptr"))


def statistics(nodes: DataFrame) -> DataFrame:
    leaf = F.col("is_leaf")
    cells = F.when(leaf, F.col("cell_count"))
    return nodes.agg(
        F.count("*").alias("nodes"), F.count_if(leaf).alias("leaves"), F.avg(cells).alias("avg_cells"), F.max(cells).alias("max_cells"), F.max("depth").alias("max_depth"),
        F.sum(cells).alias("leaf_cells"), F.count_if(leaf & (F.col("cell_count") < 10)).alias("small_leaves"), (F.count("*") * 20).alias("node_bytes"), (F.sum(cells) * 4).alias("cell_bytes"),
    )


def sweep(nodes: DataFrame, targets: list[int]) -> DataFrame:
    """target, leaves, leaf_cells, max_cells: what trees of larger leaves look like, from one tree of small ones.

    Splits at node middles don't depend on the target, so its leaves are the highest nodes with at most so many
    cells, and the leaves of the tree at hand where there are none.
    """
    above = nodes.select(F.col("node_key").alias("parent_key"), F.col("cell_count").alias("parent_cells"))
    both = nodes.join(above, "parent_key", "left").select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    is_leaf = (F.coalesce("parent_cells", F.lit(1 << 62)) > F.col("target")) & ((F.col("cell_count") <= F.col("target")) | F.col("is_leaf"))
    return both.where(is_leaf).groupBy("target").agg(F.count("*").alias("leaves"), F.sum("cell_count").alias("leaf_cells"), F.max("cell_count").alias("max_cells"))


def leaf_index(buffer: DataFrame) -> DataFrame:
    """node_key, this_ptr, leaf_index: leaves of a serialised tree, numbered in the order of their nodes.

    The number of a leaf is that of the leaves before it in its part of nodes, plus those of the parts before.
    """
    part = F.floor(F.col("this_ptr") / LEAF_PART)
    leaves = buffer.where("right_ptr = 0").select("node_key", "this_ptr", part.alias("part"))
    counts = leaves.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("this_ptr"))
    return leaves.join(starts, "part").select("node_key", "this_ptr", (F.col("start") + rank - 1).alias("leaf_index"))


def rebuilt(buffer: DataFrame, box: tuple[tuple, tuple]) -> DataFrame:
    """node_key, this_ptr, depth, is_leaf, x0 .. z1 from pointers and split values alone (this_ptr, split_val, left_ptr,
    right_ptr): a level a round, each joining the children to their parents. Only inner nodes have a right_ptr."""
    nodes = buffer.select("this_ptr", "split_val", "left_ptr", "right_ptr")
    level = nodes.where("this_ptr = 0").withColumns({"node_key": F.lit(1).cast("long"), **{b: F.lit(float(v)) for b, v in zip(BOUNDS, (*box[0], *box[1]), strict=True)}})
    done, depth = [], 0
    while True:
        level = checkpointed(level)
        done.append(level.select("node_key", "this_ptr", F.lit(depth).alias("depth"), (F.col("right_ptr") == 0).alias("is_leaf"), *BOUNDS))
        inner = level.where("right_ptr <> 0")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, done)
        children = F.explode(F.array(*(F.struct(F.col(p).alias("ptr"), _child(side, depth % 3).alias("c")) for side, p in enumerate(("left_ptr", "right_ptr")))))
        below = inner.select(children.alias("n")).select(F.col("n.ptr").alias("this_ptr"), "n.c.*")
        level = nodes.join(below, "this_ptr")
        depth += 1


def treelets(nodes: DataFrame, leaf_cells: DataFrame, bounds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(leaf_key, node_key, depth, split_val, cell_count, x0 .. z1 of 2 ** (depth + 1) - 2 nodes below each leaf;
    leaf_key, node_key, cell_id of the lowest ones).

    Every leaf's cells are split at their boxes' middles to that depth, however few they are. Axes go on from the
    leaf's depth, and node keys go on from the leaf's key. The lowest nodes have no split_val.
    """
    level = nodes.where("is_leaf").select(F.col("node_key").alias("leaf_key"), "node_key", "depth", *BOUNDS)
    cells = leaf_cells.join(bounds, "cell_id").select("leaf_key", F.col("leaf_key").alias("node_key"), "cell_id", *BOUNDS)
    pick = lambda names: F.element_at(F.array(*(F.col(n) for n in names)), (F.col("depth") % 3 + 1).cast("int"))
    done = []
    for step in range(depth + 1):
        level = level.withColumn("split_val", ((pick(LOW) + pick(HIGH)) / 2).cast("float") if step < depth else F.lit(None).cast("float"))
        if step:
            counts = cells.groupBy("node_key").agg(F.count("*").alias("cell_count"))
            done.append(level.join(counts, "node_key", "left").select("leaf_key", "node_key", "depth", "split_val", F.coalesce("cell_count", F.lit(0)).alias("cell_count"), *BOUNDS))
        if step == depth:
            break
        at = level.select("node_key", F.col("split_val").cast("double").alias("s"), "depth")
        sides = F.array_compact(F.array(F.when(pick(LOW) <= F.col("s"), F.col("node_key") * 2), F.when(pick(HIGH) > F.col("s"), F.col("node_key") * 2 + 1)))
        cells = checkpointed(cells.join(at, "node_key").select("leaf_key", F.explode(sides).alias("node_key"), "cell_id", *BOUNDS))
        child = lambda side: F.struct((F.col("node_key") * 2 + side).alias("node_key"), *(F.when(F.col("depth") % 3 == i, F.col("split_val").cast("double")).otherwise(F.col(b)).alias(b) if (b in LOW) == bool(side) else F.col(b).alias(b) for names in (LOW, HIGH) for i, b in enumerate(names)))
        level = level.select("leaf_key", (F.col("depth") + 1).alias("d"), F.explode(F.array(child(0), child(1))).alias("c")).select("leaf_key", F.col("d").alias("depth"), "c.*")
    return reduce(DataFrame.unionByName, done), cells.select("leaf_key", "node_key", "cell_id")
