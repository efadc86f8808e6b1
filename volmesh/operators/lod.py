"""Level of detail: which nodes and blocks a view needs within a budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volmesh.common import broadcast_if_few, checkpointed
from volmesh.functions.geometry import hashed_unit


def iso_score(lo: Column, hi: Column, iso: Column, limit_lo: Column, limit_hi: Column) -> Column:
    """1 where the range holds the iso-value, else a tenth of how near it comes within the limits."""
    below = F.try_divide(0.1 * (hi - limit_lo), iso - limit_lo)
    above = F.try_divide(0.1 * (limit_hi - lo), limit_hi - iso)
    return F.when((lo <= iso) & (iso <= hi), 1.0).when(hi < iso, F.coalesce(below, F.lit(0.0))).otherwise(F.coalesce(above, F.lit(0.0)))


def active_nodes(ranges: DataFrame, iso: float) -> DataFrame:
    return ranges.where((F.col("lo") <= iso) & (F.col("hi") >= iso))


def clipped(matrix: Column) -> Column:
    """The corners of the box x0 .. z1 under a 4 x 4 matrix (16 numbers, by columns): array of struct<x, y, z, w>."""
    corners = F.array(*(F.struct(*(F.col(f"{a}{c >> i & 1}").alias(a) for i, a in enumerate("xyz"))) for c in range(8)))
    row = lambda p, r: F.element_at(matrix, r + 1) * p["x"] + F.element_at(matrix, r + 5) * p["y"] + F.element_at(matrix, r + 9) * p["z"] + F.element_at(matrix, r + 13)
    return F.transform(corners, lambda p: F.struct(*(row(p, r).alias(n) for r, n in enumerate("xyzw"))))


def in_sight(clip: Column) -> Column:
    inside = lambda c: (F.abs(F.try_divide(c["x"], c["w"])) <= 1) & (F.abs(F.try_divide(c["y"], c["w"])) <= 1) & (F.try_divide(c["z"], c["w"]) >= 0)
    return F.exists(clip, lambda c: F.coalesce(inside(c), F.lit(False)))


def visible(matrix: Column) -> Column:
    """Whether some corner of the box x0 .. z1 is inside the view of a matrix."""
    return in_sight(clipped(matrix))


def box_score(eye: tuple[Column, ...], seen: Column) -> Column:
    """(largest extent / distance from the eye to the middle) squared; 0 unless seen, infinite at the middle."""
    extent = F.greatest(*(F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"))
    away = sum((((F.col(f"{a}0") + F.col(f"{a}1")) / 2 - e) * ((F.col(f"{a}0") + F.col(f"{a}1")) / 2 - e) for a, e in zip("xyz", eye, strict=True)), F.lit(0.0))
    return F.when(seen, F.coalesce(F.try_divide(extent * extent, away), F.lit(float("inf")))).otherwise(0.0)


#: A node's box.
BOX = [f"{a}{i}" for a in "xyz" for i in "01"]


def scores_of(front: DataFrame, views: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, seed: int = 1) -> DataFrame:
    """view_id, node_key, is_leaf, score of pairs of views and nodes: front (view_id, node_key, is_leaf, x0 .. z1),
    views (view_id, ex, ey, ez, mat, iso_name, iso).

    A score is that of the node's box in the view, times that of its range of the view's field. The fields x, y and z
    are the axes themselves: a node's range is its box's extent. Without a field, or if the nodes have no ranges of it,
    the box alone counts; without a field and a matrix the score is a number that depends on view and node alone.
    """
    return _scored(_of_views(front, views, nodes, ranges, limits), seed).select("view_id", "node_key", "is_leaf", "score")


def _of_views(front: DataFrame, views: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame) -> DataFrame:
    """front with its views' columns, lo, hi, limit_lo, limit_hi of the view's field. Few views are broadcast."""
    asked = views.select("view_id", "ex", "ey", "ez", "mat", "iso_name", "iso")
    return _with_ranges(front.select("view_id", "node_key", "is_leaf", *BOX).join(broadcast_if_few(asked, 10_000), "view_id"), nodes, ranges, limits)


def _with_ranges(base: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame) -> DataFrame:
    fields = ranges.select("node_key", F.col("name").alias("iso_name"), F.col("lo").alias("field_lo"), F.col("hi").alias("field_hi"))
    bounds = limits.select(F.col("name").alias("iso_name"), F.col("lo").alias("least"), F.col("hi").alias("most"))
    root = nodes.where("node_key = 1").select(*(F.col(c).alias(f"root_{c}") for c in BOX))  # one row
    both = base.join(fields, ["node_key", "iso_name"], "left").join(broadcast_if_few(bounds, 10_000), "iso_name", "left").join(F.broadcast(root), how="left")

    def of(axis: str, other: str) -> Column:
        found = F.col(other)
        for a in "xyz":
            found = F.when(F.col("iso_name") == a, F.col(axis.format(a))).otherwise(found)
        return found

    names = {"lo": of("{}0", "field_lo"), "hi": of("{}1", "field_hi"), "limit_lo": of("root_{}0", "least"), "limit_hi": of("root_{}1", "most")}
    return both.withColumns(names).drop("field_lo", "field_hi", "least", "most", *(f"root_{c}" for c in BOX))


def _field_score() -> Column:
    return F.when(F.col("lo").isNull(), 1.0).otherwise(iso_score(F.col("lo"), F.col("hi"), F.col("iso"), F.col("limit_lo"), F.col("limit_hi")))


def _scored(base: DataFrame, seed: int) -> DataFrame:
    base = base.withColumns({"clip": clipped(F.col("mat")), "of_field": _field_score()})
    of_box = box_score((F.col("ex"), F.col("ey"), F.col("ez")), in_sight(F.col("clip")))
    hashed = F.col("iso_name").isNull() & F.col("mat").isNull()
    return base.withColumn("score", F.when(hashed, hashed_unit(F.lit(seed), F.col("view_id"), F.col("node_key"))).otherwise(of_box * F.col("of_field")))


def scores(views: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, seed: int = 1) -> DataFrame:
    """view_id, node_key, is_leaf, score (see ``scores_of``) of all views and all nodes: their product. What only wants
    the best of them takes ``best_leaves``. Few views are broadcast; more are joined by a shuffle."""
    few = broadcast_if_few(views.select("view_id", "ex", "ey", "ez", "mat", "iso_name", "iso"), 10_000)
    every = nodes.select("node_key", "is_leaf", *BOX).crossJoin(few)
    return _scored(_with_ranges(every, nodes, ranges, limits), seed).select("view_id", "node_key", "is_leaf", "score")


def may_see(clip: Column) -> Column:
    """Whether a corner of some box inside that of ``clip`` could be visible: false only if the whole box lies beyond one
    side of the view, before and behind the eye alike."""
    some = lambda f: F.exists(clip, lambda c: f(c) >= -SLACK)
    before = some(lambda c: c["w"]) & some(lambda c: c["w"] - c["x"]) & some(lambda c: c["w"] + c["x"]) & some(lambda c: c["w"] - c["y"]) & some(lambda c: c["w"] + c["y"]) & some(lambda c: c["z"])
    behind = some(lambda c: -c["w"]) & some(lambda c: c["x"] - c["w"]) & some(lambda c: -c["w"] - c["x"]) & some(lambda c: c["y"] - c["w"]) & some(lambda c: -c["w"] - c["y"]) & some(lambda c: -c["z"])
    return F.coalesce(before | behind, F.lit(False))


#: What rounding may add to a bound, absolute for planes and by share for scores.
SLACK = 1e-6


def score_bound() -> Column:
    """No leaf below a node has a higher score: its box is smaller, its middle is in the node's box and its range in the
    node's range. From columns of ``_scored``; null if there is no bound (scores that are hashes)."""
    extent = F.greatest(*(F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"))
    off = [F.greatest(F.col(f"{a}0") - F.col(f"e{a}"), F.col(f"e{a}") - F.col(f"{a}1"), F.lit(0.0)) for a in "xyz"]
    away = sum((d * d for d in off), F.lit(0.0))
    of_box = F.coalesce(F.try_divide(extent * extent, away), F.lit(float("inf")))
    # What is out of sight or range has 0, even where the eye is inside the box.
    bound = F.when(~may_see(F.col("clip")) | (F.col("of_field") == 0), 0.0).otherwise(of_box * F.col("of_field") * (1 + SLACK))
    return F.when(F.col("iso_name").isNull() & F.col("mat").isNull(), None).otherwise(bound)


def best_leaves(views: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, budget: int) -> tuple[DataFrame, int]:
    """(view_id, leaf_key, score: each view's best ``budget`` leaves with a score over 0, ties to the smaller key; how
    many pairs of a view and a node were looked at).

    The tree is searched from its root, a round at a time, in place of scoring every leaf for every view: of the nodes
    that are open for a view those with the highest bounds are expanded, leaves among their children are scored, and
    whatever cannot reach the view's last place any more is cut. Rounds end when no node is open. Views whose scores are
    hashes have no bounds and expand every node.
    """
    asked = checkpointed(views.select("view_id", "ex", "ey", "ez", "mat", "iso_name", "iso").dropDuplicates(["view_id"]))
    limits = checkpointed(limits)  # a row for each field, wanted in every round
    keyed = nodes.select("node_key", "is_leaf", *BOX)
    root = keyed.where("node_key = 1").crossJoin(broadcast_if_few(asked.select("view_id"), 10_000))
    width = max(budget, 32)
    fresh, open_, found, looked = root.select("view_id", "node_key", "is_leaf", *BOX), None, None, 0
    by_score = Window.partitionBy("view_id").orderBy(F.desc("score"), "leaf_key")
    by_bound = Window.partitionBy("view_id").orderBy(F.desc_nulls_first("bound"), "node_key")
    while True:
        about = checkpointed(_scored(_of_views(fresh, asked, nodes, ranges, limits), 1).withColumn("bound", score_bound()).select("view_id", "node_key", "is_leaf", "score", "bound"))
        looked += about.count()
        leaves = about.where("is_leaf AND score > 0").select("view_id", F.col("node_key").alias("leaf_key"), "score")
        every = leaves if found is None else found.unionByName(leaves)
        found = checkpointed(every.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= budget).drop("place"))
        last = found.groupBy("view_id").agg(F.min("score").alias("last"), F.count("*").alias("n")).where(F.col("n") >= budget).drop("n")
        inner = about.where("NOT is_leaf").select("view_id", "node_key", "bound")
        still = (inner if open_ is None else open_.unionByName(inner)).join(last, "view_id", "left")
        still = still.where("bound IS NULL OR (bound > 0 AND (last IS NULL OR bound >= last))").drop("last")
        ranked = checkpointed(still.withColumn("place", F.row_number().over(by_bound)))
        now = ranked.where((F.col("place") <= width) | F.col("bound").isNull())
        if now.isEmpty():
            return found, looked
        open_ = ranked.where((F.col("place") > width) & F.col("bound").isNotNull()).drop("place")
        below = now.select("view_id", F.explode(F.array(F.col("node_key") * 2, F.col("node_key") * 2 + 1)).alias("node_key"))
        fresh = broadcast_if_few(below, 100_000).join(keyed, "node_key").select("view_id", "node_key", "is_leaf", *BOX)


def sorted_scores(frontier_scores: DataFrame) -> DataFrame:
    """view_id, node_key, score, place: the nodes of each view's frontier, lowest score first."""
    return frontier_scores.select("view_id", "node_key", "score", F.row_number().over(Window.partitionBy("view_id").orderBy("score", "node_key")).alias("place"))


def frontier(nodes: DataFrame, budget: int, *, depth_first: bool = False) -> DataFrame:
    """node_key, is_leaf: the frontier of at most ``budget`` nodes that expanding from the root leaves.

    ceil((budget - 3) / 2) inner nodes are expanded, two or more if the budget allows: breadth first in heap order, left to
    right; depth first in pre-order with right subtrees first.
    """
    expand = max(0, math.ceil((budget - 3) / 2))
    order = [F.translate(F.substring(F.bin("node_key"), 2, 64), "01", "10")] if depth_first else ["node_key"]
    inner = nodes.where("NOT is_leaf").orderBy(*order).limit(expand).select("node_key")  # half the budget's rows
    children = inner.select(F.explode(F.array(F.col("node_key") * 2, F.col("node_key") * 2 + 1)).alias("node_key"))
    root = nodes.where("node_key = 1").select("node_key")
    return nodes.select("node_key", "is_leaf").join(root.union(children).distinct().join(inner, "node_key", "left_anti"), "node_key", "left_semi")


def step(frontier_scores: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(splits: view_id, node_key; merges: view_id, parent_key) of one update of the frontiers.

    frontier_scores: view_id, node_key, is_leaf (of the whole tree), score, state (NONE, MERGED or SPLIT).
    Nodes of the best scores that can be split and weren't just merged, against pairs of siblings of the lowest
    ones that weren't just split; as many of the one as of the other, so the budget holds.
    """
    most = math.ceil(budget * 0.005)
    by_score = Window.partitionBy("view_id").orderBy(F.desc("score"), "node_key")
    ranked = frontier_scores.withColumn("place", F.row_number().over(by_score))
    splits = ranked.where("NOT is_leaf AND state <> 'MERGED'").withColumn("r", F.row_number().over(Window.partitionBy("view_id").orderBy("place"))).where(F.col("r") <= most)
    last_split = splits.groupBy("view_id").agg(F.max("place").alias("lowest_split"))
    pairs = ranked.where("node_key > 1 AND state <> 'SPLIT'").groupBy("view_id", F.expr("node_key div 2").alias("parent_key")).agg(F.count("*").alias("n"), F.min("place").alias("best"), F.max("place").alias("worst")).where("n = 2")
    merges = pairs.join(last_split, "view_id").where("best > lowest_split").join(splits.select("view_id", F.expr("node_key div 2").alias("parent_key")), ["view_id", "parent_key"], "left_anti")
    merges = merges.withColumn("r", F.row_number().over(Window.partitionBy("view_id").orderBy(F.desc("worst")))).where(F.col("r") <= most)
    k = splits.groupBy("view_id").agg(F.max("r").alias("s")).join(merges.groupBy("view_id").agg(F.max("r").alias("m")), "view_id").select("view_id", F.least("s", "m").alias("k"))
    return splits.join(k, "view_id").where("r <= k").select("view_id", "node_key"), merges.join(k, "view_id").where("r <= k").select("view_id", "parent_key")


def applied(frontiers: DataFrame, splits: DataFrame, merges: DataFrame) -> DataFrame:
    """view_id, node_key, state after a step: children of splits are SPLIT, parents of merges MERGED."""
    gone = splits.select("view_id", "node_key").union(merges.select("view_id", F.explode(F.array(F.col("parent_key") * 2, F.col("parent_key") * 2 + 1))))
    stay = frontiers.join(gone, ["view_id", "node_key"], "left_anti").select("view_id", "node_key", F.lit("NONE").alias("state"))
    new = splits.select("view_id", F.explode(F.array(F.col("node_key") * 2, F.col("node_key") * 2 + 1)).alias("node_key"), F.lit("SPLIT").alias("state"))
    return stay.union(new).union(merges.select("view_id", F.col("parent_key").alias("node_key"), F.lit("MERGED").alias("state")))


def reset(frontiers: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """view_id, node_key, state: all states of a view are NONE again once its camera or iso-value has changed.

    before, now: view_id and what a view looks like; a view that is new, or differs in any column, has changed.
    """
    names = [c for c in now.columns if c != "view_id" and c in before.columns]
    same = before.select("view_id", *(F.col(c).alias(f"was_{c}") for c in names)).join(now, "view_id")
    for c in names:
        same = same.where(F.col(f"was_{c}").eqNullSafe(F.col(c)))
    kept = frontiers.join(same.select("view_id", F.lit(True).alias("same")).distinct(), "view_id", "left")
    return kept.select("view_id", "node_key", F.when(F.col("same"), F.col("state")).otherwise("NONE").alias("state"))


def blocks_to_load(frontier_scores: DataFrame, resident: DataFrame, budget: int) -> DataFrame:
    """view_id, leaf_key, score: the best true leaves of each view's frontier within the budget that aren't resident."""
    best = Window.partitionBy("view_id").orderBy(F.desc("score"), "node_key")
    wanted = frontier_scores.where("is_leaf AND score > 0").withColumn("r", F.row_number().over(best)).where(F.col("r") <= budget).select("view_id", F.col("node_key").alias("leaf_key"), "score")
    return wanted.join(resident, ["view_id", "leaf_key"], "left_anti")


def refreshed(resident: DataFrame, frontier_scores: DataFrame) -> DataFrame:
    """view_id, leaf_key, score of resident blocks: the present one, minus infinity for what left the frontier."""
    now = frontier_scores.select("view_id", F.col("node_key").alias("leaf_key"), "score")
    return resident.select("view_id", "leaf_key").join(now, ["view_id", "leaf_key"], "left").select("view_id", "leaf_key", F.coalesce("score", F.lit(float("-inf"))).alias("score"))
