"""Sweeps over leaf sizes and split strategies as jobs that can be taken up again.

Each pair of a strategy and a leaf size is an output of its own, a folder of Parquet files under the sweep's. What a
sweep has written it skips when it is run again, unless it is forced, so a sweep that was stopped goes on where it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volmesh.operators import tree

SCHEMA = "strategy string, target long, nodes long, leaves long, leaf_cells long, max_cells long, small_leaves long, max_depth int, repeated_cells long"


def path_of(out: str, strategy: str, target: int) -> str:
    return f"{out.rstrip('/')}/{strategy.lower()}-{target}"


def written(spark: SparkSession, out: str, strategy: str, target: int) -> bool:
    """Whether an output is there: files are only moved to their folder once all of them are written."""
    try:
        return bool(spark.read.parquet(path_of(out, strategy, target)).columns)
    except AnalysisException:
        return False


def _cut(nodes: DataFrame, target: int, max_depth: int) -> DataFrame:
    """The nodes of the tree for a larger leaf size, of a node-median tree for a smaller one: splits don't depend on it."""
    above = nodes.select(F.col("node_key").alias("parent_key"), F.col("cell_count").alias("parent_cells"))
    kept = nodes.join(above, "parent_key", "left").where(F.col("parent_cells").isNull() | (F.col("parent_cells") > target))
    return kept.withColumn("is_leaf", (F.col("cell_count") <= target) | (F.col("depth") >= max_depth)).drop("parent_cells")


def report(nodes: DataFrame, n_cells: int, strategy: str, target: int) -> DataFrame:
    """SCHEMA of a tree over so many cells. repeated_cells: places of cells in leaves beyond one for each cell."""
    s = tree.statistics(nodes)
    return s.select(F.lit(strategy).alias("strategy"), F.lit(target).cast("long").alias("target"), "nodes", "leaves", "leaf_cells", "max_cells", "small_leaves", "max_depth", (F.col("leaf_cells") - n_cells).alias("repeated_cells"))


def sweep(bounds: DataFrame, box: tuple[tuple, tuple], targets: list[int], strategies: tuple[str, ...] = tree.STRATEGIES, *, out: str, points: DataFrame | None = None, max_depth: int = 40, force: bool = False) -> DataFrame:
    """SCHEMA of all pairs of strategies and targets (leaf sizes), those written before read and the others built.

    One node-median tree for the smallest missing target answers for all larger ones; other strategies' splits or stops
    depend on the target, or on the vertices left, and each target has a tree of its own.
    """
    spark = bounds.sparkSession
    missing = {s: [t for t in sorted(set(targets)) if force or not written(spark, out, s, t)] for s in strategies}
    n_cells = bounds.count() if any(missing.values()) else 0
    for strategy, todo in missing.items():
        if not todo:
            continue
        if strategy == tree.NODE_MEDIAN:
            nodes, _ = tree.build_tree(bounds, box, strategy, todo[0], max_depth)
            trees = {t: _cut(nodes, t, max_depth) for t in todo}
        else:
            trees = {t: None for t in todo}
        for target in todo:
            found = trees[target] if trees[target] is not None else tree.build_tree(bounds, box, strategy, target, max_depth, points)[0]
            report(found, n_cells, strategy, target).coalesce(1).write.mode("overwrite").parquet(path_of(out, strategy, target))
    return spark.read.schema(SCHEMA).parquet(*(path_of(out, s, t) for s in strategies for t in dict.fromkeys(targets)))
