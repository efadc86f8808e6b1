"""Connected components of links in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gathered, released


def _minimum(links: DataFrame, of: str, over: str) -> DataFrame:
    return links.groupBy(F.col(of).alias("hub")).agg(F.min(over).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links (a, b), two columns of one ordered type.

    Links may repeat, point either way or at their own node; nulls link nothing. Every round takes the least
    neighbour of each node by an aggregate that combines before the shuffle and joins it back to the links,
    so a node with most of the links is never gathered in a task. Rounds grow with the logarithm of the size; what fits in
    one partition is one task's, as no step gives more than two rows for a link.
    """
    given = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    linked = released(checkpointed(given.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()))
    rows = linked.count()
    linked = gathered(linked, rows)
    nodes = linked.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    # hi > lo in each row
    edges, before = linked.where("hi <> lo"), None
    while True:
        # Not a union: that of two single partitions has two.
        both = edges.select(F.explode(F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), F.col("hi").alias("lo")))).alias("e")).select("e.*")
        least = gathered(_minimum(both, "hi", "lo").select("hub", F.least("hub", "least").alias("least")), 2 * rows)
        # Large star: neighbours above a node go to its least neighbour.
        large = gathered(edges.join(least, F.col("lo") == F.col("hub")).select("hi", F.col("least").alias("lo")), rows)
        large = gathered(large.distinct(), rows)
        # Small star: a node and its neighbours below go to the least of them.
        small = gathered(_minimum(large, "hi", "lo"), rows)
        edges_now = (
            gathered(large.join(small, F.col("hi") == F.col("hub")), rows)
            .select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("least").alias("y")), F.struct(F.col("lo").alias("x"), F.col("least").alias("y")))).alias("e"))
            .select(F.col("e.x").alias("hi"), F.col("e.y").alias("lo"))
            .where("hi <> lo")
        )
        edges_now = checkpointed(gathered(edges_now.distinct(), 2 * rows))
        state = edges_now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        rows = state[0]
        edges = gathered(edges_now, rows)
        if state == before:
            break
        before = state
    return nodes.join(edges, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("lo", "node").alias("component"))
