"""A Merkle manifest of a dataset, and a proof of every document by pointer jumping.

Leaves are digests of rows. Those of a source are ranked by doc_id and hashed upwards in runs of ``FAN`` until one node,
the source's subroot, is left; subroots are hashed in the same way until the root is left.

A node's pointer holds an ancestor and the segment of siblings on the way there, first only its parent and its own run.
Joining the pointers with themselves doubles the distance: a node's segment is followed by that of its ancestor. After
log2(height) joins all segments reach the root. The leaves of a run share all of their way but the run itself, so they
travel as one row with their run's digests, and their proofs are put together from these and their parent's segment.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, gathered

#: Nodes in a run.
FAN = 16
#: The tree of subroots; sources' trees are numbered from 0 on.
TOP = -1
#: Ancestors that are broadcast at most, with a segment each.
FEW = 1000

KEY = ("tree", "level", "pos")


def token(value: Column) -> Column:
    """A value as it enters a leaf: its length in UTF-8 bytes, a colon, itself; of null, a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(token, (doc_id, source, lang, n_chars, text))), 256)


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str, count: int) -> DataFrame:
    """rows with ``name``: their place within their group (from 0 on, nulls first) and ``n``, the group's rows.

    Ranges of rows go to tasks, however few groups they are in; a row's place is that in its task and what its group
    has in the tasks before. Rows that are alike in all columns may be in several ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = gathered(checkpointed(dealt.drop("tie").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})), count)
    counts = dealt.groupBy(*group, "part").agg(F.count("*").alias("n_part"), F.min("at").alias("first"))
    of_group = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("n_part").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.struct(*group, "part").alias("of"), (before - F.col("first")).alias("shift"), F.sum("n_part").over(of_group).alias("n"))
    placed = dealt.withColumn("of", F.struct(*group, "part")).join(starts, "of")
    return placed.withColumn(name, F.col("at") + F.col("shift")).drop("of", "part", "at", "shift")


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _siblings(hashes: Column, slot: Column) -> Column:
    """What stands before and after a place of a run."""
    return F.struct(_joined(F.slice(hashes, F.lit(1), slot)).alias("before"), _joined(F.slice(hashes, slot + 2, F.lit(FAN))).alias("after"))


def _runs(nodes: DataFrame) -> DataFrame:
    """tree, pos (of the parent), n (parents of the tree on their level), hashes, hash: runs of nodes (tree, pos, n, hash)."""
    of_run = nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda c: c["hash"]).alias("hashes"))
    return of_run.select("tree", "pos", F.ceil(F.col("n") / FAN).alias("n"), "hashes", F.sha2(_joined(F.col("hashes")), 256).alias("hash"))


def _hashed_up(nodes: DataFrame, most: int, rows: int, trees: int) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, level, hash of the roots; by level, from 0 on, the runs of its nodes) of so many trees that have ``rows``
    nodes together and ``most`` at most."""
    runs, roots, level = [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.lit(level).alias("level"), "hash"))
        if most <= 1:
            return reduce(DataFrame.union, roots), runs
        rows = rows // FAN + trees
        runs.append(gathered(checkpointed(_runs(nodes.where("n > 1"))), rows))
        nodes, most, level = runs[-1].drop("hashes"), -(-most // FAN), level + 1


def _pointers(runs: list[DataFrame], first: int) -> list[DataFrame]:
    """KEY, up (KEY of the parent), segment of the nodes on the levels from ``first`` on."""
    out = []
    for level in range(first, len(runs)):
        each = runs[level].select("tree", F.col("pos").alias("run"), "hashes", F.posexplode("hashes").alias("slot", "own"))
        out.append(each.select("tree", F.lit(level).alias("level"), (F.col("run") * FAN + F.col("slot")).alias("pos"), F.struct("tree", F.lit(level + 1).alias("level"), F.col("run").alias("pos")).alias("up"), F.array(_siblings(F.col("hashes"), F.col("slot"))).alias("segment")))
    return out


def _jumped(pointers: DataFrame, height: int, rows: int) -> DataFrame:
    """KEY, subroot, segment of every node, through to the root, by doubling the distance to the ancestor in ``up``."""
    reach = 1
    now = gathered(checkpointed(pointers), rows)
    while reach < height:
        live = now.where("up IS NOT NULL")
        wanted = live.select("up.*").distinct()
        above = now.join(wanted, list(KEY), "left_semi").select(F.struct(*KEY).alias("up"), F.col("up").alias("further"), F.col("subroot").alias("its"), F.col("segment").alias("more"))
        few = above.limit(FEW + 1).count() <= FEW
        joined = live.join(F.broadcast(above) if few else above, "up").select(*KEY, F.col("further").alias("up"), F.coalesce("subroot", "its").alias("subroot"), F.concat("segment", "more").alias("segment"))
        now = gathered(checkpointed(now.where("up IS NULL").select(*KEY, "up", "subroot", "segment").union(joined)), rows)
        reach *= 2
    return now


def folded(start: Column, segment: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(segment, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_text(segment: Column) -> Column:
    return F.aggregate(segment, F.lit(""), lambda t, s: F.concat(t, s["before"], s["after"]))


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, segment (array of struct<before, after>: the siblings of each level, the run's own
    first), tampered_leaf of every row of docs (doc_id, source, lang, n_chars, text; other columns take no part).

    tampered: which rows' texts (a condition on doc_id) have their A-Z in lower case in tampered_leaf, which is the leaf
    itself of all others. Nulls are dashes in a leaf and come first in every order; rows with one doc_id are ordered by
    their leaves, and repeated rows are leaves of their own. An empty table has no root and gives no rows. A text of any
    length is hashed whole, and only digests are moved.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *(F.col(c).cast(t).alias(c) for c, t in (("lang", "string"), ("n_chars", "long"), ("text", "string"))))
    if tampered is not None:
        given = given.withColumn("changed", F.when(tampered, lowered(F.col("text"))).otherwise(F.col("text")))
    leaf = lambda t: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col(t))
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf("changed"))
    leaves = checkpointed(given.select("doc_id", "source", leaf("text").alias("hash"), other.alias("other")))
    n_rows = leaves.count()
    leaves = gathered(leaves, n_rows)
    of_source = checkpointed(leaves.groupBy("source").agg(F.count("*").alias("rows")))
    n_trees, most = of_source.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    sources = ranked(gathered(of_source, n_trees), [], ["source"], "tree", n_trees).drop("n")
    placed = ranked(leaves, ["source"], ["doc_id", "hash"], "pos", n_rows)
    # A source may hold a third of all rows: few sources are broadcast, and the rows of more spread over many.
    numbers = sources.select(F.struct("source").alias("of"), F.col("tree").cast("long").alias("tree"))
    nodes = checkpointed(placed.withColumn("of", F.struct("source")).join(F.broadcast(numbers) if n_trees <= FEW else numbers, "of").select("tree", "pos", "n", "doc_id", "hash", "other"))
    whole = nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("run")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "doc_id", "hash", "other"))).alias("leaves"))
    roots, runs = _hashed_up(nodes.select("tree", "pos", "n", "hash"), most, n_rows, n_trees)
    subroots = gathered(checkpointed(roots), n_trees)
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "hash")
    top_roots, top_runs = _hashed_up(tops, n_trees, n_trees, 1)
    # A subroot is the top tree's leaf: its pointer leads on from there.
    at_top = _pointers(top_runs, 0)
    tree_key = subroots.select("tree", "level", F.lit(0).cast("long").alias("pos"), F.col("hash").alias("subroot"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    no_way = F.lit(None).cast("struct<tree:bigint,level:int,pos:bigint>")
    if at_top:
        links = at_top[0].select(F.col("pos").alias("tree"), "up", "segment")
        crossing = tree_key.join(links, "tree").select(*KEY, "up", "subroot", "segment")
    else:
        crossing = tree_key.select(*KEY, no_way.alias("up"), "subroot", none.alias("segment"))
    without = lambda df: df.select(*KEY, F.col("up").cast("struct<tree:bigint,level:int,pos:bigint>").alias("up"), F.lit(None).cast("string").alias("subroot"), "segment")
    parts = [crossing, *map(without, (*_pointers(runs, 1), *at_top[1:]))]
    if at_top:
        parts.append(top_roots.select("tree", "level", F.lit(0).cast("long").alias("pos"), no_way.alias("up"), F.lit(None).cast("string").alias("subroot"), none.alias("segment")))
    ways = _jumped(reduce(DataFrame.union, parts), len(runs) + len(top_runs) + 1, n_rows // 8 + 2 * n_trees)
    root = top_roots.select(F.col("hash").alias("root"))
    alone = F.col("n") == 1
    of_run = whole.select(F.col("tree"), F.when(alone, 0).otherwise(1).alias("level"), F.col("run").alias("pos"), "leaves").join(ways.select(*KEY, "subroot", "segment"), list(KEY))
    each = of_run.select("subroot", "segment", "level", F.transform("leaves", lambda c: c["hash"]).alias("hashes"), F.posexplode("leaves").alias("slot", "one"))
    own = F.when(F.col("level") == 0, none).otherwise(F.array(_siblings(F.col("hashes"), F.col("slot"))))
    out = each.select("one.doc_id", F.col("one.hash").alias("leaf"), "subroot", F.concat(own, "segment").alias("segment"), F.coalesce("one.other", "one.hash").alias("tampered_leaf"))
    return out.crossJoin(F.broadcast(root)).select("doc_id", "leaf", "subroot", "root", "segment", "tampered_leaf")  # one root


def verified(proven: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of ``proofs``: what each (tampered) leaf and the
    siblings of its proof fold to, and whether that is the root."""
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("segment")), 256).alias("proof_sha256"), folded(F.col("tampered_leaf"), F.col("segment")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
