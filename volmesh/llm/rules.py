"""Quality rules, and an isolation forest on their statistics.

Trees split a sample of texts that labels call good, at random places of random statistics; a text that few
splits set apart is unlike them. All labelled rows set the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_KEY, batch_of, checkpointed
from .quality import held_out, labels_of, moments, sampled, shares_of
from .textstats import COUNTS, matrix, text_statistics

TREES, TREE_ROWS = 200, 256
#: Texts that the trees draw their TREE_ROWS from, at most.
MOST_GROWN = 20_000
#: Share of the texts with label 1 that the threshold keeps at least.
KEEP_GOOD = 0.995


def unsuccessful(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search that fails among n values."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Nodes of all trees in parallel arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    at: np.ndarray
    children: np.ndarray
    length: np.ndarray
    norm: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for texts that are easier to set apart."""
        if not len(self.roots):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.children[node, (x[rows, self.feature[node]] > self.at[node]).astype(int)]
            total += self.length[node]
        return 2 ** (-total / len(self.roots) / self.norm)


def grow(x: np.ndarray, spread: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 1) -> Forest:
    """spread: of each statistic among texts of all kinds. Splits may fall that far outside what the rows span,
    so that texts are set apart that differ where good ones are all alike."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
    nodes: list[list] = []
    roots = []
    for _ in range(trees if rows > 1 else 0):
        todo = [(x[rng.choice(len(x), rows, replace=False)], 0, -1, 0)]
        roots.append(len(nodes))
        while todo:
            part, level, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([0, np.inf, me, me, level + float(unsuccessful(len(part)))])
            if parent >= 0:
                nodes[parent][2 + side] = me
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high - low + spread > 0)
            if level < depth and len(part) > 1 and len(wide):
                f = int(rng.choice(wide))
                at = rng.uniform(low[f] - spread[f], high[f] + spread[f])
                nodes[me][:2] = f, at
                right = part[:, f] > at
                for s, sub in ((0, part[~right]), (1, part[right])):
                    if len(sub):
                        todo.append((sub, level + 1, me, s))
                    else:
                        nodes[me][2 + s] = len(nodes)
                        nodes.append([0, np.inf, len(nodes), len(nodes), level + 1.0])
    columns = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    return Forest(np.array(roots, int), np.array(columns[0], int), np.array(columns[1], float), np.stack([np.array(columns[2], int), np.array(columns[3], int)], axis=1), np.array(columns[4], float), max(1e-9, float(unsuccessful(max(2, rows)))), depth)


def threshold(scores: DataFrame) -> float:
    """The score that rejects most of the bad texts for the good ones it costs, and at most 1 - KEEP_GOOD of these, over all
    rows of scores (label, score); infinite without both kinds.

    Scores are ranked within ranges of them, plus what stands before, so no task ranks all.
    """
    good, bad = F.sum((F.col("label") == 1).cast("long")), F.sum((F.col("label") == 0).cast("long"))
    counted = checkpointed(scores.groupBy("score").agg(good.alias("g"), bad.alias("b")).repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    sums = counted.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = sums.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "gb"))
    along = Window.partitionBy("part").orderBy("score")
    upto = checkpointed(counted.join(F.broadcast(starts), "part").select("score", "g", "b", *((F.sum(c).over(along) + F.col(f"{c}_before")).alias(f"{c}_upto") for c in "gb")))
    n, m = (v or 0 for v in counted.agg(F.sum("g"), F.sum("b")).first())
    if not n or not m:
        return float("inf")
    place = KEEP_GOOD * (n - 1)
    low, high = upto.agg(*(F.min(F.when(F.col("g_upto") > k, F.col("score"))) for k in (int(np.floor(place)), int(np.ceil(place))))).first()
    least = float(np.quantile(np.array([low, high]), place - np.floor(place)))
    caught = lambda g, b: (m - b) / F.lit(float(m)) - 3 * ((n - g) / F.lit(float(n)))
    at_least = upto.where(F.col("score") <= least).agg(caught(F.sum("g"), F.sum("b"))).first()[0]
    best = upto.where(F.col("score") > least).select("score", caught(F.col("g_upto"), F.col("b_upto")).alias("caught")).orderBy(F.desc("caught"), "score").first()
    return best.score if best and best.caught > at_least else least


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, COUNTS, base_failed, score, kept per row of docs.

    base_failed: under 10 words, or over a fifth of the words in windows of five that the text repeats. kept:
    false if base_failed, or if the forest's score is over the threshold. Null texts are empty and fail. Without
    labels of both kinds there is no threshold and the base rules alone decide; the forest is then grown on
    any texts. Labels of the held-out fold aren't read. Repeated rows are judged alike; a score at the threshold passes.
    Texts of any length are counted whole. An empty table gives no rows. Other columns take no part, whatever their names.
    """
    stats = checkpointed(text_statistics(docs))
    known = stats.join(labels_of(labels), "doc_id").where(~held_out(F.col("doc_id")))
    good = shares_of(sampled(known.where("label = 1"), MOST_GROWN))
    forest = grow(good if len(good) else shares_of(sampled(stats, MOST_GROWN)), moments(stats)[1])
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), *((c, pa.int64()) for c in COUNTS), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of(arrow, [*batch.columns[:-1], pa.array(forest.score(matrix(batch)))])

    schema = f"doc_id long, {TEXT_KEY} long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    scored = checkpointed(stats.mapInArrow(run, schema))
    known = scored.join(labels_of(labels), "doc_id").where(~held_out(F.col("doc_id")))
    limit = threshold(known.select("label", "score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") <= F.lit(float(limit))))
