"""Approximate nearest neighbours by collision counting with query-aware hashing.

Each hash is one random projection, kept as a sorted array. A query's window in it is centred on the query's own
projection, and virtual rehashing widens all windows together as the search radius grows. A vector inside enough
windows at once is verified by its exact cosine.

Rows are dealt into blocks at random; the task of a block builds its sorted arrays once and then takes the queries as
they come. A query first searches one block: its k-th neighbour there bounds the radius, so in the other blocks one
window of that width is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, checkpointed

PROJECTIONS = 256
#: Half a window's width by radius, and the radii (Euclidean, of unit vectors) that are tried in turn.
HALF_WIDTH, RADII = 0.75, (0.15, 0.4, 0.6, 0.8, 0.9, 1.0, 1.05, 1.1, 1.15, 1.2, 1.3)
#: Rows in a block, and queries that are placed in its arrays at a time.
ROWS, QUERIES = 8192, 256


def needed(projections: int = PROJECTIONS) -> int:
    """Windows that a vector has to be in: what a vector at the very radius reaches in nine of ten cases."""
    p = 0.5467  # of a normal number within HALF_WIDTH of 0
    return max(1, int(np.floor(projections * p - 1.28 * np.sqrt(projections * p * (1 - p)))))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part.

    Vectors that are null, empty, zero or hold a null or non-finite component take none, nor do rows without
    vec_id, nor vectors of another length than the commonest (of equally common ones, the longest).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (sizes.n if sizes else 0))


class Block:
    """The sorted arrays of a block of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 1) -> None:
        # Scaled first, so that squares neither overflow nor vanish.
        self.ids, self.x = ids, x / np.abs(x).max(axis=1, keepdims=True)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.a = np.random.default_rng(seed).normal(size=(x.shape[1], PROJECTIONS))
        projected = ((self.x / self.norm[:, None]) @ self.a).T
        self.order = np.argsort(projected, axis=1)
        self.arrays = np.take_along_axis(projected, self.order, axis=1)
        self.verified = 0

    def spans(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the windows, by projection, query and radius (radii: of each query, or the same for all)."""
        half = HALF_WIDTH * (1 + 1e-9) * radii + 1e-9
        sides = ((-1, "left"), (1, "right"))
        return tuple(np.stack([np.searchsorted(self.arrays[j], centres[:, j, None] + sign * half, side) for j in range(PROJECTIONS)]) for sign, side in sides)

    def search(self, query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the nearest rows that each query finds. bounds: a cosine that its k-th has at
        least; where it is NaN, windows widen until k verified rows lie within their radius."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        norm = np.sqrt((q * q).sum(axis=1))
        centres = (q / norm[:, None]) @ self.a
        out = []
        for at in range(0, len(q), QUERIES):
            part = np.arange(at, min(at + QUERIES, len(q)))
            for bounded in (True, False):
                some = part[np.isfinite(bounds[part]) == bounded]
                radii = np.sqrt(np.maximum(0, 2 - 2 * bounds[some]))[:, None] if bounded else np.array(RADII)
                left, right = self.spans(centres[some], radii) if len(some) else (None, None)
                for i, me in enumerate(some):
                    found, scores = self.nearest(query_ids[me], q[me], norm[me], left[:, i], right[:, i], radii[i] if bounded else radii, k, bounded)
                    best = np.lexsort((self.ids[found], -scores))[:k]
                    out += zip([int(query_ids[me])] * len(best), self.ids[found][best].tolist(), scores[best].tolist(), strict=True)
        return out

    def nearest(self, query_id: int, q: np.ndarray, norm: float, left: np.ndarray, right: np.ndarray, radii: np.ndarray, k: int, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        hits, checked = np.zeros(len(self.ids), np.int64), self.ids == query_id
        found, scores, inner = [np.zeros(0, int)], [np.zeros(0)], None
        for r in range(len(radii) + (not bounded)):
            if r == len(radii):
                new = np.flatnonzero(~checked)
            else:
                spans = list(zip(left[:, r].tolist(), right[:, r].tolist(), strict=True))
                if inner is None:
                    fresh = [self.order[j, a:b] for j, (a, b) in enumerate(spans)]
                else:
                    fresh = [s for j, ((a, b), (c, d)) in enumerate(zip(spans, inner, strict=True)) for s in (self.order[j, a : min(c, b)], self.order[j, max(d, a) : b])]
                inner = spans
                hits += np.bincount(np.concatenate(fresh), minlength=len(hits))
                new = np.flatnonzero((hits >= needed()) & ~checked)
            checked[new] = True
            found.append(new)
            scores.append((self.x[new] * q).sum(axis=1) / (self.norm[new] * norm))
            self.verified += len(new)
            if r < len(radii) and sum(map(len, found)) >= k:
                # The k-th of the verified ones lies within the radius, so windows were wide enough.
                if 2 - 2 * np.partition(np.concatenate(scores), -k)[-k] <= radii[r] ** 2:
                    break
        return np.concatenate(found), np.concatenate(scores)


def _searched(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of what each query (vec_id, vector, bound) finds in its block of rows (vec_id, vector)."""
    bounded_batches(rows.sparkSession)
    both = rows.select("block", F.lit(0).alias("kind"), "vec_id", "vector", F.lit(None).cast("double").alias("bound")).unionByName(queries.select("block", F.lit(1).alias("kind"), "vec_id", "vector", "bound"))
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            blocks, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bounds = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            change = np.flatnonzero(np.diff(2 * blocks.astype(np.int64) + kinds, prepend=-1)) if batch.num_rows else []
            for a, b in zip(change, [*change[1:], batch.num_rows], strict=True):
                if blocks[a] != number:
                    number, held, block = blocks[a], [], None
                if kinds[a] == 0:
                    held.append((ids[a:b].copy(), x[a:b].copy()))
                elif held or block:
                    block = block or Block(*(np.concatenate(y) for y in zip(*held, strict=True)))
                    held = []
                    found = block.search(ids[a:b], x[a:b], bounds[a:b], k)
                    yield batch_of(arrow, [[f[i] for f in found] for i in range(3)])

    sorted_ = both.repartition("block").sortWithinPartitions("block", "kind")
    return sorted_.select("block", "kind", "vec_id", "vector", "bound").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the k nearest found of
    all rows with another vec_id (all of them, if fewer), by the cosine of the original vectors in double
    precision; ties go to the smaller vec_id.

    Rows that can't take part (see ``valid``) neither ask nor answer; without any, or in an empty table, there are no
    rows. Repeated rows answer once, and ask once; of rows with one vector the k + 1 with the least vec_id answer, as
    others can't be among the k nearest. Other columns take no part, whatever their names.
    """
    rows = checkpointed(valid(vectors).dropDuplicates(["vec_id", "vector"]))
    queries = rows.where(F.col("vec_id") % every == 0)
    same = Window.partitionBy("vector").orderBy("vec_id")
    answers = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    blocks = max(1, -(-rows.count() // ROWS))
    block = lambda salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)).cast("int")
    answers = checkpointed(answers.withColumn("block", block(5)))
    own = checkpointed(_searched(answers, queries.select("vec_id", "vector", F.lit(None).cast("double").alias("bound"), block(7).alias("block")), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != block(7))).alias("block")
    rest = _searched(answers, queries.join(bounds, "vec_id", "left").select("vec_id", "vector", "bound", others), k)
    return own.union(rest).dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
