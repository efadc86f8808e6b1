"""Centroid clustering whose assignment is a tournament of bisectors, in exact integers.

Between centroids i and j lies a bisecting plane. With the normal 2 (c_j - c_i) and the threshold |c_j|^2 - |c_i|^2, both
integers that are computed once a round for all pairs, a vector is nearer to j than to i if its product with the normal
is over the threshold; on the plane the smaller number wins. k - 1 such tests, each of the winner so far against the
next centroid, leave the nearest one, whose distance alone is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, checkpointed

#: Components are multiplied by this before they are rounded down.
SCALE = 256
#: Vectors that are assigned at a time; the largest component up to which 64-bit integers hold every product.
ROWS, SMALL = 4096, 1 << 26
#: Components from here on have no place in a long.
TOO_LARGE = 1 << 62
SUMS = "cluster int, members long, sums array<decimal(38,0)>"
SUMS_ARROW = pa.schema([("cluster", pa.int32()), ("members", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
ASSIGNED = "vec_id long, cluster int, distance long"
ASSIGNED_ARROW = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def kept(vectors: DataFrame, dimensions: int = 64) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part: vectors of just so many components, none of them null,
    non-finite or so large that the integer made of it has no place in a long."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(TOO_LARGE // SCALE)))
    return rows.where((F.size("vector") == dimensions) & fits)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or Python's where their products need more."""
    whole = np.floor(values * SCALE)
    return whole.astype(np.int64) if not whole.size or np.abs(whole).max() <= SMALL else np.array([[int(v) for v in row] for row in whole], object).reshape(whole.shape)


class Tournament:
    """The bisectors of centroids (rows of integers), and the winners for vectors."""

    def __init__(self, centroids: np.ndarray) -> None:
        exact = np.array([[int(v) for v in row] for row in centroids], object).reshape(len(centroids), -1)
        squares = (exact * exact).sum(axis=1)
        self.small = not exact.size or max(abs(int(exact.min())), abs(int(exact.max()))) <= SMALL
        self.exact = self._planes(exact, squares)
        self.fast = self._planes(exact.astype(np.int64), squares.astype(np.int64)) if self.small else None

    @staticmethod
    def _planes(c: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids; by pair (i, j), the normals and thresholds."""
        return c, 2 * (c[None, :, :] - c[:, None, :]), squares[None, :] - squares[:, None]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, and the squared distance to it, of every row."""
        centroids, normals, thresholds = self.fast if x.dtype != object and self.small else self.exact
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(centroids)):
            sign = (x * normals[winner, j]).sum(axis=1) - thresholds[winner, j]
            winner[(sign > 0).astype(bool)] = j
        away = x - centroids[winner]
        return winner, (away * away).sum(axis=1)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and integers of a batch, ROWS at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part.column(0), integers(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))


def _summed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """SUMS of the members of every centroid: combined in each task first, k rows of which are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        members = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, object)
        for batch in batches:
            for _, x in _rows(batch):
                winner, _ = tournament.assign(x)
                order = np.argsort(winner, kind="stable")
                own, first, count = np.unique(winner[order], return_index=True, return_counts=True)
                members[own] += count
                sums[own] += np.add.reduceat(x[order], first, axis=0).astype(object)
        some = np.flatnonzero(members)
        yield batch_of(SUMS_ARROW, [some, members[some], [[Decimal(int(v)) for v in sums[i]] for i in some]])

    parts = rows.mapInArrow(run, SUMS).select("cluster", "members", F.posexplode("sums").alias("i", "v"))
    by_place = parts.groupBy("cluster", "i").agg(F.sum("members").alias("members"), F.sum("v").alias("total"))
    return by_place.groupBy("cluster").agg(F.max("members").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda c: c["total"]).alias("sums"))


def fit(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> np.ndarray:
    """The centroids (integers) of rows (of ``kept``) after so many rounds: at most k rows come to the driver in each.

    They start as the k vectors with the least SHA-256 of ``seed:vec_id`` (rows without vec_id last, ties by the vector
    itself) and become the means of their members, rounded down; those without members stay.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    centroids = np.array([[int(np.floor(v * SCALE)) for v in r.vector] for r in first], object).reshape(len(first), len(first[0].vector) if first else 0)
    for _ in range(rounds if first else 0):
        centroids = centroids.copy()
        for r in _summed(rows, centroids).collect():
            centroids[r.cluster] = [int(v) // r.members for v in r.sums]
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared; null where it has no place in a long) of rows (of ``kept``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        for batch in batches:
            for ids, x in _rows(batch):
                winner, distance = tournament.assign(x)
                yield batch_of(ASSIGNED_ARROW, [ids, winner, [int(d) if int(d) < 1 << 63 else None for d in distance]])

    return rows.mapInArrow(run, ASSIGNED)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of integers), of every row that takes part
    (see ``kept``; vec_id (embedding: vector), other columns take no part, whatever their names).

    Repeated rows are members of their own. Rows without vec_id take part. Fewer than k rows give as many centroids. An
    empty table, or one where no row takes part, gives no rows. Sums that have no place in a long are null.
    """
    bounded_batches(vectors.sparkSession)
    rows = kept(vectors, dimensions)
    centroids = fit(rows, k, rounds, seed)
    found = checkpointed(assigned(rows, centroids))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    of_cluster = sums.select("cluster", F.expr("try_cast(own AS bigint)").alias("cluster_inertia")).crossJoin(F.broadcast(sums.agg(F.expr("try_cast(sum(own) AS bigint)").alias("inertia"))))
    table = vectors.sparkSession.createDataFrame([(i, [Decimal(int(v)) for v in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<decimal(38,0)>")
    # At most k rows on either of the broadcast sides.
    return found.join(F.broadcast(of_cluster), "cluster").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
