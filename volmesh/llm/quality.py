"""A quality classifier from positive and unlabelled texts.

A small network minimises the non-negative unbiased risk: with prior p, trusted positives P and unlabelled web
text U, p * loss(P, +1) + max(0, loss(U, -1) - p * loss(P, -1)). Negative labels only serve to estimate p.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import TEXT_KEY, batch_of, checkpointed
from .textstats import SHARES, matrix, text_statistics

FOLDS = 5
#: Positives and unlabelled texts that are fitted at most, chosen by a hash of doc_id and text over the whole table.
MOST_POSITIVE, MOST_UNLABELLED = 20_000, 40_000
THRESHOLD = 0.3


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        a, b, *_ = self.weights
        return z, np.tanh(z @ a + b)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def constant(value: float) -> Network:
    n = len(SHARES)
    return Network(np.zeros(n), np.ones(n), [np.zeros((n, 1)), np.zeros(1), np.zeros(1), np.array(np.log(value / (1 - value)))])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, units: int = 24, epochs: int = 60, rate: float = 0.01, seed: int = 1, moments_of_all: tuple[np.ndarray, np.ndarray] | None = None) -> Network:
    """Adam over mini-batches that hold both kinds in their proportion; logistic loss.

    moments_of_all: mean and deviation of the statistics over all unlabelled texts, if ``unlabelled`` is a sample.
    """
    prior = min(max(prior, 0.01), 0.99)
    if not len(positive) or not len(unlabelled):
        return constant(prior)
    rng, d = np.random.default_rng(seed), positive.shape[1]
    centre, scale = (unlabelled.mean(axis=0), unlabelled.std(axis=0)) if moments_of_all is None else moments_of_all
    net = Network(centre, np.where(scale > 1e-9, scale, 1), [rng.normal(0, 1 / np.sqrt(d), (d, units)), np.zeros(units), rng.normal(0, 1 / np.sqrt(units), units), np.zeros(())])
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    batches, step = max(1, len(unlabelled) // 2000), 0
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))
    for epoch in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True):
            if not len(p):
                continue
            x = np.concatenate([positive[p], unlabelled[u]])
            z, h = net.hidden(x)
            g = h @ net.weights[2] + net.weights[3]
            gp, gu = g[: len(p)], g[len(p) :]
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # Derivatives of the losses; where the negative part falls below zero only that part is undone.
            if negative >= 0:
                slope = np.concatenate([prior * (-sigmoid(-gp) - sigmoid(gp)) / len(p), sigmoid(gu) / len(u)])
            else:
                slope = np.concatenate([prior * sigmoid(gp) / len(p), -sigmoid(gu) / len(u)])
            back = np.outer(slope, net.weights[2]) * (1 - h * h)
            gradients = [z.T @ back + 1e-5 * net.weights[0], back.sum(axis=0), h.T @ slope, slope.sum()]
            step += 1
            for w, (m, v), dw in zip(range(4), moments, gradients, strict=True):
                m += 0.1 * (dw - m)
                v += 0.001 * (dw * dw - v)
                net.weights[w] = net.weights[w] - rate * 0.95**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """The fold that no label is taken from; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def labels_of(labels: DataFrame, name: str = "quality") -> DataFrame:
    """doc_id, label: one row per doc_id that has a label of 0 or 1 (of several, the larger)."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows (of doc_id, text_key and others), chosen evenly from all by a hash."""
    return common.sampled(rows, most, rows.count(), "doc_id", TEXT_KEY)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each of the SHARES over all rows; zeros without rows."""
    share = lambda i: F.col("shares")[i].cast("double")
    found = rows.agg(*(F.avg(share(i)) for i in range(len(SHARES))), *(F.stddev_pop(share(i)) for i in range(len(SHARES)))).first()
    both = np.array([0.0 if v is None else v for v in found], np.float64)
    return both[: len(SHARES)], both[len(SHARES) :]


def shares_of(rows: DataFrame) -> np.ndarray:
    return np.array([r.shares for r in rows.select("shares").collect()], np.float64).reshape(-1, len(SHARES))


def train(stats: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Network:
    """stats: of text_statistics. Labels of the held-out fold aren't read; neither are its texts."""
    usable = stats.where(~held_out(F.col("doc_id")))
    known = labels_of(labels).where(~held_out(F.col("doc_id")))
    positive = shares_of(sampled(usable.join(known.where("label = 1"), "doc_id"), most_positive))
    unlabelled = shares_of(sampled(usable, most_unlabelled))
    prior = known.agg(F.avg("label")).first()[0]
    return fit(positive, unlabelled, 0.5 if prior is None else prior, moments_of_all=moments(usable))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted of every whole text; nothing but the text enters a score.

    score: 0 to 1, higher where label 1 is likelier; predicted: 1 from THRESHOLD on. Null texts count as empty.
    Without positive labels every score is the prior (0.5 without any labels). Repeated rows score alike. Texts of any
    length are read whole. An empty table gives no rows. Other columns take no part, whatever their names.
    """
    stats = checkpointed(text_statistics(docs))
    net = train(stats, labels)
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of(arrow, [batch.column(0), batch.column(1), pa.array(net.score(matrix(batch)))])

    scored = stats.select("doc_id", TEXT_KEY, "shares").mapInArrow(run, f"doc_id long, {TEXT_KEY} long, score double")
    return scored.select("doc_id", TEXT_KEY, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
