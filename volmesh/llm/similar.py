"""Texts whose sets of word shingles overlap by a share: SimHash in the grid of segment bit counts, exact test.

Texts whose fingerprints differ in at most two bits meet in the grid of ``simhash`` and are tested on their whole sets.
SimHash over five words lies 10 of 64 bits apart on average at Jaccard 0.8, and up to 20, where no grid over segment bit
counts is selective. What the grid leaves apart therefore also meets in bands of least hashes; pairs there whose sizes and
fingerprints allow the similarity are tested in the same way. A bucket's texts (those around a fingerprint value, or of a
band) are first tested against its least one, in joins. Buckets that still hold several components (large groups of
copies that are less alike to each other than 0.8) are then tested whole, in blocks of bounded size: a task counts what
all texts of two blocks share by a matrix product over their shingles, and gives only links that join components. No
pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_KEY, batch_of, checkpointed, column, gathered, keyed_texts, released, shuffled, slices
from .components import components
from .simhash import shared_values, shingle_hashes, votes

WORDS = 5
#: Bands of a signature and least hashes in each: a pair of Jaccard 0.8 misses all bands in 0.04 % of the cases.
BANDS, BAND_HASHES = 20, 5
#: Values that a fingerprint may meet others around: those within one bit of it.
AROUND = 65
#: Fingerprints that differ in more bits aren't tested: at Jaccard 0.8 the mean is 9.7, the deviation 2.9.
RADIUS = 24
#: Texts in a partition of classes, each of which is exploded to its cells and bands.
CLASS_ROWS = 1 << 13
#: Up to so many texts are broadcast by their keys to find their words; beyond, they are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Texts, and shingles in all, that a block of a band has about; numbers in a matrix of texts by shingles.
BLOCK_TEXTS, BLOCK_SHINGLES, MATRIX = 512, 1 << 20, 1 << 22
#: Pairs of one text that share a copy of its set.
PAIRS_A_COPY = 512


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, WORDS))


def shape_of(hashes: np.ndarray) -> int:
    """A set's digest as a signed 64-bit integer; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 1)).astype(np.int64)) if len(hashes) else 0


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    both = rng.integers(0, 2**64, (2, BANDS * BAND_HASHES, 1), np.uint64, endpoint=False)
    return both[0], both[1] | np.uint64(1)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys (signed 64-bit) of a set that isn't empty."""
    turn, factor = _mixers()
    least = np.full(BANDS * BAND_HASHES, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[None, start : start + 1024] ^ turn) * factor).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(least[i * BAND_HASHES : (i + 1) * BAND_HASHES].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, shape, size, fp and bands of every whole text's set."""
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("shape", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def row(text: str) -> tuple:
        found = shingle_set(text)
        fp = int(np.uint64(votes(found)).astype(np.int64))
        return shape_of(found), len(found), fp, bands_of(found) if len(found) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [row(t) for t in column(batch, "text")]
                yield batch_of(arrow, [batch.column(0), batch.column(2), *([r[i] for r in rows] for i in range(4))])

    return keyed_texts(docs).mapInArrow(run, f"doc_id long, {TEXT_KEY} long, shape long, size long, fp long, bands array<long>")


def _row_key() -> Column:
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), TEXT_KEY)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """shape, hashes of the rows whose keys are in wanted (row_key), once each."""
    arrow = pa.schema([("shape", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [shingle_set(t) for t in column(batch, "text")]
                yield batch_of(arrow, [[shape_of(f) for f in found], [f.view(np.int64) for f in found]])

    wanted = checkpointed(wanted)
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = keyed_texts(docs).withColumn("row_key", _row_key()).join(F.broadcast(wanted) if few else wanted, "row_key", "left_semi")
    return checkpointed(rows.select("text").mapInArrow(run, "shape long, hashes array<long>").dropDuplicates(["shape"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b with a Jaccard similarity of 0.8 or more, by their whole sets.

    A text with many pairs has copies of its set dealt over tasks.
    """
    copies = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("long").alias("copies")).where("copies > 1"))
    dealt = pairs.join(copies, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).alias("copy"))
    left = sets.select(F.col("shape").alias("a"), F.col("hashes").alias("x")).join(copies, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)).alias("copy"))
    both = dealt.join(shuffled(sets.select(F.col("shape").alias("b"), F.col("hashes").alias("y"))), "b").join(shuffled(left), ["a", "copy"])
    shared = F.size(F.array_intersect("x", "y"))
    return checkpointed(both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def _may_be(l: str, r: str) -> Column:
    """Whether sizes and fingerprints allow a similarity of 0.8."""
    size = lambda s: F.col(f"{s}size")
    return (5 * F.least(size(l), size(r)) >= 4 * F.greatest(size(l), size(r))) & (F.bit_count(F.col(f"{l}fp").bitwiseXOR(F.col(f"{r}fp"))) <= RADIUS)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share."""
    n, values = len(sets), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = np.repeat(np.arange(n), [len(s) for s in sets])[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    size = np.diff(np.flatnonzero(new), append=len(values))
    several = np.repeat(size > 1, size)
    owner, column_ = owner[several], np.cumsum(new[several]) - 1
    out, width = np.zeros((n, n), np.float64), max(1, MATRIX // n)
    for first in range(0, int(column_[-1]) + 1 if len(column_) else 0, width):
        a, b = np.searchsorted(column_, (first, first + width))
        holds = np.zeros((n, width), np.float32)
        holds[owner[a:b], column_[a:b] - first] = 1
        out += holds @ holds.T
    return out.astype(np.int64)


def joining_links(shapes: np.ndarray, groups: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of shapes with a Jaccard similarity of 0.8 or more that join different groups (a forest of them); of
    texts in two blocks only pairs across these."""
    size = np.array([len(s) for s in sets])
    alike = 9 * shared_counts(sets) >= 4 * (size[:, None] + size[None, :])
    alike &= groups[:, None] < groups[None, :]
    if blocks.min() < blocks.max():
        alike &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(alike)
    _, one = np.unique(np.stack([groups[a], groups[b]], axis=1), axis=0, return_index=True)
    top: dict[int, int] = {}

    def root(g: int) -> int:
        while top.get(g, g) != g:
            g = top[g]
        return g

    out = []
    for i, j in zip(a[one].tolist(), b[one].tolist(), strict=True):
        x, y = root(int(groups[i])), root(int(groups[j]))
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((int(shapes[i]), int(shapes[j])))
    return out


def _links_in_bands(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that join components among the texts (band, shape, size, component) of each band."""
    counts = open_.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    counts = counts.select("band", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    placed = open_.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("shape", F.lit(3)), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("band", "shape", "component", "block", other).select("band", "shape", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def group(table: pa.Table) -> pa.Table:
        shapes, groups, blocks = (table[c].to_numpy() for c in ("shape", "component", "block"))
        links = joining_links(shapes, groups, blocks, [np.asarray(h.values) for h in table["hashes"]]) if table.num_rows > 1 else []
        return pa.table([[x[i] for x in links] for i in range(2)], schema=arrow)

    return shuffled(dealt).join(sets, "shape").groupBy("band", "i", "j").applyInArrow(group, "a long, b long")


def _with_hubs(buckets: DataFrame, most: int) -> DataFrame:
    """Texts (band, shape, size, fp; so many rows at most) of buckets that hold several, with the least text of each."""
    hubs = buckets.groupBy("band").agg(F.min(F.struct("shape", "size", "fp")).alias("h"), F.count("*").alias("n")).where("n > 1")
    found = shuffled(buckets).join(hubs, "band").select("band", "shape", "size", "fp", F.col("h.shape").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.fp").alias("hub_fp"))
    return checkpointed(gathered(found, most))


def _around_values(classes: DataFrame) -> DataFrame:
    """band, shape, size, fp: texts by the values that their fingerprints meet around, or by the one that they share."""
    texts = classes.where("size > 0").select("shape", "size", "fp")
    same = texts.groupBy("fp").agg(F.count("*").alias("n"))
    met = shared_values(same.select("fp")).union(same.where("n > 1").select("fp", F.col("fp").alias("value"))).distinct()
    return texts.join(met, "fp").select(F.xxhash64("value", F.lit("value")).alias("band"), "shape", "size", "fp")


def _to_hubs(near: DataFrame) -> DataFrame:
    return near.where((F.col("shape") != F.col("hub")) & _may_be("", "hub_")).select(F.col("hub").alias("a"), F.col("shape").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, component per row: texts with a Jaccard similarity of 0.8 or more over sets of five-word
    shingles are linked, and a component is what links reach. Texts of fewer words have one shingle of all of them;
    texts without words are alike. Null ids need no care here, as only texts are linked.

    What is linked is compared exactly. Of texts whose fingerprints differ in at most two bits no link is missed. Of others
    not all pairs are looked at: those that share none of BANDS bands (0.04 % of pairs at 0.8, fewer above), or whose
    fingerprints lie over RADIUS bits apart, are missed.
    """
    rows = checkpointed(_sketches(docs))
    n_rows = rows.count()
    classes = checkpointed(gathered(rows.select("shape", "size", "fp", "bands", _row_key().alias("row_key")).dropDuplicates(["shape"]), n_rows, CLASS_ROWS))
    around = released(_with_hubs(_around_values(classes), AROUND * n_rows))
    banded = released(_with_hubs(classes.select("shape", "size", "fp", F.explode("bands").alias("band")).select("band", "shape", "size", "fp"), BANDS * n_rows))
    near = around.union(banded)
    sets = released(_sets(docs, gathered(classes.join(near.select("shape").distinct(), "shape", "left_semi").select("row_key"), n_rows)))
    links = released(_verified(checkpointed(gathered(_to_hubs(around), AROUND * n_rows)), sets))
    parts = checkpointed(components(links))
    # Bands need not test what fingerprints have joined.
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    apart = _to_hubs(banded).join(of("a"), "a", "left").join(of("b"), "b", "left").where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b")
    links = links.union(released(_verified(checkpointed(gathered(apart, BANDS * n_rows)), sets)))
    parts = checkpointed(components(links))
    placed = near.join(parts, F.col("shape") == F.col("node"), "left").withColumn("component", F.coalesce("component", "shape"))
    # All texts of a bucket have been tested against its hub, or are joined with it.
    others = placed.where(F.col("shape") != F.col("hub"))
    mixed = others.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("band")
    open_ = checkpointed(others.join(mixed, "band").select("band", "shape", "size", "component"))
    across = released(checkpointed(_links_in_bands(open_, sets).distinct()))
    if not across.isEmpty():
        parts = checkpointed(components(links.union(across)))
    whole = classes.select("shape").join(parts, F.col("shape") == F.col("node"), "left").select("shape", F.coalesce("component", "shape").alias("component"))
    return rows.join(whole, "shape").select("doc_id", TEXT_KEY, "component")
