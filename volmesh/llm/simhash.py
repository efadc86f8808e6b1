"""Near duplicates by SimHash, with a grid range-join over segment bit counts.

A fingerprint's 64 bits are cut into segments; the vector of the segments' bit counts is a point of a grid.
Flipping a bit moves the point one step along one axis, so the Manhattan distance of two points is a lower
bound for the number of differing bits. Points within two steps meet in a cell within one step of both:
each fingerprint announces itself in its own cell and its neighbours, and only cells where two or more
fingerprints meet go on. There the exact test follows without listing pairs: two fingerprints differ in at
most two bits exactly when some 64-bit value lies within one bit of both, and that value lies in a cell where
they have met. At most 65 fingerprints lie within one bit of a value, so no group there can grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_KEY, batch_of, checkpointed, column, keyed_texts, shuffled, slices
from .components import components

SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4


def votes(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Hashes of all shingles of so many words; of all words if there are fewer; none without words."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hash_of, seed = xxhash.xxh64_intdigest, SEED
    return np.array([hash_of(s, seed) for s in shingles], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash over shingles of so many words; of all words if there are fewer; 0 without words."""
    return votes(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint's 64 bits as a long) of every whole text; null texts are empty."""
    arrow = pa.schema([("doc_id", pa.int64()), (TEXT_KEY, pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = np.array([fingerprint(t, words) for t in column(batch, "text")], np.uint64).view(np.int64)
                yield batch_of(arrow, [batch.column(0), batch.column(2), pa.array(found)])

    return keyed_texts(docs).mapInArrow(run, f"doc_id long, {TEXT_KEY} long, fp long")


def _segment_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(2**SEGMENT_BITS - 1)).cast("long") for i in range(SEGMENTS)]


def _cells(fps: DataFrame) -> DataFrame:
    """fp, axis, step, cell: the cell of fp's point (step 0) and of its neighbours in the grid.

    A count takes 4 bits: the cell's number is the point's place in the grid, not a hash.
    """
    counts = _segment_counts(F.col("fp"))
    point = counts[0]
    for i, c in enumerate(counts[1:], 1):
        point = point.bitwiseOR(F.shiftleft(c, 4 * i))
    steps = [F.struct(F.lit(0).alias("axis"), F.lit(0).alias("step"), F.col("point").alias("cell"))]
    for i in range(SEGMENTS):
        one = F.lit(1 << 4 * i).cast("long")
        count = F.shiftrightunsigned(F.col("point"), 4 * i).bitwiseAND(15)
        steps.append(F.when(count < SEGMENT_BITS, F.struct(F.lit(i).alias("axis"), F.lit(1).alias("step"), (F.col("point") + one).alias("cell"))))
        steps.append(F.when(count > 0, F.struct(F.lit(i).alias("axis"), F.lit(-1).alias("step"), (F.col("point") - one).alias("cell"))))
    return fps.select("fp", point.alias("point")).select("fp", F.explode(F.array_compact(F.array(*steps))).alias("s")).select("fp", "s.axis", "s.step", "s.cell")


def _values(fps: DataFrame) -> DataFrame:
    """fp, value, once each: the values within one bit of distinct fingerprints (fp) that fall in cells where several met."""
    cells = _cells(fps)
    met = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    near = shuffled(cells).join(met, "cell")
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)),
        lambda j: F.when(
            (F.expr("shiftrightunsigned(fp, axis * 4)").bitwiseAND(15).bitwiseAND(F.element_at(F.array(*(F.lit(1 << b) for b in range(4))), j + 1)) == 0) == (F.col("step") == 1),
            j,
        ),
    )
    return near.select(
        "fp",
        F.explode(F.when(F.col("step") == 0, F.array(F.col("fp"))).otherwise(F.transform(F.array_compact(flips), lambda j: F.col("fp").bitwiseXOR(F.element_at(_powers(), F.col("axis") * SEGMENT_BITS + j + 1))))).alias("value"),
    )


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that join all those that differ in at most two bits.

    Fingerprints around a value are linked to the least of them; all of them are within two bits of each other.
    """
    around = _values(fps).groupBy("value").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def shared_values(fps: DataFrame) -> DataFrame:
    """fp, value: values within one bit of several of the distinct fingerprints (fp), by which any two that differ in at
    most two bits meet. At most 65 share a value."""
    around = _values(fps).groupBy("value").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return around.select(F.explode("fps").alias("fp"), "value")


def _powers() -> Column:
    return F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key, fp, component_id, class_size per row: fingerprints that differ in at most two bits are
    linked, and component_id is the smallest doc_id reachable.

    Texts without words share fingerprint 0 and link like any other; a null doc_id is reached but never the
    smallest unless there is no other. class_size counts the rows that have the very fingerprint. Repeated rows are rows of
    their own in one class. Texts of any length are hashed whole; a bit that just half of the hashes have is 0. An empty
    table gives no rows. Other columns take no part, whatever their names.
    """
    rows = checkpointed(fingerprints(docs, words))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size")))
    parts = checkpointed(components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "component"))
    reached = classes.join(parts, "fp").groupBy("component").agg(F.min("least").alias("reached"))
    whole = classes.join(parts.join(reached, "component").select("fp", "reached"), "fp", "left").select("fp", "class_size", F.coalesce("reached", "least").alias("component_id"))
    return rows.join(whole, "fp").select("doc_id", TEXT_KEY, "fp", "component_id", "class_size")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
