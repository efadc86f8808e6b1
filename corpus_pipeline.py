"""A corpus pipeline of five stages, each of which takes what its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volmesh.llm import bpe, debruijn, mixing, quality, similar
from volmesh.llm.common import TEXT_KEY, checkpointed, read
from volmesh.llm.queries import tokenizer


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(TEXT_KEY, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _same(*names: str):
    """A condition between l and r that also holds where both sides are null."""
    return reduce(lambda a, b: a & b, (F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like others, long ones whole; repeated rows stay or go together. An empty table gives an
    empty one, and other columns go along whatever their names.
    """
    kept = quality.score(docs, read(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id", TEXT_KEY).distinct()
    return _keyed(docs).alias("l").join(kept.alias("r"), _same("doc_id", TEXT_KEY), "left_semi").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, once: that with the smallest doc_id (of several texts
    under it the one with the least key), or with none if no document of the group has an id.

    Near duplicates share 0.8 of their five-word shingles (Jaccard), or are joined by others that do. Those whose SimHash
    fingerprints differ in at most two bits meet in the grid of segment bit counts; the rest meet in bands, where a few
    pairs near 0.8 are missed (see the README). Texts without words are one group, of those under five words the whole counts as a
    shingle, and long ones are compared whole. An empty table gives an empty one, and other columns go along whatever their
    names.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", TEXT_KEY))
    kept = similar.near_copies(docs).groupBy("component").agg(first.alias("first")).select("first.doc_id", f"first.{TEXT_KEY}")
    joined = _keyed(docs).alias("l").join(kept.alias("r"), _same("doc_id", TEXT_KEY), "left_semi")
    return joined.dropDuplicates(["doc_id", TEXT_KEY]).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document of which no word is left goes.

    Documents without repeated words keep their text as it is, null and empty ones too; of others the kept words are joined
    by spaces. Long texts are read whole; repeated rows, and rows that share a doc_id and a text, are cut alike. An empty
    table gives an empty one, and other columns go along whatever their names.
    """
    rest = checkpointed(debruijn.remove_repeated_words(docs).where("n_removed > 0").select("doc_id", TEXT_KEY, "kept").dropDuplicates(["doc_id", TEXT_KEY]))
    joined = _keyed(docs).alias("l").join(rest.alias("r"), _same("doc_id", TEXT_KEY), "left")
    new = F.coalesce(F.col("r.kept"), F.col("l.text"))
    columns = [new.alias(c) if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"l.`{c}`") for c in docs.columns]
    return joined.where(F.col("r.kept").isNull() | (F.col("r.kept") != "")).select(*columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that rake tokens to the target weights.

    Nulls count as '', texts without words are kept with the probability ``keep``, long ones count whole, and repeated rows
    share their fate. An empty table gives an empty one, and other columns go along whatever their names.
    """
    own = ("doc_id", "text", "lang", "source")
    # Others go under names of their own meanwhile, as mix() replaces columns that are named like its results.
    renamed = {c: c if c in own else f"other_{i}" for i, c in enumerate(docs.columns)}
    mixed = mixing.mix(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items())))
    return mixed.where("mix_kept").select(*(F.col(n).alias(c) for c, n in renamed.items()))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest, and the digest of the bytes that they decode to.

    Null and empty texts have no ids, long ones are encoded whole, repeated rows give repeated rows. An empty table gives an
    empty one; other columns take no part, whatever their names.
    """
    return bpe.round_trip_with_ids(docs, *tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicates_stage),
    ("substring dedup", substring_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level bpe", encoding_stage),
]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written in the checkpoint folder and read again. What a stage
    has read goes once its own result is written; the last one's input stays, as the result reads it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, folder = _reread(spark, docs, i)
            if before:
                _deleted(spark, before)
            before = folder
    return docs


def _reread(spark: SparkSession, docs: DataFrame, number: int) -> tuple[DataFrame, str]:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(spark.range(1))  # sets a folder where none is named
    folder = f"{context.getCheckpointDir()}/pipeline-{number}-{uuid.uuid4().hex}"
    docs.write.parquet(folder)
    return spark.read.parquet(folder), folder


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
