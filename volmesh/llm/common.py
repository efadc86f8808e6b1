"""What the text operators share: checkpoints, columns in and out, batches of rows."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tells apart rows that share a doc_id but not a text.
TEXT_KEY = "text_key"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, in the folder that spark.checkpoint.dir names.

    A temporary folder is used only where none is named and everything runs on one machine (tests); on a cluster that is
    an error, as executors wouldn't share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="volmesh-"))
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint. Shuffle files that nothing refers to any more go now, not whenever the driver happens to
    collect its garbage, so that a long job doesn't hold those of all its steps."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


#: Rows of digests, links or hashes in a partition.
PART_ROWS = 1 << 15


def gathered(df: DataFrame, rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """df, of so many short rows at most, in no more partitions than they fill: such rows are little of their texts, and
    a task, an exchange or a checkpoint for few of them in each of many partitions would be made of tiny blocks."""
    return df.coalesce(max(1, -(-rows // part_rows)))


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose next join is by a shuffle: Spark sizes exploded rows by those that they are made of, also while a query
    runs, and would broadcast many times its threshold through the driver."""
    return df.hint("merge")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch between the JVM and Python, where the session sets none: each side buffers a whole batch.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES, unless it has a size of its own: batches of the default
    size hold 10,000 texts, or 64 MB, on both sides of every running task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string) alone, so that no other column can clash with a result's.

    They go to Python tasks, so batches are bounded here.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``texts`` with TEXT_KEY; null texts are empty."""
    return texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn(TEXT_KEY, F.xxhash64("text"))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batch: pa.RecordBatch, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``max_bytes``, so that Python objects of few long texts exist at a time."""
    rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def sampled(rows: DataFrame, most: int, count: int, *columns: str) -> DataFrame:
    """At most ``most`` of the rows (there are ``count``), chosen evenly from all by a hash of the columns.

    Hashes over a cutoff go before anything is gathered, so what tasks send doesn't grow with the table. The cutoff
    leaves six deviations more than are needed.
    """
    h = F.xxhash64(*columns, F.lit(17))
    share = (most + 6 * most**0.5 + 36) / max(1, count)
    if share < 1:
        rows = rows.where(h < int(share * 2**64) - 2**63)
    return rows.orderBy(h, *columns).limit(most)
