"""Readers of raw volumes and binary meshes by byte range: each task seeks to its part of the file.

A path with a scheme (s3://, hdfs:// and so on) is opened by Arrow's file systems; one without has to be readable by every
executor and the driver, as shared folders are. A path may also be a folder of parts (``parts``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volmesh.sources.parts import Bytes

#: First number of a solver's volume-data file; fixed value.
VOLUME_DATA_MAGIC = 305419896
#: Rows that a reader's task yields at a time.
BATCH_ROWS = 1 << 18


def _ranges(spark: SparkSession, n: int, rows_each: int) -> DataFrame:
    parts = max(1, -(-n // rows_each))
    return spark.range(parts, numPartitions=min(parts, 4096)).select((F.col("id") * rows_each).alias("first"), F.least(F.lit(n), (F.col("id") + 1) * rows_each).alias("stop"))


def _read(path: str, dtype: str, count: int, offset: int = 0) -> np.ndarray:
    return np.frombuffer(Bytes(path).read_at(count * np.dtype(dtype).itemsize, offset), dtype)


def _numbers(spark: SparkSession, path: str, dtype: str, offset: int, n: int, width: int, kind: pa.DataType, sql: str, part: int = 0, gap: int = 0) -> DataFrame:
    """row, values (an array of ``width`` numbers) of a table of numbers in a file; after every ``part`` rows ``gap``
    bytes are skipped."""
    item = np.dtype(dtype).itemsize * width
    arrow = pa.schema([("row", pa.int64()), ("values", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = first
                while a < stop:
                    b = min(stop, a + BATCH_ROWS, (a // part + 1) * part if part else stop)
                    numbers = _read(path, dtype, (b - a) * width, offset + a * item + (a // part * gap if part else 0)).astype(kind.to_pandas_dtype())
                    offsets = pa.array(np.arange(0, len(numbers) + 1, width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.ListArray.from_arrays(offsets, pa.array(numbers)).cast(arrow.field(1).type)], schema=arrow)
                    a = b

    return _ranges(spark, n, 1 << 22).mapInArrow(run, f"row long, values array<{sql}>")


def read_raw_volume(spark: SparkSession, path: str, dtype: str, size: tuple[int, int, int], offset: int = 0) -> DataFrame:
    """x, y, z, value of a flat array with x fastest."""
    sx, sy, sz = size
    table = _numbers(spark, path, dtype, offset, sx * sy * sz, 1, pa.float64(), "double")
    return table.select((F.col("row") % sx).cast("int").alias("x"), (F.expr(f"row div {sx}") % sy).cast("int").alias("y"), F.expr(f"row div {sx * sy}").cast("int").alias("z"), F.element_at("values", 1).cast("float").alias("value"))


#: Sections of a mesh file in order: name, numbers a row, element code; the header counts nodes and the elements
#: of each kind. Fixed values.
SECTIONS = (("tri", 3, 5), ("quad", 4, 7), ("tet", 4, 10), ("pent", 5, 12), ("prism", 6, 14), ("hex", 8, 17))


def read_ugrid(spark: SparkSession, path: str, byte_order: str = "<") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, cells, elements): a header of seven counts, nodes as three 32-bit floats, triangles, quads,
    surface ids, then volume elements. Vertices count from 1 in elements and from 0 in cells."""
    nodes, *counts = (int(n) for n in _read(path, f"{byte_order}i4", 7))
    at = 28
    points = _numbers(spark, path, f"{byte_order}f4", at, nodes, 3, pa.float64(), "double").select(F.col("row").alias("point_id"), *(F.element_at("values", i + 1).alias(a) for i, a in enumerate("xyz")))
    at += 12 * nodes
    parts = []
    for i, ((name, width, code), n) in enumerate(zip(SECTIONS, counts, strict=True)):
        if i == 2:
            at += 4 * (counts[0] + counts[1])  # surface ids
        if n:
            parts.append(_numbers(spark, path, f"{byte_order}i4", at, n, width, pa.int64(), "long").select(F.lit(name).alias("section"), F.lit(code).alias("elem_type"), F.col("row").alias("elem_id"), F.col("values").alias("verts")))
        at += 4 * width * n
    elements = parts[0] if parts else spark.createDataFrame([], "section string, elem_type int, elem_id long, verts array<long>")
    for p in parts[1:]:
        elements = elements.union(p)
    from volmesh.operators.mesh import tetrahedra

    return points, tetrahedra(elements), elements


def read_volume_data(spark: SparkSession, path: str, names: list[str], byte_order: str = "<", t_index: int | None = None) -> DataFrame:
    """t, point_id, name, value of a file of magic, version, variables and nodes (32-bit integers), then time steps
    of one integer and the nodes' variables side by side as 32-bit floats. t_index: the only step that is read."""
    magic, _, variables, nodes = (int(n) for n in _read(path, f"{byte_order}i4", 4))
    if magic != VOLUME_DATA_MAGIC:
        raise ValueError(f"{path} doesn't begin with {VOLUME_DATA_MAGIC}")
    step = 4 + 4 * variables * nodes
    steps = (Bytes(path).size - 16) // step
    if t_index is not None and not 0 <= t_index < steps:
        raise ValueError(f"{path} has {steps} time steps, not {t_index}")
    first, n = (0, steps) if t_index is None else (t_index, 1)
    table = _numbers(spark, path, f"{byte_order}f4", 20 + first * step, n * nodes, variables, pa.float64(), "double", nodes, 4)
    t = (F.expr(f"row div {max(1, nodes)}") + first).cast("int")
    return table.select(t.alias("t"), (F.col("row") % max(1, nodes)).alias("point_id"), F.posexplode("values").alias("i", "value")).select("t", "point_id", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("name"), "value")
