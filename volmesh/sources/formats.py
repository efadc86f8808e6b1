"""Raw volumes and binary meshes as Spark data sources: spark.read.format(...) with filters that reach the bytes.

| format | options | columns |
|-|-|-|
| volmesh_raw | path, dtype, size (as 50,11,9), offset | x, y, z int, value float |
| volmesh_ugrid | path, table (points or elements), byte_order | point_id, x, y, z or section, elem_type, elem_id, verts |
| volmesh_data | path, names (comma-joined), byte_order | t, point_id, name, value |

``register`` makes them known to a session, ``load`` does so and reads one. With the option pushdown, in sessions where
spark.sql.python.filterPushdown.enabled is true (``load`` looks), comparisons of the whole-numbered columns with constants,
and of name and section with strings, narrow the byte ranges that tasks read; the options <column>_from and <column>_to
(both included) do so in any session. A schema that the reader is given prunes columns: the others aren't built. A path may
be a file or a folder of parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from volmesh.sources.binary import SECTIONS, VOLUME_DATA_MAGIC
from volmesh.sources.parts import BLOCK_ROWS, Bytes, blocks_of, empty_blocks, pieces_of, write_parts

#: Rows of a task, and rows that it yields at a time.
TASK_ROWS, BATCH_ROWS = 1 << 22, 1 << 18


@dataclass
class Rows(InputPartition):
    """Rows first to stop (not included) of a section of the file."""

    section: int
    first: int
    stop: int


class RangeReader(DataSourceReader):
    """Holds what filters leave of the columns: ranges of whole numbers, and sets of strings."""

    def __init__(self, schema: StructType, options: dict[str, str], ranges: dict[str, tuple[int, int]], choices: dict[str, tuple[str, ...]]) -> None:
        self.arrow = to_arrow_schema(schema)
        self.ranges, self.choices = {}, {k: list(v) for k, v in choices.items()}
        for name, (low, high) in ranges.items():
            self.ranges[name] = [max(low, int(options.get(f"{name}_from", low))), min(high, int(options.get(f"{name}_to", high)))]

    def cut(self, section: int, first: int, stop: int) -> list[Rows]:
        return [Rows(section, a, min(stop, a + TASK_ROWS)) for a in range(first, stop, TASK_ROWS)]

    def partitions(self) -> list[Rows]:
        # Spark takes no partitions at all for a single one without a range, so nothing is read by one that is empty.
        return self.parts() or [Rows(-1, 0, 0)]

    def parts(self) -> list[Rows]:
        raise NotImplementedError

    def batch(self, columns: dict[str, Callable[[], object]]) -> pa.RecordBatch:
        """The schema's columns of those given by functions that build them."""
        arrays = []
        for field in self.arrow:
            got = columns[field.name]()
            arrays.append((got if isinstance(got, pa.Array) else pa.array(got)).cast(field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.arrow)


class Pushed:
    """Takes filters over into a reader's ranges and choices. Spark refuses readers that do so in a session in which
    filters aren't pushed, so the readers without it are there too."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if not (name in self.ranges and self._narrowed(self.ranges[name], f)) and not (name in self.choices and self._chosen(name, f)):
                yield f

    @staticmethod
    def _narrowed(kept: list[int], f: Filter) -> bool:
        """Whether the filter is settled by the range; one for a list of numbers narrows it, and Spark does the rest."""
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In):
            values = [v for v in f.value if v is not None]
            kept[:] = [max(kept[0], math.ceil(min(values))), min(kept[1], math.floor(max(values)))] if values else [0, -1]
            return False
        value = getattr(f, "value", None)
        if isinstance(value, bool) or not isinstance(value, int):
            return False
        low, high = {EqualTo: (value, value), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (None, value - 1), LessThanOrEqual: (None, value)}.get(type(f), (None, None))
        if low is not None:
            kept[0] = max(kept[0], low)
        if high is not None:
            kept[1] = min(kept[1], high)
        return low is not None or high is not None

    def _chosen(self, name: str, f: Filter) -> bool:
        if isinstance(f, IsNotNull):
            return True
        if not isinstance(f, (EqualTo, In)):
            return False
        wanted = (f.value,) if isinstance(f, EqualTo) else f.value
        self.choices[name] = [v for v in self.choices[name] if v in wanted]
        return True


class RawReader(RangeReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.dtype, self.offset = options["path"], options.get("dtype", "<f4"), int(options.get("offset", 0))
        self.size = tuple(int(n) for n in options["size"].split(","))
        super().__init__(schema, options, {a: (0, n - 1) for a, n in zip("xyz", self.size, strict=True)}, {})

    def parts(self) -> list[Rows]:
        slab = self.size[0] * self.size[1]
        z0, z1 = self.ranges["z"]
        return self.cut(0, z0 * slab, (z1 + 1) * slab) if all(low <= high for low, high in self.ranges.values()) else []

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        (sx, sy, _), item = self.size, np.dtype(self.dtype).itemsize
        (x0, x1), (y0, y1) = self.ranges["x"], self.ranges["y"]
        source = Bytes(self.path) if partition.first < partition.stop else None
        for first, stop in self._runs(partition, sx, sy, y0, y1):
            for a in range(first, stop, BATCH_ROWS):
                b = min(stop, a + BATCH_ROWS)
                row = np.arange(a, b)
                value = np.frombuffer(source.read_at((b - a) * item, self.offset + a * item), self.dtype)
                if len(value) != b - a:
                    raise ValueError(f"{self.path} ends before voxel {b - 1}")
                if (x0, x1) != (0, sx - 1):
                    held = (row % sx >= x0) & (row % sx <= x1)
                    row, value = row[held], value[held]
                yield self.batch({"x": lambda r=row: r % sx, "y": lambda r=row: r // sx % sy, "z": lambda r=row: r // (sx * sy), "value": lambda v=value: v.astype(np.float32)})

    @staticmethod
    def _runs(partition: Rows, sx: int, sy: int, y0: int, y1: int) -> Iterator[tuple[int, int]]:
        """Ranges of voxels that the filter on y leaves: parts of each slab."""
        if (y0, y1) == (0, sy - 1):
            yield partition.first, partition.stop
            return
        slab = sx * sy
        for z in range(partition.first // slab, -(-partition.stop // slab)):
            a, b = max(partition.first, z * slab + y0 * sx), min(partition.stop, z * slab + (y1 + 1) * sx)
            if a < b:
                yield a, b


class UgridReader(RangeReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.table, self.order = options["path"], options.get("table", "points"), options.get("byte_order", "<")
        counts = [int(n) for n in np.frombuffer(Bytes(self.path).read_at(28, 0), f"{self.order}i4")]
        self.nodes, at = counts[0], 28 + 12 * counts[0]
        self.sections = []  # name, numbers a row, code, rows, byte
        for i, ((name, width, code), n) in enumerate(zip(SECTIONS, counts[1:], strict=True)):
            at += 4 * (counts[1] + counts[2]) if i == 2 else 0  # surface ids
            self.sections.append((name, width, code, n, at))
            at += 4 * width * n
        if self.table == "points":
            super().__init__(schema, options, {"point_id": (0, self.nodes - 1)}, {})
        else:
            super().__init__(schema, options, {"elem_id": (0, max(counts[1:]) - 1)}, {"section": tuple(s[0] for s in SECTIONS)})

    def parts(self) -> list[Rows]:
        if self.table == "points":
            low, high = self.ranges["point_id"]
            return self.cut(0, low, high + 1)
        low, high = self.ranges["elem_id"]
        return [r for i, s in enumerate(self.sections) if s[0] in self.choices["section"] for r in self.cut(i, low, min(high + 1, s[3]))]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        name, width, code, _, base = ("", 3, 0, 0, 28) if self.table == "points" else self.sections[partition.section]
        source = Bytes(self.path) if partition.first < partition.stop else None
        for a in range(partition.first, partition.stop, BATCH_ROWS):
            n = min(partition.stop, a + BATCH_ROWS) - a
            dtype = f"{self.order}{'f4' if self.table == 'points' else 'i4'}"
            numbers = np.frombuffer(source.read_at(4 * width * n, base + 4 * width * a), dtype).reshape(n, width)
            ids = np.arange(a, a + n)
            if self.table == "points":
                yield self.batch({"point_id": lambda v=ids: v, **{c: lambda v=numbers, i=i: v[:, i].astype(np.float64) for i, c in enumerate("xyz")}})
            else:
                verts = lambda v=numbers, n=n: pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(v.astype(np.int64).ravel()))
                yield self.batch({"section": lambda n=n: [name] * n, "elem_type": lambda n=n: np.full(n, code), "elem_id": lambda v=ids: v, "verts": verts})


class VolumeDataReader(RangeReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.order = options["path"], options.get("byte_order", "<")
        self.names = [n.strip() for n in options["names"].split(",")]
        source = Bytes(self.path)
        magic, _, variables, self.nodes = (int(n) for n in np.frombuffer(source.read_at(16, 0), f"{self.order}i4"))
        if magic != VOLUME_DATA_MAGIC:
            raise ValueError(f"{self.path} doesn't begin with {VOLUME_DATA_MAGIC}")
        if variables != len(self.names):
            raise ValueError(f"{self.path} has {variables} variables, not {len(self.names)}")
        self.step = 4 + 4 * variables * self.nodes
        super().__init__(schema, options, {"t": (0, (source.size - 16) // self.step - 1), "point_id": (0, self.nodes - 1)}, {"name": tuple(self.names)})

    def parts(self) -> list[Rows]:
        (t0, t1), (low, high) = self.ranges["t"], self.ranges["point_id"]
        return [r for t in range(t0, t1 + 1) for r in self.cut(t, low, high + 1)] if self.choices["name"] else []

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        t, width = partition.section, len(self.names)
        source = Bytes(self.path) if partition.first < partition.stop else None
        for a in range(partition.first, partition.stop, BATCH_ROWS):
            n = min(partition.stop, a + BATCH_ROWS) - a
            numbers = np.frombuffer(source.read_at(4 * width * n, 20 + t * self.step + 4 * width * a), f"{self.order}f4").reshape(n, width)
            for i, name in enumerate(self.names):
                if name in self.choices["name"]:
                    yield self.batch({"t": lambda n=n: np.full(n, t), "point_id": lambda a=a, n=n: np.arange(a, a + n), "name": lambda name=name, n=n: [name] * n, "value": lambda i=i, v=numbers: v[:, i].astype(np.float64)})


class PushedRawReader(Pushed, RawReader):
    pass


class PushedUgridReader(Pushed, UgridReader):
    pass


class PushedVolumeDataReader(Pushed, VolumeDataReader):
    pass


def _pushed(options: dict[str, str]) -> bool:
    return options.get("pushdown", "false").lower() == "true"


class RawVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volmesh_raw"

    def schema(self) -> str:
        return "x int, y int, z int, value float"

    def reader(self, schema: StructType) -> RawReader:
        return (PushedRawReader if _pushed(self.options) else RawReader)(schema, self.options)


class Ugrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volmesh_ugrid"

    def schema(self) -> str:
        return "point_id long, x double, y double, z double" if self.options.get("table", "points") == "points" else "section string, elem_type int, elem_id long, verts array<long>"

    def reader(self, schema: StructType) -> UgridReader:
        return (PushedUgridReader if _pushed(self.options) else UgridReader)(schema, self.options)


class VolumeData(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volmesh_data"

    def schema(self) -> str:
        return "t int, point_id long, name string, value double"

    def reader(self, schema: StructType) -> VolumeDataReader:
        return (PushedVolumeDataReader if _pushed(self.options) else VolumeDataReader)(schema, self.options)


def register(spark: SparkSession) -> None:
    for source in (RawVolume, Ugrid, VolumeData):
        spark.dataSource.register(source)


def load(spark: SparkSession, name: str, path: str, schema: str | None = None, **options: object) -> DataFrame:
    """A format's rows; filters are pushed if the session does so."""
    register(spark)
    reader = spark.read.format(name).options(pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def _header(spark: SparkSession, dtype: str, numbers: list[int]) -> DataFrame:
    return spark.createDataFrame([(0, bytearray(np.array(numbers, dtype).tobytes()))], "at long, piece binary")


def write_raw_volume(volume: DataFrame, path: str, size: tuple[int, int, int], dtype: str = "<f4") -> None:
    """volume (x, y, z, value) as a flat array with x fastest, in parts.

    Voxels without a row and null values are zero; rows outside the size or with a null place are left out; of rows for
    one voxel the largest value stays.
    """
    sx, sy, sz = size
    inside = " AND ".join(f"{a} >= 0 AND {a} < {n}" for a, n in zip("xyz", size, strict=True))
    row = F.col("x") + sx * (F.col("y") + sy * F.col("z").cast("long"))
    rows = volume.where(inside).select(row.cast("long").alias("row"), F.array("value").alias("numbers"))
    n = sx * sy * sz
    write_parts(pieces_of(blocks_of(rows, n, 1, dtype).union(empty_blocks(volume.sparkSession, n, 1, dtype)), dtype), path)


def write_ugrid(points: DataFrame, cells: DataFrame, path: str, byte_order: str = "<") -> None:
    """points (point_id, x, y, z) and tetrahedra (cell_id, v0 .. v3) as a mesh file in parts.

    Both ids have to count from 0; an id that is missing leaves zeros, and rows with a null id are left out.
    """
    spark = points.sparkSession
    n, m = ((df.agg(F.max(i)).first()[0] or 0) + (0 if df.isEmpty() else 1) for df, i in ((points, "point_id"), (cells, "cell_id")))
    real, whole, at = f"{byte_order}f4", f"{byte_order}i4", 28 + 12 * n
    nodes = blocks_of(points.select(F.col("point_id").alias("row"), F.array("x", "y", "z").alias("numbers")), n, 3, real, 28)
    tets = blocks_of(cells.select(F.col("cell_id").alias("row"), F.array(*(F.col(f"v{i}") + 1 for i in range(4))).alias("numbers")), m, 4, whole, at)
    both = pieces_of(nodes.union(empty_blocks(spark, n, 3, real, 28)), real).union(pieces_of(tets.union(empty_blocks(spark, m, 4, whole, at)), whole))
    write_parts(_header(spark, whole, [n, 0, 0, m, 0, 0, 0]).union(both), path)


def write_volume_data(values: DataFrame, path: str, names: list[str], nodes: int, steps: int, byte_order: str = "<") -> None:
    """values (t, point_id, name, value) as a volume-data file in parts: time steps 0 to steps - 1 of so many nodes.

    Values without a row and null values are zero; rows of other names, steps or nodes are left out; of rows for one
    place the largest value stays.
    """
    spark, width, real, whole = values.sparkSession, len(names), f"{byte_order}f4", f"{byte_order}i4"
    step = 4 + 4 * width * nodes
    base = 20 + F.col("t").cast("long") * step
    index = F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1
    known = values.where((F.col("t") >= 0) & (F.col("t") < steps) & F.col("name").isin(names)).select("t", "name", F.col("point_id").alias("row"), F.array("value").alias("numbers"))
    held = blocks_of(known, nodes, width, real, base, index)
    every = spark.range(steps).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-nodes // BLOCK_ROWS) - 1)))).alias("b")).select("t", (F.col("b").cast("long") * BLOCK_ROWS).alias("row"), F.array().cast("array<double>").alias("numbers"))
    times = spark.range(steps).select((16 + F.col("id") * step).alias("at"), F.lit(1).alias("slots"), F.lit(0).alias("slot"), F.array(F.col("id").cast("double")).alias("numbers"))
    both = pieces_of(held.union(blocks_of(every, nodes, width, real, base)), real).union(pieces_of(times, whole))
    write_parts(_header(spark, whole, [VOLUME_DATA_MAGIC, 1, width, nodes]).union(both), path)
