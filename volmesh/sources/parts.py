"""Binary files that tasks write in parts, side by side, and that readers take as one file.

A folder's listing names its parts by the byte that each starts at. Tasks give their parts names of their own and only
the listing, written once all are there, makes them count: tasks that are lost or run twice leave nothing in the file.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LISTING = "_parts.json"
#: Bytes after which a task begins a new part, and rows of a table of numbers that one task puts together at a time.
PART_BYTES, BLOCK_ROWS = 256 << 20, 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and its name there. A path without a scheme is one that driver and executors share."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listing(system: fs.FileSystem, folder: str) -> list[tuple[int, int, str]]:
    """Start, bytes and name of a folder's parts in order."""
    with system.open_input_file(f"{folder}/{LISTING}") as f:
        return [tuple(p) for p in json.loads(f.read())]


class Bytes:
    """Byte ranges of a file or of a folder of parts."""

    def __init__(self, path: str) -> None:
        self.system, name = located(path)
        info = self.system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        parts = [(s, n, f"{name}/{p}") for s, n, p in _listing(self.system, name)] if info.type == fs.FileType.Directory else [(0, info.size, name)]
        self.parts, self.starts = parts, [p[0] for p in parts]
        self.size = parts[-1][0] + parts[-1][1] if parts else 0

    def read_at(self, count: int, offset: int) -> bytes:
        """As many bytes from there on; fewer at the end."""
        pieces, stop = [], min(self.size, offset + count)
        while offset < stop:
            start, length, name = self.parts[bisect_right(self.starts, offset) - 1]
            n = min(stop, start + length) - offset
            with self.system.open_input_file(name) as f:
                pieces.append(f.read_at(n, offset - start))
            offset += n
        return pieces[0] if len(pieces) == 1 else b"".join(pieces)


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[int, int, str]]


class PartsWriter(DataSourceArrowWriter):
    """Writes at (long), piece (binary): the bytes of a file from there on. Each task's rows ascend by ``at``."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        done, out, start, end, name = [], None, 0, 0, ""
        try:
            for batch in iterator:
                for at, piece in zip(batch.column("at").to_pylist(), batch.column("piece"), strict=True):
                    if out is None or at != end or end - start >= PART_BYTES:
                        if out is not None:
                            out.close()
                            done.append((start, end - start, name))
                        start = end = at
                        name = f"part-{at:020d}-{uuid.uuid4().hex}"
                        out = system.open_output_stream(f"{folder}/{name}")
                    content = piece.as_buffer()
                    out.write(content)
                    end += content.size
        finally:
            if out is not None:
                out.close()
        return Written([*done, (start, end - start, name)] if out is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        parts = sorted(p for m in messages if m is not None for p in m.parts if p[1])
        for before, part in zip([(0, 0, ""), *parts], parts, strict=False):
            if before[0] + before[1] != part[0]:
                raise ValueError(f"{self.path}: bytes from {before[0] + before[1]} to {part[0]} are missing or there twice")
        system.create_dir(folder, recursive=True)
        old = _listing(system, folder) if system.get_file_info(f"{folder}/{LISTING}").type == fs.FileType.File else []
        if old and not self.overwrite:
            raise ValueError(f"{self.path} is there already")
        draft = f"{folder}/{LISTING}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps(parts).encode())
        system.move(draft, f"{folder}/{LISTING}")
        for _, _, name in old:
            system.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        for _, _, name in (p for m in messages if m is not None for p in m.parts):
            system.delete_file(f"{folder}/{name}")


class PartsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volmesh_parts"

    def schema(self) -> str:
        return "at long, piece binary"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], overwrite)


def blocks_of(rows: DataFrame, n: int, width: int, dtype: str, base: Column | int = 0, first: Column | int = 0) -> DataFrame:
    """at, slots, slot, numbers of rows (row, numbers) of a table of n rows and ``width`` numbers each: the byte at which
    a row's block starts, how many numbers the block has and where in it the row's begin (from the row's number ``first``
    on). base: the byte at which the table starts."""
    block, item = F.expr(f"row div {BLOCK_ROWS}"), np.dtype(dtype).itemsize
    at = base + block * (BLOCK_ROWS * width * item)
    slots = F.least(F.lit(BLOCK_ROWS), n - block * BLOCK_ROWS) * width
    return rows.where((F.col("row") >= 0) & (F.col("row") < n)).select(at.cast("long").alias("at"), slots.cast("int").alias("slots"), ((F.col("row") % BLOCK_ROWS) * width + first).cast("int").alias("slot"), F.transform("numbers", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("numbers"))


def empty_blocks(spark: SparkSession, n: int, width: int, dtype: str, base: int = 0) -> DataFrame:
    """Of ``blocks_of``: each block of the table once, without numbers, so that rows which are missing count as zeros."""
    starts = spark.range(-(-n // BLOCK_ROWS)).select((F.col("id") * BLOCK_ROWS).alias("row"), F.array().cast("array<double>").alias("numbers"))
    return blocks_of(starts, n, width, dtype, base)


def pieces_of(blocks: DataFrame, dtype: str) -> DataFrame:
    """at, piece: the bytes of each block. A task holds one block at a time; of numbers for one place the largest stays."""
    schema = pa.schema([("at", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            ats, slots, slot = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            edges = np.flatnonzero(np.r_[True, ats[1:] != ats[:-1]]) if len(ats) else []
            for a, b in zip(edges, [*edges[1:], len(ats)], strict=True):
                if ats[a] != at:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block.tobytes()], pa.binary())], schema=schema)
                    at, block = int(ats[a]), np.zeros(slots[a], dtype)
                part = lists.slice(a, b - a)
                lengths = part.value_lengths().to_numpy()
                within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                block[np.repeat(slot[a:b], lengths) + within] = part.flatten().to_numpy()
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block.tobytes()], pa.binary())], schema=schema)

    return blocks.repartitionByRange("at").sortWithinPartitions("at", "slot", "numbers").mapInArrow(run, "at long, piece binary")


def write_parts(pieces: DataFrame, path: str) -> None:
    """Writes (at, piece), in order of ``at`` within partitions, as one file in parts; replaces what was there."""
    pieces.sparkSession.dataSource.register(PartsSource)
    pieces.write.format("volmesh_parts").mode("overwrite").save(path)
