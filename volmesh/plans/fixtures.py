"""Meshes and telemetry derived from the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volmesh.operators.structured import grid_points

#: Steps of quantity, discount and tax; order lines for which the grid has one step along x in each of quantity.
QUANTITIES, DISCOUNTS, TAXES, LINES = 50, 11, 9, 60_000
T = TypeVar("T")
METRICS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_known: dict[tuple[str, str, str], object] = {}


def _once(f: Callable[[SparkSession, str], T]) -> Callable[[SparkSession, str], T]:
    """``f`` for a folder is computed once in an application."""

    @functools.wraps(f)
    def found(spark: SparkSession, sf_dir: str) -> T:
        key = spark.sparkContext.applicationId, sf_dir, f.__name__
        if key not in _known:
            _known[key] = f(spark, sf_dir)
        return _known[key]

    return found


@_once
def steps(spark: SparkSession, sf_dir: str) -> int:
    """Steps along x in each step of quantity: more, the more order lines there are."""
    return max(1, table(spark, sf_dir, "lineitem").count() // LINES)


def size(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    return QUANTITIES * steps(spark, sf_dir), DISCOUNTS, TAXES


def box(spark: SparkSession, sf_dir: str) -> tuple[tuple, tuple]:
    return (0.0, 0.0, 0.0), tuple(float(s - 1) for s in size(spark, sf_dir))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x (quantity, and within it the part), y (discount), z (tax), value: how many order lines fall on each voxel."""
    k = steps(spark, sf_dir)
    x = (F.col("l_quantity") - 1).cast("int") * k + F.col("l_partkey") % k
    lines = table(spark, sf_dir, "lineitem").select(x.cast("double").alias("x"), F.round(F.col("l_discount") * 100).cast("int").cast("double").alias("y"), F.round(F.col("l_tax") * 100).cast("int").cast("double").alias("z"))
    counts = lines.groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    return grid_points(spark, size(spark, sf_dir)).join(counts, ["x", "y", "z"], "left").select(*(F.col(a).cast("int").alias(a) for a in "xyz"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))


@_once
def iso_value(spark: SparkSession, sf_dir: str) -> float:
    """Two deviations over the mean of the volume."""
    return volume(spark, sf_dir).agg(F.round(F.avg("value") + 2 * F.stddev_pop("value"), 3)).first()[0]


def point_id(size_: tuple[int, int, int]):
    return (F.col("x") + F.col("y") * size_[0] + F.col("z") * size_[0] * size_[1]).cast("long")


def volume_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).select(point_id(size(spark, sf_dir)).alias("point_id"), F.lit("count").alias("name"), "value")


def lines_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t (line number from 0), point_id, lines, suppliers (different ones) of each voxel that has any."""
    k = steps(spark, sf_dir)
    x = (F.col("l_quantity") - 1).cast("int") * k + F.col("l_partkey") % k
    placed = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("t"), x.alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("z"), "l_suppkey")
    counts = placed.groupBy("t", point_id(size(spark, sf_dir)).alias("point_id")).agg(F.count("*").alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"))
    return counts.select("t", "point_id", F.col("lines").cast("double").alias("lines"), F.col("suppliers").cast("double").alias("suppliers"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, value from the first four numbers of each embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), *(F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "value"))))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame_num, metric, value, seq: a user's events in their order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(order).cast("long").alias("frame_num"), F.col("event_type").alias("metric"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("seq"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probe_id, x, y, z: parts as points of the volume, in quarters of a step."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("probe_id"), ((F.col("p_partkey") * 7) % (4 * (size(spark, sf_dir)[0] - 1)) / 4.0).alias("x"), ((F.col("p_partkey") * 3) % 40 / 4.0).alias("y"), (F.col("p_partkey") % 32 / 4.0).alias("z"))
