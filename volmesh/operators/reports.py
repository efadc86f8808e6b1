"""Reports over blocks, jobs and frame telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volmesh.functions.geometry import spherical

#: Newest frames that are kept, and metrics of a frame; fixed values.
RING = 2000


def overview(sizes: DataFrame, n_points: int, n_cells: int, target: int) -> DataFrame:
    return sizes.agg(F.sum("verts").alias("block_verts"), F.sum("cells").alias("block_cells"), F.count("*").alias("leaves")).select("*", F.lit(n_points).alias("verts"), F.lit(n_cells).alias("cells"), F.lit(target).alias("target"))


def duplicates(leaf_cells: DataFrame, block_points: DataFrame) -> DataFrame:
    """copies, verts, cells: how many of each occur in so many further leaves (0: in one only)."""
    times = lambda df, key, name: df.groupBy(key).agg((F.count("*") - 1).alias("copies")).groupBy("copies").agg(F.count("*").alias(name))
    both = times(block_points, "point_id", "verts").join(times(leaf_cells, "cell_id", "cells"), "copies", "full")
    return both.select("copies", F.coalesce("verts", F.lit(0)).alias("verts"), F.coalesce("cells", F.lit(0)).alias("cells"))


def buffer_sizes(sizes: DataFrame) -> DataFrame:
    """kind, used, padded: values of all blocks' buffers, and with every block as large as the largest."""
    t = sizes.agg(F.sum("verts").alias("v"), F.sum("cells").alias("c"), F.max("verts").alias("mv"), F.max("cells").alias("mc"), F.count("*").alias("n"))
    rows = [("positions", 3 * F.col("v"), 3 * F.col("mv") * F.col("n")), ("values", F.col("v"), F.col("mv") * F.col("n")), ("offsets", F.col("c"), F.col("mc") * F.col("n")), ("connectivity", 4 * F.col("c"), 4 * F.col("mc") * F.col("n"))]
    return t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), u.alias("used"), p.alias("padded")) for k, u, p in rows))).alias("r")).select("r.*")


def expanded_jobs(jobs: DataFrame, keys: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """One row per combination of the array columns ``keys``; rows with ignore go; name joins all values by _."""
    if "ignore" in jobs.columns:
        jobs = jobs.where("NOT coalesce(ignore, false)").drop("ignore")
    for key, value in (defaults or {}).items():
        jobs = jobs.withColumn(key, F.coalesce(key, F.array(F.lit(value))))
    for key in keys:
        jobs = jobs.withColumn(key, F.explode(key))
    return jobs.withColumn("name", F.concat_ws("_", "name", *(F.col(k).cast("string") for k in keys)))


def frame_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """run_id, frame_num and a column per metric: of several writes the last (by seq); the newest frames only."""
    newest = metrics.groupBy("run_id").agg(F.max("frame_num").alias("newest"))
    kept = metrics.join(newest, "run_id").where(F.col("frame_num") > F.col("newest") - RING)
    return kept.groupBy("run_id", "frame_num").agg(*(F.max_by(F.when(F.col("metric") == n, F.col("value")), F.when(F.col("metric") == n, F.col("seq"))).alias(n) for n in names))


def camera_at(times: DataFrame, segments: DataFrame) -> DataFrame:
    """t, x, y, z: cameras move evenly from segment start to stop (t0, t1, r0, r1, az0, az1, el0, el1). A time that several
    segments hold gives a row for each, one that none holds none.

    Segments and times meet in buckets of time. A segment's buckets are as long as the next power of two over its own
    length, so it lies in two at most; times are looked up in the buckets of every length that occurs.
    """
    own = segments.where("t1 > t0").withColumn("level", F.ceil(F.log2(F.col("t1") - F.col("t0"))).cast("int"))
    levels = [r.level for r in own.select("level").distinct().collect()]  # exponents of lengths
    width = lambda: F.pow(F.lit(2.0), F.col("level"))
    buckets = own.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t0") / width()), F.floor(F.col("t1") / width()))))
    asked = times.select("t", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")).withColumn("bucket", F.floor(F.col("t") / width()))
    found = asked.join(buckets, ["level", "bucket"]).where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")))
    part = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    now = lambda n: F.col(f"{n}0") + (F.col(f"{n}1") - F.col(f"{n}0")) * part
    return found.select("t", *(c.alias(a) for a, c in zip("xyz", spherical(now("r"), now("az"), now("el")), strict=True)))
