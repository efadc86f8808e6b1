"""Rays through a field: steps, the first iso-crossing, light gathered on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volmesh.common import shuffled


def box_interval(low: tuple, high: tuple) -> tuple[Column, Column]:
    """(near, far) along a ray (ox .. dz) through a box; the ray misses if near > far or far < 0.

    A ray that is parallel to an axis is bounded by the others if its origin lies between the box's sides of that
    axis, and misses otherwise.
    """
    inf = F.lit(float("inf"))
    near, far = [], []
    for a, lo, hi in zip("xyz", low, high, strict=True):
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        t0, t1 = F.try_divide(F.lit(float(lo)) - o, d), F.try_divide(F.lit(float(hi)) - o, d)
        between = (o >= float(lo)) & (o <= float(hi))
        near.append(F.when(d == 0, F.when(between, -inf).otherwise(inf)).otherwise(F.least(t0, t1)))
        far.append(F.when(d == 0, F.when(between, inf).otherwise(-inf)).otherwise(F.greatest(t0, t1)))
    return F.greatest(*near), F.least(*far)


def steps(rays: DataFrame, box: tuple[tuple, tuple], length: float, offset: Column | None = None) -> DataFrame:
    """ray_id, step, x, y, z: places along each ray inside the box, a step's length apart from where the ray enters it
    (or from its origin, if that lies inside). offset: how far along before the first one. Rays that miss give none."""
    near, far = box_interval(*box)
    begin = F.greatest(near, F.lit(0.0)) + (F.lit(0.0) if offset is None else offset)
    hit = rays.withColumns({"begin": begin, "far": far}).where("begin <= far AND far < double('Infinity')")
    last = F.floor((F.col("far") - F.col("begin")) / length).cast("int")
    t = F.col("begin") + F.col("step") * length
    return shuffled(hit.select("*", F.explode(F.sequence(F.lit(0), last)).alias("step"))).select("ray_id", "step", *((F.col(f"o{a}") + t * F.col(f"d{a}")).alias(a) for a in "xyz"))


def first_crossing(samples: DataFrame, iso: float, length: float) -> DataFrame:
    """ray_id, step, direction (1: upwards, -1: downwards), t: where the value first passes the iso-value."""
    along = Window.partitionBy("ray_id").orderBy("step")
    before = F.lag("value").over(along)
    flips = samples.withColumn("before", before).where((F.col("before") > iso) != (F.col("value") > iso))
    first = flips.groupBy("ray_id").agg(F.min(F.struct("step", "before", "value")).alias("m")).select("ray_id", "m.*")
    f1, f2 = F.col("before") - iso, F.col("value") - iso
    x1, x2 = (F.col("step") - 1) * length, F.col("step") * length
    return first.select("ray_id", "step", F.when(F.col("value") > iso, 1).otherwise(-1).alias("direction"), ((x2 * f1 - x1 * f2) / (f1 - f2)).alias("t"))


#: Share of the light under which nothing more is gathered.
LEAST_LIGHT = 0.005


def absorption(opacity: float) -> float:
    return (opacity / 64) ** 4


def gathered(samples: DataFrame, length: float, opacity: float = 32.0) -> DataFrame:
    """ray_id, light, transmittance: values gathered front to back until under 0.005 of the light comes through."""
    along = Window.partitionBy("ray_id").orderBy("step")
    depth = F.col("value") * absorption(opacity) * length
    upto = F.sum(depth).over(along)
    through = samples.withColumn("after", F.pow(F.lit(2.0), -upto)).withColumn("before", F.pow(F.lit(2.0), -(upto - depth)))
    seen = through.where(F.col("before") >= LEAST_LIGHT)
    return seen.groupBy("ray_id").agg(F.sum(F.col("value") * (F.col("before") - F.col("after"))).alias("light"), F.min("after").alias("transmittance"))


def camera_rays(cameras: DataFrame, width: int, height: int) -> DataFrame:
    """camera_id, px, py, ox .. dz: a ray through the middle of each pixel of a camera's image (camera_id, position px0,
    py0, pz0; up ux, uy, uz; right rx, ry, rz; fovx, fovy in radians). Pixels count from the image's left upper corner."""
    up, right = ([F.col(f"{n}{a}") for a in "xyz"] for n in "ur")
    cross = [up[1] * right[2] - up[2] * right[1], up[2] * right[0] - up[0] * right[2], up[0] * right[1] - up[1] * right[0]]

    def unit(v: list[Column]) -> list[Column]:
        n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return [F.try_divide(c, n) for c in v]

    pixel = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("pixel")
    x, y = F.col("pixel") % width, F.floor(F.col("pixel") / width)
    across, down = 2 * (x + 0.5) / width - 1, 2 * (y + 0.5) / height - 1
    tan = F.tan(F.col("fovy") / 2)
    d = unit([f + across * tan * F.col("fovx") / F.col("fovy") * r - down * tan * u for f, r, u in zip(unit(cross), unit(right), unit(up), strict=True)])
    return cameras.select("*", pixel).select("camera_id", x.cast("int").alias("px"), y.cast("int").alias("py"), *(F.col(f"p{a}0").alias(f"o{a}") for a in "xyz"), *(c.alias(f"d{a}") for a, c in zip("xyz", d, strict=True)))
