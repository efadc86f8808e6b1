"""Column expressions on boxes, tetrahedra and scalars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
LOW, HIGH = ("x0", "y0", "z0"), ("x1", "y1", "z1")


def plane_side(low: Column, high: Column, split: Column) -> Column:
    """Bit 1: something lies at or below the plane; bit 2: something lies above."""
    return F.when(low <= split, 1).otherwise(0).bitwiseOR(F.when(high > split, 2).otherwise(0))


def in_box(point: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a & b, ((p >= lo) & (p <= hi) for p, lo, hi in zip(point, low, high, strict=True)))


def boxes_overlap(a_low: tuple, a_high: tuple, b_low: tuple, b_high: tuple) -> Column:
    return reduce(lambda a, b: a & b, ((al <= bh) & (bl <= ah) for al, ah, bl, bh in zip(a_low, a_high, b_low, b_high, strict=True)))


def box_size(low: tuple[Column, ...], high: tuple[Column, ...]) -> list[Column]:
    return [hi - lo for lo, hi in zip(low, high, strict=True)]


def box_volume(low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    x, y, z = box_size(low, high)
    return x * y * z


def box_surface(low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    x, y, z = box_size(low, high)
    return 2 * (x * y + y * z + z * x)


def minus(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return reduce(lambda p, q: p + q, (p * q for p, q in zip(a, b, strict=True)))


def triple(a: tuple[Column, ...], b: tuple[Column, ...], c: tuple[Column, ...]) -> Column:
    """a . (b x c)"""
    return a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def tet_volume(v0: tuple, v1: tuple, v2: tuple, v3: tuple) -> Column:
    """Six times the signed volume."""
    return triple(minus(v1, v0), minus(v2, v0), minus(v3, v0))


def barycentric(p: tuple, v: list[tuple]) -> list[Column]:
    """The four weights of p; null where the tetrahedron has no volume."""
    whole = tet_volume(*v)
    parts = [tet_volume(*(p if i == j else v[j] for j in range(4))) for i in range(4)]
    return [F.when(whole != 0, part / whole) for part in parts]


def normalised(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))).otherwise(F.lit(0.0))


def colour_ramp(t: Column, stops: list[tuple[float, float, float]]) -> Column:
    """Array of red, green and blue: linear between evenly spaced stops; t from 0 to 1."""
    last = len(stops) - 1
    at = F.least(F.floor(t * last), F.lit(last - 1))
    part = t * last - at

    def channel(c: int) -> Column:
        values = F.array(*(F.lit(float(s[c])) for s in stops))
        low, high = F.element_at(values, (at + 1).cast("int")), F.element_at(values, (at + 2).cast("int"))
        return low + (high - low) * part

    return F.array(*(channel(c) for c in range(3)))


#: Cells in a leaf at which the ramp of leaf counts ends; fixed value.
FULL_LEAF = 128


def leaf_count_ramp(cells: Column, stops: list[tuple[float, float, float]]) -> Column:
    """The colour of a leaf by the number of its cells."""
    return colour_ramp(normalised(cells.cast("double"), F.lit(0.0), F.lit(float(FULL_LEAF))), stops)


def spherical(radius: Column, azimuth: Column, elevation: Column) -> list[Column]:
    return [radius * F.cos(elevation) * F.sin(azimuth), radius * F.sin(elevation), radius * F.cos(elevation) * F.cos(azimuth)]


def polynomial(c: Column, x: Column, y: Column, z: Column) -> Column:
    """a + bx + cy + dz + exy + fxz + gyz + hxyz with the coefficients in an array."""
    terms = (F.lit(1.0), x, y, z, x * y, x * z, y * z, x * y * z)
    return reduce(lambda a, b: a + b, (F.element_at(c, i + 1) * t for i, t in enumerate(terms)))


def hashed_number(*key: Column) -> Column:
    """A number from 0 to 2 ** 32 - 1 that depends on the key alone, in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("long")


def hashed_unit(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return hashed_number(*key) / float(1 << 32)
