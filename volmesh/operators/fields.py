"""Derived fields of a flow: each is a formula over its inputs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volmesh.operators.structured import difference


@dataclass(frozen=True)
class Derived:
    """A field that ``inputs`` give; derivatives are named d<input>_d<axis>."""

    name: str
    inputs: tuple[str, ...]
    derivatives: tuple[tuple[str, str], ...]
    formula: object


def _d(field: str, axis: str) -> Column:
    return F.col(f"d{field}_d{axis}")


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (p * p for p in parts)))


def registry(vector: tuple[str, str, str] = ("vx", "vy", "vz"), scalar: str = "value", sound: str = "sound2") -> dict[str, Derived]:
    x, y, z = vector
    all_nine = tuple((v, a) for v in vector for a in "xyz")
    v = [F.col(c) for c in vector]
    out = (
        Derived("magnitude", vector, (), _length(v)),
        Derived("gradient_magnitude", (scalar,), tuple((scalar, a) for a in "xyz"), _length([_d(scalar, a) for a in "xyz"])),
        Derived("mach", (*vector, sound), (), F.sqrt(F.try_divide(reduce(lambda a, b: a + b, (c * c for c in v)), F.col(sound)))),
        Derived("divergence", vector, ((x, "x"), (y, "y"), (z, "z")), _d(x, "x") + _d(y, "y") + _d(z, "z")),
        Derived("vorticity", vector, all_nine, _length([_d(z, "y") - _d(y, "z"), _d(x, "z") - _d(z, "x"), _d(y, "x") - _d(x, "y")])),
        Derived("q_criterion", vector, all_nine, (_d(x, "x") * _d(y, "y") + _d(x, "x") * _d(z, "z") + _d(y, "y") * _d(z, "z")) - (_d(x, "y") * _d(y, "x") + _d(x, "z") * _d(z, "x") + _d(y, "z") * _d(z, "y"))),
    )
    return {d.name: d for d in out}


def possible(available: list[str], known: dict[str, Derived] | None = None) -> list[str]:
    """Fields whose inputs all exist."""
    return [n for n, d in (known or registry()).items() if set(d.inputs) <= set(available)]


def derive(grid: DataFrame, names: list[str], known: dict[str, Derived] | None = None) -> DataFrame:
    """A wide grid (x, y, z and fields) with the named fields. Shared derivatives are computed once, and all of an axis in
    one pass over the rows along it."""
    known = known or registry()
    needed = dict.fromkeys(d for n in names for d in known[n].derivatives)
    for axis in "xyz":
        grid = grid.withColumns({f"d{field}_d{a}": difference(F.col(field).cast("double"), axis) for field, a in needed if a == axis})
    return grid.withColumns({n: known[n].formula for n in names}).drop(*(f"d{f}_d{a}" for f, a in needed))


def limits(grid: DataFrame, names: list[str]) -> DataFrame:
    """name, lo, hi of the named columns of a wide grid."""
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("f")
    return grid.select(long).select("f.*").groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
