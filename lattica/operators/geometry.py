"""Lattice geometry: mirrors, tiles, crops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.flow import AXES, CHANNELS
from lattica.schemas import Shape


def number(shape: Shape):
    return (F.col("z").cast("long") * shape.y + F.col("y")) * shape.x + F.col("x")


def mirror(lattice: DataFrame, shape: Shape, axis: int) -> DataFrame:
    """Reflect along an axis.  A face keeps its two cells: the mirrored cell's negative face is the
    other side's, found at the neighbour beyond; the border plane has none and gets 0."""
    name, channel, stride = AXES[axis], CHANNELS[axis], shape.strides[axis]
    extent = (shape.z, shape.y, shape.x)[axis]
    beyond = lattice.select((F.col("vox") - stride).alias("vox"), F.col(channel).alias("_next")).where(F.col("vox") >= 0)
    moved = lattice.join(beyond, "vox", "left")
    face = F.when(F.col(name) == extent - 1, 0).otherwise(F.col("_next"))
    out = moved.withColumn(channel, face.cast("int")).withColumn(name, (extent - 1 - F.col(name)).cast("int"))
    return out.select(number(shape).alias("vox"), "z", "y", "x", *CHANNELS)


def tile(lattice: DataFrame, shape: Shape, factors: tuple[int, int, int]) -> tuple[DataFrame, Shape]:
    """A lattice of mirrored tiles; odd tiles are reflected.  Each of at most eight reflections is made once."""
    big = Shape(shape.z * factors[0], shape.y * factors[1], shape.x * factors[2])
    parts = []
    for flips in sorted({tuple(i % 2 for i in (a, b, c)) for a in range(factors[0]) for b in range(factors[1]) for c in range(factors[2])}):
        own = lattice
        for axis in range(3):
            if flips[axis]:
                own = mirror(own, shape, axis)
        places = [[i for i in range(n) if i % 2 == f] for n, f in zip(factors, flips)]
        shifts = [F.explode(F.array(*(F.lit(i) for i in p))) for p in places]
        own = own.withColumn("_z", shifts[0]).withColumn("_y", shifts[1]).withColumn("_x", shifts[2])
        own = own.withColumns({"z": F.col("z") + F.col("_z") * shape.z, "y": F.col("y") + F.col("_y") * shape.y, "x": F.col("x") + F.col("_x") * shape.x})
        parts.append(own.select(number(big).alias("vox"), "z", "y", "x", *CHANNELS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, big


def crop(lattice: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> tuple[DataFrame, Shape]:
    """Cells low <= (z, y, x) < high, moved to the origin."""
    small = Shape(*(h - lo for lo, h in zip(low, high)))
    held = lattice
    for a, lo, h in zip(AXES, low, high):
        held = held.where((F.col(a) >= lo) & (F.col(a) < h)).withColumn(a, (F.col(a) - lo).cast("int"))
    return held.select(number(small).alias("vox"), "z", "y", "x", *CHANNELS), small


def tiles_of(lattice: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """vox, tile coordinates, and whether the cell lies on a lower face of its tile."""
    at = [F.floor(F.col(a) / n).cast("int").alias(f"t{a}") for a, n in zip(AXES, size)]
    edge = F.lit(False)
    for a, n in zip(AXES, size):
        edge = edge | ((F.col(a) > 0) & (F.col(a) % n == 0))
    return lattice.select("vox", *at, edge.alias("on_face"))
