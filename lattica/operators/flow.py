"""Steepest-flow directions of lattice cells, and the graphs that they make.

Bits: 1 -z, 2 -y, 4 -x, 8 +z, 16 +y, 32 +x.  A face is read once: each cell gives its
three faces to both of its cells, and one grouped aggregate brings a cell's six faces
together, so there is one shuffle with partial aggregation and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.schemas import Shape

DIRECTIONS = range(6)
CHANNELS = ("az", "ay", "ax")
AXES = ("z", "y", "x")


def reverse(d: int) -> int:
    return (d + 3) % 6


def faces(lattice: DataFrame, shape: Shape) -> DataFrame:
    """vox, nbr (the negative neighbour), axis and aff of each inner face."""
    each = F.array(*(F.struct(F.lit(i).alias("axis"), (F.col("vox") - s).alias("nbr"), F.col(c).alias("aff"), (F.col(a) > 0).alias("inner")) for i, (s, c, a) in enumerate(zip(shape.strides, CHANNELS, AXES))))
    return lattice.select("vox", F.explode(each).alias("f")).where("f.inner").select("vox", "f.nbr", "f.axis", "f.aff")


def neighbours(lattice: DataFrame, shape: Shape) -> DataFrame:
    """vox and a0 .. a5: the affinities by direction, null beyond the border.  Every cell has a row."""
    own = [F.struct(F.col("vox"), F.lit(i).alias("d"), F.when(F.col(a) > 0, F.col(c)).alias("aff")) for i, (c, a) in enumerate(zip(CHANNELS, AXES))]
    other = [F.struct((F.col("vox") - s).alias("vox"), F.lit(i + 3).alias("d"), F.when(F.col(a) > 0, F.col(c)).alias("aff")) for i, (s, c, a) in enumerate(zip(shape.strides, CHANNELS, AXES))]
    rows = lattice.select(F.explode(F.array(*own, *other)).alias("f")).select("f.*").where("aff is not null or d < 3")
    return rows.groupBy("vox").agg(*(F.max(F.when(F.col("d") == d, F.col("aff"))).alias(f"a{d}") for d in DIRECTIONS))


def flow(lattice: DataFrame, shape: Shape, low: float, high: float, tie_flip: bool = False, coarse: float | None = None) -> DataFrame:
    """vox and bits.  ``low`` and ``high`` are in the units of the affinities.

    A cell whose largest face isn't above ``low`` is background (0).  Else each face that
    equals the largest, or reaches ``high``, is a direction.  ``tie_flip`` keeps the last
    direction of equal ones only; ``coarse`` adds faces above ``low`` within it of the largest.
    """
    sides = [F.col(f"a{d}") for d in DIRECTIONS]
    most = F.greatest(*sides)
    equal = [F.coalesce(a == most, F.lit(False)) for a in sides]
    bits: Column = F.lit(0)
    for d in DIRECTIONS:
        takes = equal[d]
        for later in equal[d + 1 :] if tie_flip else []:
            takes = takes & ~later
        takes = takes | F.coalesce(sides[d] >= high, F.lit(False))
        if coarse is not None:
            takes = takes | F.coalesce((sides[d] >= most - coarse) & (sides[d] > low), F.lit(False))
        bits = bits + F.when(takes, 1 << d).otherwise(0)
    return neighbours(lattice, shape).select("vox", F.when(most > low, bits).otherwise(0).cast("int").alias("bits"))


def _step(shape: Shape, d: int) -> int:
    return -shape.strides[d] if d < 3 else shape.strides[d - 3]


def directed(bits: DataFrame, shape: Shape) -> DataFrame:
    """vox, d and nbr of each set direction bit."""
    each = F.array(*(F.struct(F.lit(d).alias("d"), (F.col("vox") + _step(shape, d)).alias("nbr"), (F.col("bits").bitwiseAND(1 << d) != 0).alias("on")) for d in DIRECTIONS))
    return bits.where("bits <> 0").select("vox", F.explode(each).alias("f")).where("f.on").select("vox", "f.d", "f.nbr")


def flow_edges(bits: DataFrame, shape: Shape) -> DataFrame:
    """a < b, forward (a points at b) and back (b points at a) of each pair that flows: one grouped aggregate."""
    ends = directed(bits, shape).select(F.least("vox", "nbr").alias("a"), F.greatest("vox", "nbr").alias("b"), (F.col("vox") < F.col("nbr")).alias("up"))
    return ends.groupBy("a", "b").agg(F.max("up").alias("forward"), F.max(~F.col("up")).alias("back"))


def reciprocal_edges(bits: DataFrame, shape: Shape) -> DataFrame:
    """a < b of cells that point at each other."""
    return flow_edges(bits, shape).where("forward and back").select("a", "b")


def corners(bits: DataFrame, shape: Shape) -> DataFrame:
    """vox of cells that point at a cell which doesn't point back."""
    return corners_of(flow_edges(bits, shape))


def corners_of(pairs: DataFrame) -> DataFrame:
    """The same from pairs that flow."""
    one = pairs.where("forward <> back")
    return one.select(F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("vox")).distinct()


def clear_slab_faces(bits: DataFrame, shape: Shape, slab: int) -> DataFrame:
    """Bits without flow between slabs of ``slab`` planes; exact only where seams have affinity 0."""
    z = F.floor(F.col("vox") / shape.strides[0])
    cleared = F.col("bits")
    cleared = F.when(z % slab == 0, cleared.bitwiseAND(~1)).otherwise(cleared)
    return bits.select("vox", F.when((z % slab == slab - 1) | (z == shape.z - 1), cleared.bitwiseAND(~8)).otherwise(cleared).cast("int").alias("bits"))
