"""Scalar functions on affinities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = 1e-4, 0.9999


def quantise(a: Column) -> Column:
    """Byte of an affinity in [0, 1]: float32 product, rounded half to even, clipped."""
    scaled = F.rint(a.cast("float") * F.lit(255).cast("float"))
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int")


def dequantise(b: Column) -> Column:
    return (b / 255).cast("float")


def discretise(v: Column, levels: int) -> Column:
    return F.least(F.floor(v * levels), F.lit(levels - 1)).cast("int")


def undiscretise(b: Column, levels: int) -> Column:
    return (b.cast("double") + 0.5) / levels


def mean_affinity(total: Column, count: Column) -> Column:
    """Contact mean in [0, 1] of a byte sum."""
    return total / 255.0 / F.greatest(count, F.lit(1))
