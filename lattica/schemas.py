"""Schemas of the relations that operators take and give."""

from __future__ import annotations

from dataclasses import dataclass

#: One row for each cell; a channel holds the face towards the negative neighbour on its axis.
LATTICE = "vox long, z int, y int, x int, az int, ay int, ax int"
BITS = "vox long, bits int"
FRAGMENTS = "vox long, frag long"  # 0 is background
GRAPH = "u long, v long, sum_bytes long, cnt long"  # u < v, u > 0
PARENTS = "threshold double, frag long, root long"
LABELS = "threshold double, vox long, label long"
MERGES = "threshold double, step long, a long, b long, c long, score double"
METRICS = "rand_split double, rand_merge double, voi_split double, voi_merge double"


@dataclass(frozen=True)
class Shape:
    """Extent of a lattice; a cell's number is (z * Y + y) * X + x."""

    z: int
    y: int
    x: int

    @property
    def strides(self) -> tuple[int, int, int]:
        return self.y * self.x, self.x, 1

    @property
    def cells(self) -> int:
        return self.z * self.y * self.x


class ShapeError(ValueError):
    pass
