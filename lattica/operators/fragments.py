"""Watershed fragments: plateaus, their division, basins, and dense ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators.components import PIECE, components
from lattica.operators.flow import clear_slab_faces, corners_of, flow, flow_edges, reciprocal_edges
from lattica.schemas import Shape
from lattica.session import cut


def plateaus(bits: DataFrame, shape: Shape) -> DataFrame:
    """vox and root (least cell) of cells that share a plateau with another."""
    return components(reciprocal_edges(bits, shape)).select(F.col("node").alias("vox"), "root")


def emptied(bits: np.ndarray, near: np.ndarray, mutual: np.ndarray, outlet: np.ndarray) -> np.ndarray:
    """Cells with a single way out each, for all plateaus among the cells at once.

    Cells are in order of their numbers; ``near`` has their six neighbours' places, ``mutual``
    tells where both point at each other.  Water reaches the cells breadth first from the
    outlets: a frontier's neighbours join the next one in the order of the first cell, then
    direction, that reaches them.  A reached cell keeps the last of its directions that leads
    off the plateau or to a cell reached before it.  Cells never reached keep all.
    """
    rank = np.full(len(bits), -1, dtype=np.int64)
    front, reached = np.flatnonzero(outlet), 0
    while len(front):
        rank[front] = reached + np.arange(len(front))
        reached += len(front)
        there = near[front][mutual[front]]  # row by row, so in order of cell and direction
        there = there[rank[there] < 0]
        found, first = np.unique(there, return_index=True)
        front = found[np.argsort(first)]
    wet = np.flatnonzero(rank >= 0)
    points = (bits[wet, None] >> np.arange(6)) & 1 == 1
    other = np.where(mutual[wet], rank[near[wet]], -1)
    leaves = points & (~mutual[wet] | (other >= 0) & (other < rank[wet, None]))
    out = bits.copy()
    out[wet] = 1 << (5 - np.argmax(leaves[:, ::-1], axis=1))
    return out


def plateau_emptied(vox: np.ndarray, bits: np.ndarray, outlet: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole plateaus' cells in any order: cells by number, what they keep, and their neighbours' numbers."""
    order = np.argsort(vox, kind="stable")
    vox, bits, outlet = vox[order], bits[order].astype(np.int64), outlet[order].astype(bool)
    target = vox[:, None] + steps
    near = np.minimum(np.searchsorted(vox, target), len(vox) - 1)
    points = (bits[:, None] >> np.arange(6)) & 1 == 1
    mutual = points & (vox[near] == target) & ((bits[near] >> ((np.arange(6) + 3) % 6)) & 1 == 1)
    return vox, emptied(bits, near, mutual, outlet), target


def divide(bits: DataFrame, shape: Shape) -> DataFrame:
    """Bits after every plateau with an outlet is emptied through its outlets.

    Cells outside a plateau never flow back into it, so plateaus are independent and go to
    tasks whole, many small ones to a task (``bucket``).  A lone outlet needs no order: its
    last direction stays.  A plateau is never split, as the order runs through all of it.
    """
    bits = cut(bits)
    pairs = cut(flow_edges(bits, shape))
    roots = components(pairs.where("forward and back")).select(F.col("node").alias("vox"), "root")
    out = corners_of(pairs).withColumn("outlet", F.lit(True))
    cells = cut(bits.join(out, "vox", "left").join(roots, "vox", "left").select("vox", "bits", F.coalesce("outlet", F.lit(False)).alias("outlet"), "root"))
    steps = np.array([*(-s for s in shape.strides), *shape.strides])

    def run(key, group):
        cells, kept, _ = plateau_emptied(*(group.column(c).to_numpy(zero_copy_only=False) for c in ("vox", "bits", "outlet")), steps)
        return pa.table({"vox": pa.array(cells), "bits": pa.array(kept.astype(np.int32))})

    drains = cells.where("root is not null and outlet").select("root").distinct()
    drained = cells.where("root is not null").join(drains, "root", "left_semi").groupBy(bucket(cells.count())).applyInArrow(run, "vox long, bits int")
    closed = cells.where("root is not null").join(drains, "root", "left_anti").select("vox", "bits")
    highest = F.when(F.col("outlet") & (F.col("bits") > 0), F.pow(F.lit(2), F.floor(F.log2(F.greatest("bits", F.lit(1)))))).otherwise(F.col("bits"))
    lone = cells.where("root is null").select("vox", highest.cast("int").alias("bits"))
    return drained.unionByName(closed).unionByName(lone)


def bucket(cells: int) -> Column:
    """The group that a plateau goes to, by its root: small ones share a group, as each group costs a call."""
    return F.pmod(F.xxhash64("root"), F.lit(max(1, -(-cells // PIECE)))).alias("bucket")


def dense_ids(rooted: DataFrame) -> DataFrame:
    """frag from 1 by ascending root, without a window over all rows.

    Roots are ranged into partitions; the partitions' sizes (one number each) give offsets.
    """
    roots = rooted.select("root").where("root is not null").distinct()
    ranged = cut(roots.repartitionByRange("root").sortWithinPartitions("root").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").count()
    offsets = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    own = ranged.join(F.broadcast(offsets), "part")
    return own.select("root", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("root"))).alias("frag"))


def basins(bits: DataFrame, shape: Shape) -> DataFrame:
    """vox and frag: components over all directions, numbered by their least cell; cells without flow are 0.

    A cell without bits takes part where another one flows into it.
    """
    bits = cut(bits)
    found = components(flow_edges(bits, shape)).withColumnRenamed("node", "vox")
    rooted = cut(bits.select("vox").join(found, "vox", "left"))
    return rooted.join(dense_ids(rooted), "root", "left").select("vox", F.coalesce("frag", F.lit(0)).cast("long").alias("frag"))


def watershed(lattice: DataFrame, shape: Shape, low: float, high: float, tie_flip: bool = False, coarse: float | None = None, slab: int | None = None, tile: tuple[int, int, int] | None = None) -> DataFrame:
    """Fragments of a lattice, block by block.  With ``slab`` flow doesn't cross slabs of that many planes."""
    from lattica.operators import blocks

    return blocks.watershed(lattice, shape, low, high, tie_flip, coarse, slab, tile or blocks.TILE)


def watershed_relational(lattice: DataFrame, shape: Shape, low: float, high: float, tie_flip: bool = False, coarse: float | None = None, slab: int | None = None) -> DataFrame:
    """The same by joins and aggregates over single cells, without blocks."""
    bits = flow(lattice, shape, low, high, tie_flip, coarse)
    if slab:
        bits = clear_slab_faces(bits, shape, slab)
    return basins(divide(bits, shape), shape)


def relabel(labels: DataFrame, column: str = "frag") -> DataFrame:
    """Labels by first appearance (least cell), from 1; 0 stays."""
    first = labels.where(F.col(column) != 0).groupBy(column).agg(F.min("vox").alias("root"))
    ids = dense_ids(first).withColumnRenamed("frag", "_new")
    names = first.join(ids, "root").select(F.col(column).alias("_old"), "_new")
    return labels.join(names, F.col(column) == F.col("_old"), "left").select("vox", F.coalesce("_new", F.lit(0)).cast("long").alias(column))


def sizes(frags: DataFrame) -> DataFrame:
    """frag and size of all fragments, background left out."""
    return frags.where("frag <> 0").groupBy("frag").agg(F.count("*").alias("size"))


def summary(frags: DataFrame) -> DataFrame:
    """n_fragments (distinct), max_id and background."""
    return frags.agg(F.countDistinct(F.when(F.col("frag") != 0, F.col("frag"))).alias("n_fragments"), F.coalesce(F.max("frag"), F.lit(0)).alias("max_id"), F.count_if(F.col("frag") == 0).alias("background"))


def size_histogram(sizes: DataFrame, column: str = "size") -> DataFrame:
    """bin and n: how many sizes lie in [2^bin, 2^(bin + 1))."""
    return sizes.groupBy(F.floor(F.log2(column)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def flow_summary(bits: DataFrame) -> DataFrame:
    """Cells without a direction, with one, and with several."""
    n = F.bit_count("bits")
    return bits.agg(F.count_if(n == 0).alias("none"), F.count_if(n == 1).alias("one"), F.count_if(n > 1).alias("several"))
