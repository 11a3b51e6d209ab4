"""Watershed block by block, with what crosses blocks joined up afterwards.

Cells go once to the blocks that need them: a block's own cells with a halo of one cell
on each side, whose flow it works out as well, and the layer beyond that this takes.  A
block then gives, by arrays,

* each own cell's local basin: components over the flow of all cells but those of open
  plateaus (plateaus that reach over the block's border), after closed plateaus are
  divided in the block;
* the cells of open plateaus, and the pairs by which plateaus reach over the border;
* the flow over the border, and the basins of the cells that it may concern.

Open plateaus are put together from the pairs, and divided one by one.  Components over
the flow that remains name the basins; only cells at borders and in open plateaus take
part in that, so what is shuffled after the first pass grows with the blocks' surfaces.
Results equal those of the relational operators (``flow``, ``divide``, ``basins``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.components import components, local_components
from lattica.operators.fragments import bucket, dense_ids, emptied, plateau_emptied
from lattica.schemas import Shape
from lattica.session import cut, prepare

TILE = (32, 32, 32)
NONE = np.iinfo(np.int64).min // 4  # the affinity of a face that isn't there


def extents(shape: Shape, tile: tuple[int, int, int] = TILE) -> tuple[int, int, int]:
    """Blocks along each axis."""
    return tuple(-(-n // t) for n, t in zip((shape.z, shape.y, shape.x), tile))


def to_blocks(lattice: DataFrame, shape: Shape, tile: tuple[int, int, int] = TILE, before: int = 1, after: int = 2) -> DataFrame:
    """``lattice`` with the block that each row goes to: own cells and ``before`` / ``after`` layers around them."""
    nz, ny, nx = extents(shape, tile)
    each = lambda c, t, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - after) / t)).cast("int"), F.least(F.lit(n - 1), F.floor((F.col(c) + before) / t)).cast("int"))
    at = [each(c, t, n) for c, t, n in zip("zyx", tile, (nz, ny, nx))]
    rows = lattice.withColumn("_bz", F.explode(at[0])).withColumn("_by", F.explode(at[1])).withColumn("_bx", F.explode(at[2]))
    return rows.withColumn("block", (F.col("_bz").cast("long") * ny + F.col("_by")) * nx + F.col("_bx")).drop("_bz", "_by", "_bx")


class Block:
    """Flow of one block's cells and of the halo around them, as flat arrays."""

    def __init__(self, columns: dict[str, np.ndarray], block: int, shape: Shape, tile, low: float, high: float, tie_flip: bool, coarse: float | None, slab: int | None):
        counts = extents(shape, tile)
        at = np.unravel_index(block, counts)
        whole = (shape.z, shape.y, shape.x)
        start = [b * t for b, t in zip(at, tile)]
        size = [min(t, n - s) for t, n, s in zip(tile, whole, start)]
        box = [s + 3 for s in size]
        places = [columns[c].astype(np.int64) - s + 1 for c, s in zip("zyx", start)]
        # rows of a ragged last block may lie beyond its box
        fits = np.logical_and.reduce([(p >= 0) & (p < n) for p, n in zip(places, box)])
        places = [p[fits] for p in places]
        faces = np.full((3, *box), NONE, dtype=np.int64)
        for axis, c in enumerate(("az", "ay", "ax")):
            inner = columns["zyx"[axis]][fits] > 0
            faces[(axis, *(p[inner] for p in places))] = columns[c][fits][inner]
        cut_ = tuple(slice(0, n - 1) for n in box)
        sides = [faces[(axis, *cut_)] for axis in range(3)]
        sides += [faces[(axis, *(slice(1, None) if k == axis else s for k, s in enumerate(cut_)))] for axis in range(3)]
        most = np.maximum.reduce(sides)
        bits = np.zeros(most.shape, dtype=np.int64)
        for d in range(6):
            takes = sides[d] == most
            for later in sides[d + 1 :] if tie_flip else []:
                takes &= later != most
            takes |= sides[d] >= high
            if coarse is not None:
                takes |= (sides[d] >= most - coarse) & (sides[d] > low)
            bits |= np.where(takes & (sides[d] != NONE), 1 << d, 0)
        bits[most <= low] = 0
        if slab:
            z = np.arange(most.shape[0]) + start[0] - 1
            bits[z % slab == 0] &= ~1
            bits[(z % slab == slab - 1) | (z == shape.z - 1)] &= ~8
        self.bits = bits.reshape(-1)
        strides = (most.shape[1] * most.shape[2], most.shape[2], 1)
        self.steps = np.array([*(-s for s in strides), *strides])
        own = np.zeros(most.shape, dtype=bool)
        own[tuple(slice(1, s + 1) for s in size)] = True
        self.is_own = own.reshape(-1)
        self.own = np.flatnonzero(self.is_own)
        z, y, x = (c + s - 1 for c, s in zip(np.unravel_index(np.arange(own.size), own.shape), start))
        self.vox = (z * shape.y + y) * shape.x + x


#: Kinds of rows that a block gives.
CELL, LINK, PLATEAU, OPEN = 0, 1, 2, 3
_ROWS = "kind int, vox long, a long, bits int, flag boolean"


def _rows(kind: int, vox: np.ndarray, a: np.ndarray, bits: np.ndarray | None = None, flag: np.ndarray | None = None) -> pa.Table:
    n = len(vox)
    return pa.table({
        "kind": pa.array(np.full(n, kind, np.int32)), "vox": pa.array(vox.astype(np.int64)), "a": pa.array(a.astype(np.int64)),
        "bits": pa.array(np.zeros(n, np.int32) if bits is None else bits.astype(np.int32)), "flag": pa.array(np.zeros(n, bool) if flag is None else flag),
    })


def work(block: Block) -> pa.Table:
    own, vox, bits = block.own, block.vox, block.bits
    near = own[:, None] + block.steps
    points = (bits[own, None] >> np.arange(6)) & 1 == 1
    answered = (bits[near] >> ((np.arange(6) + 3) % 6)) & 1 == 1
    mutual, inside = points & answered, block.is_own[near]
    outlet = (points & ~answered).any(axis=1)
    place = np.full(len(bits), -1, dtype=np.int64)
    place[own] = np.arange(len(own))
    there = place[near]  # -1 in the halo

    def joined(mask):
        cell, d = np.nonzero(mask & inside)
        return local_components(len(own), cell, there[cell, d])

    plateau = joined(mutual & (np.arange(6) > 2))
    reaches = mutual & ~inside
    open_ = np.zeros(len(own), dtype=bool)
    open_[plateau[reaches.any(axis=1)]] = True
    open_ = open_[plateau]
    kept = np.where(open_, 0, emptied(np.where(open_, 0, bits[own]), np.where(inside, there, 0), mutual & inside & ~open_[:, None], outlet & ~open_))
    flows = (kept[:, None] >> np.arange(6)) & 1 == 1
    basin = joined(flows)
    touched = flows.any(axis=1)
    touched[there[flows & inside]] = True
    out = [_rows(CELL, vox[own], np.where(touched, vox[own][basin], vox[own]), flag=touched)]
    cell, d = np.nonzero(flows & ~inside)
    out.append(_rows(LINK, vox[own][cell], vox[near[cell, d]]))
    # cells that flow from elsewhere may reach: pointed at from the halo, by an open plateau, or in one
    concerned = (flows & ~inside).any(axis=1) | (answered & ~inside).any(axis=1) | open_
    cell, d = np.nonzero(points & inside & open_[:, None])
    concerned[there[cell, d]] = True
    mine = np.flatnonzero(concerned & touched)
    out.append(_rows(LINK, vox[own][mine], vox[own][basin[mine]]))
    cell, d = np.nonzero(reaches)
    out.append(_rows(PLATEAU, vox[own][cell], vox[near[cell, d]]))
    border = np.unique(cell)
    out.append(_rows(PLATEAU, vox[own][border], vox[own][plateau[border]]))
    out.append(_rows(OPEN, vox[own][open_], vox[own][plateau[open_]], bits[own][open_], outlet[open_]))
    return pa.concat_tables(out)


def divided(cells: DataFrame, shape: Shape, n: int) -> DataFrame:
    """Flow (vox, a) of whole plateaus, given as ``n`` rows (root, vox, bits, flag: an outlet); small ones share a task."""
    steps = np.array([*(-s for s in shape.strides), *shape.strides])

    def run(key, group):
        vox, kept, target = plateau_emptied(*(group.column(c).to_numpy(zero_copy_only=False) for c in ("vox", "bits", "flag")), steps)
        cell, d = np.nonzero((kept[:, None] >> np.arange(6)) & 1 == 1)
        return pa.table({"vox": pa.array(vox[cell]), "a": pa.array(target[cell, d])})

    return cells.groupBy(bucket(n)).applyInArrow(run, "vox long, a long")


def watershed(lattice: DataFrame, shape: Shape, low: float, high: float, tie_flip: bool = False, coarse: float | None = None, slab: int | None = None, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """vox and frag of every cell, like ``basins(divide(flow(...)))``.

    Ties, cells without flow (0) and an empty lattice are as there.  An open plateau is one
    task, as the order of division runs through all of it: about 200 bytes a cell.
    """
    prepare(lattice.sparkSession)
    columns = ("z", "y", "x", "az", "ay", "ax")

    def run(key, group):
        own = {c: group.column(c).to_numpy() for c in columns}
        return work(Block(own, key[0].as_py(), shape, tile, low, high, tie_flip, coarse, slab))

    rows = cut(to_blocks(lattice.select(*columns), shape, tile).groupBy("block").applyInArrow(run, _ROWS))
    of = lambda kind: rows.where(F.col("kind") == kind)
    flow = of(LINK).select("vox", "a")
    open_ = of(OPEN)
    n_open = open_.count()
    if n_open:
        roots = components(of(PLATEAU).select("vox", "a"), "vox", "a").select(F.col("node").alias("a"), "root")
        flow = flow.unionByName(cut(divided(open_.join(roots, "a", "left").select(F.coalesce("root", "a").alias("root"), "vox", "bits", "flag"), shape, n_open)))
    roots = cut(components(flow, "vox", "a"))
    local = of(CELL).where("flag").select(F.col("a").alias("node")).distinct()
    named = cut(local.unionByName(roots.select("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    ids = named.join(dense_ids(named), "root").select(F.col("node").alias("a"), "frag")
    return of(CELL).select("vox", "a").join(ids, "a", "left").select("vox", F.coalesce("frag", F.lit(0)).cast("long").alias("frag"))


def components_by_block(edges: DataFrame, block_of, a: str = "a", b: str = "b") -> DataFrame:
    """node and root like ``components``, in two phases: inside blocks, then over the edges between them.

    ``block_of``: the block of a node's column.  Each block is one task; what crosses blocks goes on as edges between local roots.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    placed = cut(known.withColumns({"ba": block_of(F.col("a")), "bb": block_of(F.col("b"))}))

    def run(key, group):
        names, at = np.unique(np.concatenate([group.column("a").to_numpy(), group.column("b").to_numpy()]), return_inverse=True)
        root = local_components(len(names), at[: group.num_rows], at[group.num_rows :])
        return pa.table({"node": pa.array(names), "root": pa.array(names[root])})

    inner = cut(placed.where("ba = bb").groupBy("ba").applyInArrow(run, "node long, root long"))
    across = placed.where("ba <> bb").select("a", "b")
    ends = across.select(F.col("a").alias("node")).unionAll(across.select("b")).distinct()
    stitched = cut(components(across.unionAll(inner.join(ends, "node", "left_semi").select("node", "root"))))
    up = stitched.withColumnsRenamed({"node": "local", "root": "top"})
    whole = inner.join(up, inner["root"] == up["local"], "left").select("node", F.coalesce("top", "root").alias("root"))
    return whole.unionByName(stitched.join(inner, "node", "left_anti"))


def block_ids(lattice: DataFrame, side: int = 2) -> DataFrame:
    """vox and block of cubes of ``side`` cells."""
    at = [F.floor(F.col(c) / side) for c in "zyx"]
    return lattice.select("vox", *(x.cast("int").alias(f"b{c}") for x, c in zip(at, "zyx")))


def undivided_blocks(frags: DataFrame, blocks: DataFrame) -> DataFrame:
    """bz, by, bx and labels of the cubes whose cells aren't all of one fragment: blocks can't be contracted to one cell there."""
    both = frags.join(blocks, "vox").groupBy("bz", "by", "bx").agg(F.countDistinct("frag").alias("labels"))
    return both.where("labels > 1")
