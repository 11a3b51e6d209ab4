"""Connected components and pointer jumping over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import cut


PIECE = 1 << 18  # edges that one task contracts at once


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for edges between places 0 .. n - 1."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _contract(most: int):
    """Edges of a piece as (node, least node of its component in the piece); up to ``most`` of them at once."""

    def put(held):
        u, v = (np.concatenate(x) for x in held)
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = names[local_components(len(names), at[: len(u)], at[len(u) :])]
        moved = root != names
        return pa.record_batch({"u": pa.array(names[moved]), "v": pa.array(root[moved])})

    def run(batches):
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for x, c in zip(held, ("u", "v")):
                x.append(batch.column(c).to_numpy())
            size += batch.num_rows
            if size >= most:
                yield put(held)
                held, size = [[], []], 0
        if size:
            yield put(held)

    return run


_EDGE = "u long, v long"


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) of every node that has an edge to another.

    Edges are contracted piece by piece, ``PIECE`` edges in a task: a graph of one piece is
    done then.  Pieces are ranges of nodes, so where near nodes have near numbers, as cells
    do, few nodes stand in several: only those go on to the next, much smaller level, and
    all others take their root's root in one join.  A level that shrinks by less than half
    goes on by stars.  Nulls and self-loops are left out; repeated edges count once.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = cut(known.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"))
    return _rooted(edges, edges.count())


def _with_heads(pairs: DataFrame) -> DataFrame:
    """node and root of pairs (u, v) that are whole stars, with the roots themselves."""
    heads = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(heads)


def _rooted(edges: DataFrame, n: int) -> DataFrame:
    pieces = -(-n // PIECE)
    if pieces <= 1:
        return _with_heads(cut(edges.coalesce(1).mapInArrow(_contract(2 * PIECE), _EDGE)) if n else edges)
    found = cut(edges.repartitionByRange(pieces, "u", "v").mapInArrow(_contract(2 * PIECE), _EDGE))
    # nodes that more than one piece tells of: those with several rows, and roots with one of their own
    several = found.groupBy("u").count().where("count > 1").select("u")
    shared = several.unionAll(found.select(F.col("v").alias("u"))).distinct().withColumn("on", F.lit(True))
    marked = cut(found.join(shared, "u", "left").select("u", "v", F.coalesce("on", F.lit(False)).alias("on")))
    between = marked.where("on").select("u", "v")
    left = between.count()
    if not left:
        return _with_heads(found)
    top = cut(_rooted(between, left)) if 2 * left <= n else cut(_stars(between, left))
    up = top.select(F.col("node").alias("v"), "root")
    leaves = marked.where("not on").select("u", "v").join(F.broadcast(up) if left <= PIECE else up, "v", "left")
    heads = leaves.where("root is null").select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.select(F.col("u").alias("node"), F.coalesce("root", "v").alias("root")).unionAll(heads).unionAll(top)


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """The same by alternating large-star and small-star steps, for edges of any numbering.

    Each is a grouped minimum and a join on the node, so skewed hubs are pre-aggregated and
    their join is split by AQE.  Every step is written to the checkpoint folder, in as many
    files as there are pieces; the loop ends when a step changes nothing.
    """
    pieces = -(-n // PIECE)
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct().coalesce(max(pieces, 1)))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return _with_heads(edges)
        mark = now


def label(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """node and root of every row of ``nodes``; a node without edges is its own root."""
    found = components(edges, a, b).withColumnRenamed("node", "_n")
    return nodes.join(found, F.col(node) == F.col("_n"), "left").select(F.col(node).alias("node"), F.coalesce("root", node).alias("root"))


def compress(parents: DataFrame) -> DataFrame:
    """Fixed point of p = p[p] for rows (node, parent); doubling, so O(log depth) joins."""
    parents = cut(parents.select("node", "parent"))
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        jumped = cut(parents.join(up, F.col("parent") == F.col("_n"), "left").select("node", F.coalesce("_p", "parent").alias("parent"), (F.coalesce("_p", "parent") != F.col("parent")).alias("_c")))
        changed = jumped.agg(F.coalesce(F.sum(F.col("_c").cast("long")), F.lit(0))).first()[0]
        parents = jumped.select("node", "parent")
        if not changed:
            return parents
