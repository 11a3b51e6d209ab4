"""Region graphs: contacts, edge statistics, contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scores import PROVIDERS, Score
from lattica.operators.flow import AXES, CHANNELS
from lattica.schemas import Shape


def contacts(lattice: DataFrame, frags: DataFrame, shape: Shape) -> DataFrame:
    """u < v and aff of each face between two different fragments, background left out.

    Fragments join the lattice once; each cell then gives its fragment and faces to the
    cells beyond, and one grouped aggregate brings both sides of a cell's faces together.
    """
    own = lattice.join(frags.select("vox", F.col("frag").alias("f")), "vox")
    side = lambda vox, axis, aff: F.struct(vox.alias("vox"), F.lit(axis).alias("axis"), aff.cast("double" if real else "int").alias("aff"), F.col("f"))
    real = any(kind in ("float", "double") for c, kind in lattice.dtypes if c in CHANNELS)
    given = [F.when((F.col(a) > 0) & (F.col("f") != 0), side(F.col("vox") - s, i, F.col(c))) for i, (s, c, a) in enumerate(zip(shape.strides, CHANNELS, AXES))]
    rows = own.select(F.explode(F.array(side(F.col("vox"), -1, F.lit(0)), *given)).alias("s")).where("s is not null").select("s.*").where("f <> 0")
    pick = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    cells = rows.groupBy("vox").agg(pick(-1, "f").alias("g"), *(F.struct(pick(i, "f").alias("f"), pick(i, "aff").alias("aff")).alias(f"s{i}") for i in range(3)))
    met = cells.where("g is not null").select("g", F.explode(F.array("s0", "s1", "s2")).alias("s")).where("s.f is not null and s.f <> g")
    return met.select(F.least("s.f", "g").alias("u"), F.greatest("s.f", "g").alias("v"), "s.aff")


def region_graph(lattice: DataFrame, frags: DataFrame, shape: Shape) -> DataFrame:
    """u, v, sum_bytes, cnt: integer sums, so no order of rows changes them."""
    return contract_rows(contacts(lattice, frags, shape).select("u", "v", F.col("aff").cast("long").alias("sum_bytes"), F.lit(1).cast("long").alias("cnt")))


def contract_rows(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").agg(F.sum("sum_bytes").alias("sum_bytes"), F.sum("cnt").alias("cnt"))


def statistics(contacts: DataFrame, needs: frozenset[str] | set[str], sizes: DataFrame | None = None, scale: float = 255.0) -> DataFrame:
    """Edge statistics by name, only those that are needed.

    cnt, sum, min, max and those of providers come from one aggregate; levels from one by
    affinity first, so an edge never holds more than its distinct affinities; size_u and
    size_v from ``sizes`` (frag, size), which is joined once per end.
    """
    own = [PROVIDERS[n] for n in sorted(needs) if n in PROVIDERS]
    if own and "levels" in needs:
        more = statistics(contacts, {p.name for p in own}, scale=scale).drop("cnt")
        return statistics(contacts, set(needs) - {p.name for p in own}, sizes, scale).join(more, ["u", "v"])
    if "levels" in needs:
        a = F.col("aff") / scale
        by_level = contacts.groupBy("u", "v", "aff").agg(F.count("*").alias("n"))
        makers: dict[str, Column] = {
            "cnt": F.sum("n"), "sum": F.sum(F.col("aff").cast("long") * F.col("n")) / scale, "min": F.min(a), "max": F.greatest(F.lit(0.0), F.max(a)), "levels": F.sort_array(F.collect_list(F.struct(a.alias("a"), "n"))),
        }
        rows = by_level
    else:
        a = F.col("aff") / scale
        # sums stay integers until the end
        makers = {"cnt": F.count("*"), "sum": F.sum(F.col("aff").cast("long")) / scale, "min": F.min(a), "max": F.greatest(F.lit(0.0), F.max(a)), **{p.name: p.aggregate(a) for p in own}}
        rows = contacts
    out = rows.groupBy("u", "v").agg(*(c.alias(n) for n, c in makers.items() if n in needs or n == "cnt"))
    if {"size_u", "size_v"} & set(needs):
        if sizes is None:
            raise ValueError("this score needs fragment sizes")
        for end in ("u", "v"):
            out = out.join(sizes.select(F.col("frag").alias(end), F.col("size").alias(f"size_{end}")), end)
    return out


def histogram(contacts: DataFrame, bins: int = 256, scale: float = 255.0) -> DataFrame:
    """u, v, bin, n: the mergeable form of the histogram quantile."""
    at = F.least(F.floor(F.col("aff") / scale * bins), F.lit(bins - 1)).cast("int")
    return contacts.groupBy("u", "v", at.alias("bin")).agg(F.count("*").alias("n"))


def scored(contacts: DataFrame, score: Score, sizes: DataFrame | None = None, scale: float = 255.0) -> DataFrame:
    """u, v, score of each edge."""
    return statistics(contacts, score.needs, sizes, scale).select("u", "v", score.column().alias("score"))


def contract(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the roots of ``parents`` (frag, root); inner edges go, parallel ones merge."""
    up = parents.select("frag", "root")
    out = edges.join(up.withColumnsRenamed({"frag": "u", "root": "ru"}), "u", "left").join(up.withColumnsRenamed({"frag": "v", "root": "rv"}), "v", "left")
    out = out.select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"), "sum_bytes", "cnt").where("a <> b and a <> 0 and b <> 0")
    return contract_rows(out.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "sum_bytes", "cnt"))


def contract_dirty(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The same, re-aggregating only edges that touch a merged node or its root.

    Two edges can only fall together if one of them touches a merged node and the other
    that node's root (or another merged node), so all others pass through unshuffled.
    """
    moved = parents.where("frag <> root")
    touched = moved.select(F.col("frag").alias("n")).unionAll(moved.select(F.col("root").alias("n"))).distinct()
    marked = edges.join(touched.withColumnRenamed("n", "u").withColumn("tu", F.lit(True)), "u", "left").join(touched.withColumnRenamed("n", "v").withColumn("tv", F.lit(True)), "v", "left")
    dirty = F.coalesce("tu", "tv", F.lit(False))
    return marked.where(~dirty).select("u", "v", "sum_bytes", "cnt").unionByName(contract(marked.where(dirty).select("u", "v", "sum_bytes", "cnt"), moved))


def induced(edges: DataFrame, below: int) -> DataFrame:
    """Edges between ids under ``below``."""
    return edges.where((F.col("u") < below) & (F.col("v") < below))


def find_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and the edge between them (either way round) for each row of ``pairs``; null where there is none."""
    keyed = pairs.select("a", "b", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return keyed.join(edges, ["u", "v"], "left").drop("u", "v")
