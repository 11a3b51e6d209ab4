"""The array-in, array-out surface, and the same steps over DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.affinity import HIGH, LOW
from lattica.functions.scores import DEFAULT, Score, parse
from lattica.functions.thresholds import resolve_eps, resolve_thresholds
from lattica.operators import graph, labels, merge, metrics
from lattica.operators.fragments import sizes, watershed
from lattica.schemas import Shape, ShapeError
from lattica.session import cut, prepare
from lattica.sources.lattice import as_bytes, as_numpy, from_torch, labels_from_numpy, labels_to_numpy, lattice_from_numpy, to_torch  # noqa: F401 - from_torch and to_torch are part of this surface


def engine_ready() -> bool:
    """There is nothing to load: always true."""
    return True


#: The names by which callers ask for native libraries: none are needed.
cuda_libs_ready = engine_ready


def missing_cuda_libs() -> list[str]:
    return []


def require_cuda_libs() -> None:
    """Nothing is missing, so nothing is raised."""


def repo_root() -> Path:
    """Where this package's repository lies."""
    return Path(__file__).resolve().parent.parent.parent


class DevBuf:
    """A result that callers fetch when they want it: a volume of labels still in its DataFrame."""

    def __init__(self, shape: tuple[int, ...], dtype, fetch: Callable[[], np.ndarray]):
        self.shape, self.dtype, self._fetch = tuple(int(n) for n in shape), np.dtype(dtype), fetch
        self.nbytes = int(np.prod(self.shape)) * self.dtype.itemsize

    @classmethod
    def from_host(cls, array) -> DevBuf:
        own = np.ascontiguousarray(as_numpy(array))
        return cls(own.shape, own.dtype, lambda: own)

    def to_host(self, count: int | None = None) -> np.ndarray:
        """The array, or the first ``count`` of its elements."""
        own = self._fetch()
        return own if count is None else own.reshape(-1)[:count]

    def __array__(self, dtype=None, copy=None):
        own = self.to_host()
        return own if dtype is None else own.astype(dtype)

    def free(self) -> None:
        self._fetch = lambda: np.zeros(0, self.dtype)


def _spark(spark: SparkSession | None) -> SparkSession:
    return prepare(spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())


# -- DataFrames ------------------------------------------------------------------------


def parents_table(edges: DataFrame, frags: DataFrame, thresholds: Sequence[float], eps: float | None = None, method: str = "approximate") -> DataFrame:
    """threshold, frag, root for affinity thresholds.

    ``approximate``: (1 + eps) rounds in a task for each component that can merge.
    ``rounds``: the same rules as joins and aggregates over the whole graph, for graphs with
    a component too large for a task.  ``exact`` or ``rac``: lowest score first.  All share one state
    over falling thresholds, so labels at one depend on which others were asked for.
    """
    wanted = [float(t) for t in thresholds]
    eps = resolve_eps(wanted, eps)
    if method in ("exact", "rac"):  # reciprocal merging gives the same partition
        stats = edges.select("u", "v", "cnt", (F.col("sum_bytes") / 255.0).alias("sum"))
        found = merge.exact(stats, [1 - t for t in wanted])
        levels = F.create_map(*(F.lit(x) for t in wanted for x in (1 - t, t)))
        return found.where("kind = 'parent'").select(levels[F.col("threshold")].alias("threshold"), F.col("a").alias("frag"), F.col("c").alias("root"))
    if method == "rounds":
        nodes = frags.where("frag <> 0").select(F.col("frag").alias("id")).distinct()
        out = None
        for byte, parents in merge.rounds(edges, nodes, [t * 255 for t in wanted], eps).items():
            own = next(t for t in wanted if t * 255 == byte)
            part = parents.select(F.lit(own).alias("threshold"), "frag", "root")
            out = part if out is None else out.unionByName(part)
        return out
    if method != "approximate":
        raise ValueError(f"method must be approximate, rounds, exact or rac, not {method!r}")
    found = merge.approximate(edges, [t * 255 for t in wanted], eps)
    levels = F.create_map(*(F.lit(x) for t in wanted for x in (t * 255, t)))
    return found.select(levels[F.col("threshold")].alias("threshold"), "frag", "root")


def segment_frames(lattice: DataFrame, shape: Shape, thresholds: Sequence[float], low: float = LOW, high: float = HIGH, eps: float | None = None, method: str = "approximate", frags: DataFrame | None = None, timings: dict | None = None) -> DataFrame:
    """threshold, vox, label of a byte lattice."""
    timings = {} if timings is None else timings
    began = time.time()

    def lap(name):
        nonlocal began
        timings[name], began = (time.time() - began) * 1000, time.time()

    if frags is None:
        frags = cut(watershed(lattice, shape, low * 255, high * 255))
    lap("ws")
    edges = cut(graph.region_graph(lattice, frags, shape))
    lap("rag")
    parents = cut(parents_table(edges, frags, thresholds, eps, method))
    lap("agg")
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    out = frags.select(levels, "vox", "frag").join(parents, ["threshold", "frag"], "left").select("threshold", "vox", F.coalesce("root", "frag").alias("label"))
    lap("extract")
    return out


# -- arrays ----------------------------------------------------------------------------


def fragments(aff, *, aff_low: float = LOW, aff_high: float = HIGH, spark: SparkSession | None = None) -> np.ndarray:
    """Watershed fragments of affinities [3,Z,Y,X]."""
    own, shape = lattice_from_numpy(_spark(spark), aff)
    return labels_to_numpy(watershed(own, shape, aff_low * 255, aff_high * 255), shape, "frag").astype(np.uint32)


def _checked(aff, frag) -> np.ndarray:
    own = as_numpy(frag)
    if as_bytes(aff).shape[1:] != own.shape:
        raise ShapeError(f"fragments of shape {list(own.shape)} don't fit affinities [3,Z,Y,X] of {list(as_numpy(aff).shape)}")
    return own


def region_graph(aff, frag, *, spark: SparkSession | None = None) -> dict[str, np.ndarray]:
    """u, v, sum, count, mean of each touching pair of fragments."""
    own = _checked(aff, frag)
    spark = _spark(spark)
    lattice, shape = lattice_from_numpy(spark, aff)
    got = graph.region_graph(lattice, labels_from_numpy(spark, own), shape).orderBy("u", "v").toArrow()
    u, v, total, count = (got.column(c).to_numpy() for c in ("u", "v", "sum_bytes", "cnt"))
    return {"u": u.astype(np.uint32), "v": v.astype(np.uint32), "sum": total / 255.0, "count": count, "mean": total / 255.0 / np.maximum(count, 1)}


def _volumes(frame: DataFrame, shape: Shape, thresholds: list[float]) -> list[np.ndarray]:
    frame = cut(frame)
    return [labels_to_numpy(frame.where(F.col("threshold") == t), shape).astype(np.uint32) for t in thresholds]


def segment(aff, thresholds: Sequence[float], *, aff_low: float = LOW, aff_high: float = HIGH, eps: float | None = None, threshold_mode: str = "affinity", method: str = "approximate", spark: SparkSession | None = None) -> list[np.ndarray]:
    """A label volume for each threshold, in the order given."""
    wanted = resolve_thresholds(thresholds, threshold_mode)
    lattice, shape = lattice_from_numpy(_spark(spark), aff)
    return _volumes(segment_frames(lattice, shape, wanted, aff_low, aff_high, eps, method), shape, wanted)


agglomerate = segment


def segment_d(aff, thresholds: Sequence[float], aff_low: float = LOW, aff_high: float = HIGH, return_device: bool = False, eps: float | None = None, threshold_mode: str = "affinity", method: str = "approximate", spark: SparkSession | None = None) -> list:
    """``segment`` whose volumes, with ``return_device``, stay in their DataFrames until they are fetched."""
    wanted = resolve_thresholds(thresholds, threshold_mode)
    lattice, shape = lattice_from_numpy(_spark(spark), aff)
    frame = segment_frames(lattice, shape, wanted, aff_low, aff_high, eps, method)
    if not return_device:
        return _volumes(frame, shape, wanted)
    frame = cut(frame)
    of = lambda t: lambda: labels_to_numpy(frame.where(F.col("threshold") == t), shape).astype(np.uint32)
    return [DevBuf((shape.z, shape.y, shape.x), np.uint32, of(t)) for t in wanted]


def labels_from_fragments(aff, frag, thresholds: Sequence[float], *, eps: float | None = None, threshold_mode: str = "affinity", method: str = "approximate", spark: SparkSession | None = None) -> list[np.ndarray]:
    """The same from given fragments."""
    own, wanted = _checked(aff, frag), resolve_thresholds(thresholds, threshold_mode)
    spark = _spark(spark)
    lattice, shape = lattice_from_numpy(spark, aff)
    return _volumes(segment_frames(lattice, shape, wanted, eps=eps, method=method, frags=labels_from_numpy(spark, own)), shape, wanted)


def agglomerate_scores(aff, thresholds: Sequence[float], gt=None, frags=None, aff_low: float = LOW, aff_high: float = HIGH, return_merge_history: bool = False, return_region_graph: bool = False, scoring_function: str | Score = DEFAULT, discretize_queue: int = 0, force_rebuild: bool = False, spark: SparkSession | None = None) -> Iterator:
    """Exact merging at rising score thresholds: yields the labels, or a tuple with metrics,
    history and graph where asked for.  Each yield is an array of its own, and nothing that
    was given is changed.  ``force_rebuild`` has no effect: scores aren't compiled."""
    score = scoring_function if isinstance(scoring_function, Score) else parse(scoring_function)
    spark = _spark(spark)
    lattice, shape = lattice_from_numpy(spark, aff)
    own = labels_from_numpy(spark, _checked(aff, frags)) if frags is not None else watershed(lattice, shape, aff_low * 255, aff_high * 255)
    own = cut(own)
    order = sorted(float(t) for t in thresholds)
    stats = cut(graph.statistics(graph.contacts(lattice, own, shape), score.needs | {"cnt"}, sizes(own)))
    merged = merge.exact(stats, order, score, discretize_queue)
    truth = labels_from_numpy(spark, gt, "gt") if gt is not None else None
    for t in order:
        up = merged.where((F.col("kind") == "parent") & (F.col("threshold") == t)).select(F.col("a").alias("frag"), F.col("c").alias("root"))
        got = cut(labels.extract(own, up))
        out: list = [labels_to_numpy(got, shape)]
        if truth is not None:
            out.append(metrics.evaluate(metrics.align(got, truth)).first().asDict())
        if return_merge_history:
            rows = merge.merge_history(merged).where(F.col("threshold") == t).orderBy("component", "step").collect()
            out.append([{"a": r["a"], "b": r["b"], "c": r["c"], "score": r["score"]} for r in rows])
        if return_region_graph:
            out.append([{"u": r["u"], "v": r["v"], "score": r["score"]} for r in merge.region_graph_after(merged, stats, t, score).orderBy("u", "v").collect()])
        yield out[0] if len(out) == 1 else tuple(out)


def evaluate(seg, gt, spark: SparkSession | None = None) -> dict[str, float]:
    """rand_split, rand_merge, voi_split, voi_merge of two label arrays."""
    spark = _spark(spark)
    a, b = as_numpy(seg), as_numpy(gt)
    if a.shape != b.shape:
        raise ShapeError("seg and gt differ in shape")
    both = labels_from_numpy(spark, a, "seg").join(labels_from_numpy(spark, b, "gt"), "vox")
    return metrics.evaluate(both).first().asDict()
