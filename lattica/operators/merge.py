"""Region merging: exact by score, frozen, mutual-best, and (1 + eps)-approximate rounds.

Exact merging runs component by component.  For a score whose statistics stay between
those of their parts (mean, min, max, quantiles) under OneMinus, a merge below a threshold
needs an original edge below it, so components of such edges never touch each other and
each is one task.  Scores without that property are merged as one component.

Merging is strict: score < threshold, that is mean > affinity threshold.  Ties go by
(score, u, v).  The smaller id survives.  Thresholds run on one state, in order, so cuts
are nested.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions.scores import DEFAULT, PROVIDERS, MeanAffinity, OneMinus, Score, _Unary
from lattica.operators import lazy
from lattica.operators.components import components, compress, local_components
from lattica.operators.graph import contract, contract_rows
from lattica.session import cut, shuffle_partitions


def monotone(score: Score) -> bool:
    """Whether merging can go by components of edges under the threshold."""
    return isinstance(score, OneMinus) and score.between and not (isinstance(score.x, _Unary))


class Kernel:
    """Exact merging of one component's edges, resumable over rising score thresholds."""

    def __init__(self, edges: list[dict], score: Score, queue_bins: int = 0, events: bool = False, providers: dict | None = None):
        self.score, self.bins = score, queue_bins
        self.events: list[tuple] | None = [] if events else None
        self.providers = PROVIDERS if providers is None else providers
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.near: dict[int, dict[int, dict]] = {}
        self.heap: list[tuple] = []
        self.step = 0
        for e in edges:
            u, v = e["u"], e["v"]
            for n, s in ((u, e.get("size_u", 1)), (v, e.get("size_v", 1))):
                self.parent.setdefault(n, n)
                self.size.setdefault(n, s)
                self.near.setdefault(n, {})
            self.near[u][v] = self.near[v][u] = e
            e["version"] = 0
            self._push(u, v, e)

    def _score(self, u: int, v: int, e: dict) -> float:
        return self.score.value(e | {"u": u, "v": v, "size_u": self.size[u], "size_v": self.size[v]})

    def _push(self, u: int, v: int, e: dict) -> None:
        s = self._score(u, v, e)
        key = min(self.bins - 1, max(0, int(s * self.bins))) if self.bins else s
        heapq.heappush(self.heap, (key, min(u, v), max(u, v), e["version"], s))

    def until(self, threshold: float):
        """Merge while the best score is below the threshold; yield (step, a, b, survivor, score).

        Every merge is told as (step, u, v, survivor, score); edges that wait in a bin with
        some below the threshold go back to the queue for the next one.
        """
        late = []
        while self.heap:
            _, u, v, version, s = self.heap[0]
            e = self.near.get(u, {}).get(v)
            if e is None or e["version"] != version:
                heapq.heappop(self.heap)
                self.note("deleted" if e is None else "stale", u, v, s)
                continue
            if s >= threshold:
                if not self.bins or self.heap[0][0] > min(self.bins - 1, int(threshold * self.bins)):
                    break
                heapq.heappop(self.heap)
                late.append((u, v, e))
                continue
            heapq.heappop(self.heap)
            self.note("pop", u, v, s)
            yield self.step, u, v, u, s
            self.step += 1
            self._merge(u, v)
        for u, v, e in late:
            if self.near.get(u, {}).get(v) is e:
                self._push(u, v, e)

    def note(self, what: str, u: int, v: int, score: float) -> None:
        """Keep what happened at the queue, where asked for."""
        if self.events is not None:
            self.events.append((what, self.step, u, v, score))

    def _merge(self, u: int, v: int) -> None:
        self.parent[v] = u
        self.size[u] += self.size[v]
        gone = self.near.pop(v)
        del self.near[u][v], gone[u]
        for w, e in gone.items():
            other = self.near[w]
            del other[v]
            kept = self.near[u].get(w)
            if kept is None:
                kept = e
            else:
                for name, how in (("cnt", sum), ("sum", sum), ("min", min), ("max", max)):
                    if name in kept:
                        kept[name] = how((kept[name], e[name]))
                for name in ("levels", "maxima"):
                    if name in kept:
                        kept[name] = {a: kept[name].get(a, 0) + e[name].get(a, 0) for a in kept[name] | e[name]}
                for name, provider in self.providers.items():
                    if name in kept:
                        kept[name] = provider.merge(kept[name], e[name])
                kept["version"] = max(kept["version"], e["version"])
            kept["version"] += 1
            self.near[u][w] = other[u] = kept
            self._push(u, w, kept)

    def root(self, n: int) -> int:
        up = self.parent
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    def live(self):
        for u, others in self.near.items():
            for v, e in others.items():
                if u < v:
                    yield u, v, e


def _edge(row: dict) -> dict:
    """An edge's statistics as the kernel merges them: levels as a count for each affinity."""
    if "levels" in row:
        row["levels"] = {x["a"]: x["n"] for x in row["levels"]}
        row["maxima"] = {max(row["levels"]): 1}
    return row


ROWS = 1 << 16  # of a batch that a task gives
_OUT = "kind string, component long, threshold double, step long, a long, b long, c long, score double, cnt long"
_OUT_ARROW = pa.schema([("kind", pa.string()), ("component", pa.int64()), ("threshold", pa.float64()), ("step", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("score", pa.float64()), ("cnt", pa.int64())])


def exact(stats: DataFrame, thresholds: Sequence[float], score: Score = DEFAULT, queue_bins: int = 0, events: bool = False) -> DataFrame:
    """Merge edges with statistics (u, v, cnt, ...) at score thresholds, lowest first.

    Rows by ``kind``: parent (a = fragment, c = its root at the threshold), merge (step, a
    and b into c at a score), edge (a, b, score and cnt of the graph after the threshold);
    with ``events`` also pop, deleted and stale (step, a, b, score): what the queue gave up
    to be merged, and entries whose edge was gone or had changed.  The result is written
    once, since its parts are read apart.
    """
    order = sorted(float(t) for t in thresholds)
    stats = cut(stats)
    if monotone(score) and order:
        under = stats.where(score.column() < order[-1])
        roots = components(under.select("u", "v"), "u", "v")
        left = roots.select(F.col("node").alias("u"), F.col("root").alias("cu"))
        right = roots.select(F.col("node").alias("v"), F.col("root").alias("cv"))
        grouped = stats.join(left, "u").join(right, "v").where("cu = cv").withColumnRenamed("cu", "component").drop("cv")
    else:
        grouped = stats.withColumn("component", F.lit(0).cast("long"))

    if type(score) is OneMinus and type(score.x) is MeanAffinity and not queue_bins and not events:
        return cut(grouped.select("component", "u", "v", "sum", "cnt").groupBy("component").applyInArrow(_exact_mean(order), _OUT))
    own = {n: PROVIDERS[n] for n in score.needs if n in PROVIDERS}  # registered here, not in the workers

    def run(key, group):
        edges = [_edge(e) for e in group.drop_columns(["component"]).to_pylist()]
        kernel = Kernel(edges, score, queue_bins, events, own)
        comp, rows = key[0].as_py(), []

        def add(kind, threshold, step=None, a=None, b=None, c=None, s=None, cnt=None):
            rows.append({"kind": kind, "component": comp, "threshold": threshold, "step": step, "a": a, "b": b, "c": c, "score": s, "cnt": cnt})

        for t in order:
            for step, a, b, c, s in kernel.until(t):
                add("merge", t, step, a, b, c, s)
            for what, step, a, b, s in kernel.events or ():
                add(what, t, step, a, b, s=s)
            kernel.events = [] if events else None
            for n in kernel.parent:
                add("parent", t, a=n, c=kernel.root(n))
            for u, v, e in kernel.live():
                add("edge", t, a=u, b=v, s=kernel._score(u, v, e), cnt=e["cnt"])
        return pa.Table.from_pylist(rows, schema=_OUT_ARROW)

    return cut(grouped.groupBy("component").applyInArrow(run, _OUT))


def _exact_mean(order: list[float]):
    """The rows of ``exact`` for a mean's component, from arrays and in batches."""

    def rows(kind: str, comp: int, threshold: float, n: int, **own) -> Iterator[pa.RecordBatch]:
        for i in range(0, n, ROWS):
            at = slice(i, min(n, i + ROWS))
            size = at.stop - i
            known = {c: pa.array(f(at)) for c, f in own.items()}
            known |= {"kind": pa.repeat(kind, size), "component": pa.repeat(pa.scalar(comp, pa.int64()), size), "threshold": pa.repeat(threshold, size)}
            yield pa.record_batch([known[f.name] if f.name in known else pa.nulls(size, f.type) for f in _OUT_ARROW], schema=_OUT_ARROW)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp = key[0].as_py()
        u, v, total, count = lazy.columns(batches, {"u": np.int64, "v": np.int64, "sum": np.float64, "cnt": np.int64})
        ids, a, b = lazy.coded(u, v)
        del u, v
        graph = lazy.Graph(len(ids), a, b, total, _narrow(count))
        del a, b, total, count
        step = 0
        for t in order:
            merges = lazy.exact_mean(graph, t)
            while part := list(itertools.islice(merges, ROWS)):
                x, y, s = (np.array(c) for c in zip(*part))
                first, step = step, step + len(part)
                yield from rows("merge", comp, t, len(part), step=lambda at: np.arange(first + at.start, first + at.stop), a=lambda at: ids[x[at]], b=lambda at: ids[y[at]], c=lambda at: ids[x[at]], score=lambda at: s[at])  # noqa: B023
            root = lazy.compressed(graph.parent)
            yield from rows("parent", comp, t, len(ids), a=lambda at: ids[at], c=lambda at: ids[root[at]])  # noqa: B023
            if graph.near:
                graph.freeze()
            a, b, s, n = graph.a, graph.b, graph.total, graph.count
            yield from rows("edge", comp, t, len(a), a=lambda at: ids[a[at]], b=lambda at: ids[b[at]], score=lambda at: 1 - s[at] / n[at], cnt=lambda at: n[at].astype(np.int64))  # noqa: B023

    return run


def merge_history(merged: DataFrame) -> DataFrame:
    """Merges in an order that is valid for all components together."""
    return merged.where("kind = 'merge'").select("component", "threshold", "step", "a", "b", "c", "score")


def parents_of(merged: DataFrame, frags: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """threshold, frag and root of every fragment; those that no merge concerns are their own."""
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    all_ = frags.where("frag <> 0").select("frag").distinct().select(levels, "frag")
    found = merged.where("kind = 'parent'").select("threshold", F.col("a").alias("frag"), F.col("c").alias("root"))
    return all_.join(found, ["threshold", "frag"], "left").select("threshold", "frag", F.coalesce("root", "frag").alias("root"))


def region_graph_after(merged: DataFrame, stats: DataFrame, threshold: float, score: Score = DEFAULT) -> DataFrame:
    """u, v, cnt, score of the contracted graph: inner edges of components and those between them."""
    own = merged.where((F.col("kind") == "edge") & (F.col("threshold") == threshold)).select(F.col("a").alias("u"), F.col("b").alias("v"), "cnt", "score")
    up = merged.where((F.col("kind") == "parent") & (F.col("threshold") == threshold)).select("a", F.col("c").alias("root"), "component")
    ends = stats.join(up.withColumnsRenamed({"a": "u", "root": "ru", "component": "cu"}), "u", "left").join(up.withColumnsRenamed({"a": "v", "root": "rv", "component": "cv"}), "v", "left")
    between = ends.where("cu is null or cv is null or cu <> cv").withColumns({"a": F.coalesce("ru", "u"), "b": F.coalesce("rv", "v")})
    makers = {"sum": F.sum("sum"), "min": F.min("min"), "max": F.max("max")}
    needs = sorted(score.needs - {"cnt", "levels"})
    if not set(needs) <= makers.keys():  # such scores are merged as one component
        return own
    ends = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    merged_between = between.groupBy(*ends).agg(F.sum("cnt").alias("cnt"), *(makers[n].alias(n) for n in needs))
    if "levels" not in score.needs:
        return own.unionByName(merged_between.select("u", "v", "cnt", score.column().alias("score")))
    # counts by affinity: all of them, and with an initial edge's largest only
    each = between.select(*ends, F.explode("levels").alias("x")).groupBy("u", "v", F.col("x.a").alias("a")).agg(F.sum("x.n").alias("n"))
    tops = between.groupBy(*ends, F.array_max("levels")["a"].alias("a")).agg(F.count("*").alias("n"))
    gathered = lambda rows, name: rows.groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias(name))
    both = merged_between.join(gathered(each, "levels"), ["u", "v"]).join(gathered(tops, "maxima"), ["u", "v"])

    def run(batches):  # the column of a score over levels is that of an initial edge
        for batch in batches:
            rows = batch.to_pylist()
            for e in rows:
                e["levels"], e["maxima"] = ({x["a"]: x["n"] for x in e[name]} for name in ("levels", "maxima"))
            scored = pa.array([score.value(e) for e in rows], pa.float64())
            yield pa.record_batch([*(batch.column(c) for c in ("u", "v", "cnt")), scored], names=["u", "v", "cnt", "score"])

    return own.unionByName(both.mapInArrow(run, "u long, v long, cnt long, score double"))


def frozen(edges: DataFrame, threshold_bytes: float) -> DataFrame:
    """node and root: components of edges whose own mean is above the threshold."""
    return components(edges.where(F.col("sum_bytes") / F.col("cnt") > threshold_bytes).select("u", "v"), "u", "v")


def mutual_best(edges: DataFrame, threshold_bytes: float, most_rounds: int = 10_000) -> tuple[DataFrame, int]:
    """frag and root by rounds in which pairs merge that are each other's best (live contact means).

    The best edge of all is each other's best, so every round merges; more than ``most_rounds`` are an error.
    """
    edges = cut(edges.select("u", "v", "sum_bytes", "cnt"))
    up, rounds = None, 0
    while True:
        if rounds >= most_rounds:
            raise RuntimeError(f"edges above the threshold are left after {most_rounds} rounds")
        live = edges.withColumn("m", F.col("sum_bytes") / F.col("cnt")).where(F.col("m") > threshold_bytes)
        ends = live.select(F.explode(F.array("u", "v")).alias("n"), F.struct((-F.col("m")).alias("s"), "u", "v").alias("e"))
        best = ends.groupBy("n").agg(F.min("e").alias("e"))
        pairs = cut(best.groupBy(F.col("e.u").alias("u"), F.col("e.v").alias("v")).count().where("count = 2").select(F.col("v").alias("frag"), F.col("u").alias("root")))
        if pairs.isEmpty():
            break
        rounds += 1
        edges = cut(contract(edges, pairs))
        up = pairs if up is None else up.unionByName(pairs)
        up = cut(up)
    if up is None:
        return edges.select(F.col("u").alias("frag"), F.col("v").alias("root")).limit(0), 0
    nodes = up.select(F.col("frag").alias("node"), F.col("root").alias("parent"))
    return compress(nodes).select(F.col("node").alias("frag"), F.col("parent").alias("root")), rounds


def mutual_best_local(u: np.ndarray, v: np.ndarray, total: np.ndarray, count: np.ndarray, threshold: float) -> dict[int, int]:
    """The same rounds inside one task: frag -> root."""
    ids, a, b = lazy.coded(u, v)
    return dict(zip(ids.tolist(), ids[lazy.mutual_rounds(len(ids), a, b, _narrow(total), _narrow(count), threshold)].tolist()))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in 32 bits where all of them together fit there."""
    return x.astype(np.int32) if x.sum(dtype=np.float64) < 2**31 else x.astype(np.int64)


def _by_component(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges inside components, with ``cu``, dealt by component to a fixed number of tasks.

    A component costs a call however small it is, so partitions joined by their bytes would
    put thousands of calls behind each other.
    """
    left, right = roots.withColumnsRenamed({"node": "u", "root": "cu"}), roots.withColumnsRenamed({"node": "v", "root": "cv"})
    spark = edges.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
    return edges.join(left, "u").join(right, "v").where("cu = cv").repartition(tasks, "cu")


def mutual_best_by_component(edges: DataFrame, threshold_bytes: float) -> DataFrame:
    """frag and root by mutual-best rounds, a task for each component that can merge."""
    edges = cut(edges.select("u", "v", "sum_bytes", "cnt"))
    roots = frozen(edges, threshold_bytes)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, total, count = lazy.columns(batches, {"u": np.int64, "v": np.int64, "sum_bytes": np.int64, "cnt": np.int64})
        ids, a, b = lazy.coded(u, v)
        del u, v
        total, count = _narrow(total), _narrow(count)
        root = lazy.mutual_rounds(len(ids), a, b, total, count, threshold_bytes)
        yield pa.record_batch({"frag": pa.array(ids), "root": pa.array(ids[root])})

    return _by_component(edges, roots).groupBy("cu").applyInArrow(run, "frag long, root long")


# -- (1 + eps) rounds ------------------------------------------------------------------


MOST_LAYERS = 100_000


def hashed_colour(seed: int):
    return lambda node: F.xxhash64(node, F.lit(seed)).bitwiseAND(1)


def hashed_priority(seed: int):
    return lambda blue, red: F.xxhash64(blue, red, F.lit(seed)).bitwiseAND(0x7FFFFFFF)


def propose(edges: DataFrame, nodes: DataFrame, level: float, colour_of, priority_of) -> DataFrame:
    """blue, red, pri, add and size: each blue node's best red among eligible edges.

    ``edges``: u, v, sum_bytes, cnt; ``nodes``: id, size, frozen.  Eligible: mean >= level,
    ends of different colours (1 is red), the red one not frozen and at least as large.
    """
    colour = lambda c: colour_of(F.col(c))
    up = eligible(edges, level).withColumns({"cu": colour("u"), "cv": colour("v")}).where("cu <> cv")
    sides = up.select(F.when(F.col("cu") == 1, F.col("u")).otherwise(F.col("v")).alias("red"), F.when(F.col("cu") == 1, F.col("v")).otherwise(F.col("u")).alias("blue"))
    sized = sides.join(nodes.select(F.col("id").alias("red"), F.col("size").alias("size"), "frozen"), "red").where("not frozen").join(nodes.select(F.col("id").alias("blue"), F.col("size").alias("add")), "blue").where("size >= add")
    pri = priority_of(F.col("blue"), F.col("red"))
    best = sized.groupBy("blue").agg(F.max(F.struct(pri.alias("pri"), "red", "size", "add")).alias("b"))
    return best.select("blue", "b.red", "b.pri", "b.add", "b.size")


def accept(proposals: DataFrame, eps: float) -> DataFrame:
    """frag and root of accepted proposals: per red by falling priority, until its growth passes eps.

    The proposal that passes the cap is taken too.
    """
    before = W.partitionBy("red").orderBy(F.desc("pri"), "blue").rowsBetween(W.unboundedPreceding, -1)
    cap = F.greatest(F.round(F.col("size") * eps), F.lit(1.0 if eps > 0 else 0.0))
    taken = proposals.withColumn("so_far", F.coalesce(F.sum("add").over(before), F.lit(0)))
    return taken.where(F.col("so_far") <= cap).select(F.col("blue").alias("frag"), F.col("red").alias("root"))


def grown(sizes: DataFrame, parents: DataFrame) -> DataFrame:
    """id and size of what is left after ``parents`` (frag, root) are merged, from rows (id, size)."""
    moved = sizes.join(parents.withColumnRenamed("frag", "id"), "id", "left")
    return moved.groupBy(F.coalesce("root", "id").alias("id")).agg(F.sum("size").alias("size"))


def overgrown(sizes: DataFrame, before: DataFrame, eps: float) -> DataFrame:
    """id of nodes that have grown by more than 1 + eps since ``before``: they take no more."""
    return sizes.join(before.withColumnRenamed("size", "_before"), "id").where(F.col("size") > (1 + eps) * F.col("_before")).select("id")


def eligible(edges: DataFrame, level: float) -> DataFrame:
    """Edges whose live mean is at least ``level``."""
    return edges.where(F.col("sum_bytes") / F.col("cnt") >= level)


def largest_mean(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.col("sum_bytes") / F.col("cnt")).alias("largest_mean"))


def rounds(edges: DataFrame, nodes: DataFrame, thresholds_bytes: Sequence[float], eps: float, most_layers: int = MOST_LAYERS, most_outer: int = 64, most_inner: int = 64) -> dict[float, DataFrame]:
    """Parents (frag, root) by threshold from rounds over DataFrames, thresholds falling.

    Layers lower the level from the largest mean by 1 + eps down to the threshold; outer
    rounds draw colours and thaw nodes; inner rounds propose, accept and contract.  State
    is written every inner round; what the driver sees are counts and the largest mean.
    A layer without a merge is tried again with other colours; edges above the threshold
    after ``most_layers`` are an error, so a run never ends with any.
    """
    edges = cut(edges.select("u", "v", "sum_bytes", "cnt"))
    sizes = cut(nodes.select("id", F.lit(1).cast("long").alias("size")))
    up, out, layer = None, {}, 0
    mean = F.col("sum_bytes") / F.col("cnt")
    for t in sorted(thresholds_bytes, reverse=True):
        while True:
            if layer >= most_layers:
                raise RuntimeError(f"edges above the threshold are left after {most_layers} layers")
            most = largest_mean(edges).first()[0]
            if most is None or most <= t:
                break
            level, done = max(most / (1 + eps), t), False
            above = (mean >= level) if level > t else (mean > t)
            for outer in range(most_outer):
                start = sizes
                frozen_ids = None
                for inner in range(most_inner):
                    live = edges.where(above)
                    if live.isEmpty():
                        done = True
                        break
                    marked = sizes.withColumn("frozen", F.lit(False)) if frozen_ids is None else sizes.join(frozen_ids, "id", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
                    taken = cut(accept(propose(live, marked, level, hashed_colour(1 + layer * 1000 + outer), hashed_priority(1 + inner * 100 + outer)), eps))
                    if taken.isEmpty():
                        break
                    up = cut(taken if up is None else up.unionByName(taken))
                    edges = cut(contract(edges, taken))
                    sizes = cut(grown(sizes, taken))
                    frozen_ids = cut(overgrown(sizes, start, eps).withColumn("frozen", F.lit(True)))
                if done:
                    break
            layer += 1
        if up is None:
            out[t] = nodes.select(F.col("id").alias("frag"), F.col("id").alias("root"))
        else:
            done_up = compress(up.select(F.col("frag").alias("node"), F.col("root").alias("parent"))).select(F.col("node").alias("_f"), F.col("parent").alias("_r"))
            out[t] = cut(nodes.join(done_up, F.col("id") == F.col("_f"), "left").select(F.col("id").alias("frag"), F.coalesce("_r", "id").alias("root")))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(28))


def _best(blue: np.ndarray, pri: np.ndarray, red: np.ndarray, n: int) -> np.ndarray:
    """Places of each blue's largest (priority, red), without sorting."""
    at = np.arange(len(blue))
    for x in (pri, red):
        most = np.full(n, -1, x.dtype)
        np.maximum.at(most, blue[at], x[at])
        at = at[x[at] == most[blue[at]]]
    return at


def _by_red(red: np.ndarray, blue: np.ndarray, pri: np.ndarray) -> np.ndarray:
    """The order by red, falling priority (of 31 bits) and blue."""
    key = (red.astype(np.int64) << 31) + ((1 << 31) - 1 - pri)
    order = np.argsort(key)
    if (np.diff(key[order]) == 0).any():  # equal priorities are rare
        order = np.lexsort((blue, key))
    return order


def rounds_local(u: np.ndarray, v: np.ndarray, total: np.ndarray, count: np.ndarray, thresholds: Sequence[float], eps: float) -> dict[float, dict[int, int]]:
    """The same rules inside one task; thresholds in the units of total / count."""
    ids, a, b = lazy.coded(u, v)
    return {t: dict(zip(ids.tolist(), ids[root].tolist())) for t, root in _layers(ids, a, b, _narrow(total), _narrow(count), thresholds, eps)}


def _layers(ids: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray, thresholds: Sequence[float], eps: float) -> Iterator[tuple[float, np.ndarray]]:
    """Each threshold, falling, and the nodes' roots there.  All edges are read and contracted once a layer."""
    n, layer = len(ids), 0
    root, size = np.arange(n, dtype=np.int32), np.ones(n, np.int64)
    for t in sorted(thresholds, reverse=True):
        while len(a):
            mean = total / count
            most = mean.max()
            if most <= t:
                break
            if layer >= MOST_LAYERS:
                raise RuntimeError(f"edges above the threshold are left after {MOST_LAYERS} layers")
            level = max(most / (1 + eps), t)
            live = (mean >= level) if level > t else (mean > t)
            del mean
            up = _layer(ids, a, b, total, count, live, size, level, t, layer, eps)
            if up is not None:
                a, b, total, count = lazy.contracted(up, a, b, total, count)
                root = up[root]
            layer += 1
        yield t, root


def _layer(ids: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray, live: np.ndarray, size: np.ndarray, level: float, t: float, layer: int, eps: float) -> np.ndarray | None:
    """Roots after a layer's rounds, None where nothing merges; ``size`` is kept up to date.

    A mean of parallel edges that are all below the level is below it as well, and nodes only
    merge along live edges, so an edge between two components of live edges never gets live
    in the layer, nor parallel to one that is.  A round therefore costs what is still live:
    each time that has halved, such edges, and nodes without a live one, are left out (all
    edges are contracted after the layer).
    """
    n = len(ids)
    parent = None
    nodes = np.arange(n, dtype=np.int32)  # places of the nodes that are left in
    start, frozen, own = size, np.zeros(n, bool), size
    bound = n_live = np.count_nonzero(live)
    first_time = True
    for outer in range(64):
        if not first_time:
            start, frozen = own.copy(), np.zeros(len(nodes), bool)
        for inner in range(64):
            if not n_live:
                return None if parent is None else lazy.compressed(parent)
            if first_time or 2 * n_live <= bound:
                used = np.zeros(len(nodes), bool)
                used[a[live]] = True
                used[b[live]] = True
                part = local_components(len(nodes), a[live], b[live]).astype(np.int32)
                keep = np.flatnonzero(part[a] == part[b])
                del part
                place = np.cumsum(used, dtype=np.int32) - 1
                a, b, total, count, live = place[a[keep]], place[b[keep]], total[keep], count[keep], live[keep]
                nodes, own, start, frozen = nodes[used], own[used], start[used], frozen[used]
                name, bound = ids[nodes].astype(np.uint64), n_live
                first_time = False
                colour = None
            if inner == 0 or colour is None:
                colour = _mix(name * np.uint64(2654435761) + np.uint64(layer * 1000 + outer)) & np.uint64(1)
            x, y = a[live], b[live]
            apart = colour[x] != colour[y]
            x, y = x[apart], y[apart]
            is_red = colour[x] == 1
            red, blue = np.where(is_red, x, y), np.where(is_red, y, x)
            ok = ~frozen[red] & (own[red] >= own[blue])
            red, blue = red[ok], blue[ok]
            if not len(red):
                break
            pri = (_mix(name[red] * np.uint64(1_000_003) ^ _mix(name[blue] + np.uint64(inner * 100 + outer))) >> np.uint64(33)).astype(np.int64)
            best = _best(blue, pri, red, len(nodes))
            red, blue, pri = red[best], blue[best], pri[best]
            order = _by_red(red, blue, pri)
            red, blue = red[order], blue[order]
            first = np.append(True, red[1:] != red[:-1])
            run = np.cumsum(own[blue]) - own[blue]
            run -= np.repeat(run[first], np.diff(np.append(np.flatnonzero(first), len(red))))
            take = run <= np.maximum(np.floor(own[red] * eps + 0.5), 1 if eps > 0 else 0)
            red, blue = red[take], blue[take]
            if parent is None:
                parent = np.arange(n, dtype=np.int32)
            parent[nodes[blue]] = nodes[red]
            np.add.at(own, red, own[blue])
            size[nodes[red]] = own[red]
            frozen |= own > (1 + eps) * start
            step = np.arange(len(nodes), dtype=np.int32)
            step[blue] = red
            a, b, total, count = lazy.contracted(step, a, b, total, count)
            mean = total / count
            live = (mean >= level) if level > t else (mean > t)
            n_live = np.count_nonzero(live)
    return None if parent is None else lazy.compressed(parent)


def approximate(edges: DataFrame, thresholds_bytes: Sequence[float], eps: float) -> DataFrame:
    """threshold (bytes), frag, root: the rounds' rules, one task for each component that can merge.

    No edge between components ever reaches the lowest threshold, so each component's run is
    a valid schedule of its own; levels are the component's, not the whole graph's.
    """
    lowest = min(thresholds_bytes)
    edges = cut(edges.select("u", "v", "sum_bytes", "cnt"))
    roots = frozen(edges, lowest)
    own = _by_component(edges, roots)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, total, count = lazy.columns(batches, {"u": np.int64, "v": np.int64, "sum_bytes": np.int64, "cnt": np.int64})
        ids, a, b = lazy.coded(u, v)
        del u, v
        total, count = _narrow(total), _narrow(count)
        for t, root in _layers(ids, a, b, total, count, thresholds_bytes, eps):
            for i in range(0, len(ids), ROWS):
                at = slice(i, i + ROWS)
                yield pa.record_batch({"threshold": pa.repeat(float(t), len(ids[at])), "frag": pa.array(ids[at]), "root": pa.array(ids[root[at]])})

    return own.groupBy("cu").applyInArrow(run, "threshold double, frag long, root long")


def violations(edges: DataFrame, parents: DataFrame, threshold_bytes: float) -> DataFrame:
    """Edges of the contracted graph that are still above the threshold; a finished merge has none."""
    return contract_rows(contract(edges, parents)).where(F.col("sum_bytes") / F.col("cnt") > threshold_bytes)


__all__ = ["Kernel", "MeanAffinity", "accept", "approximate", "eligible", "exact", "frozen", "grown", "hashed_colour", "hashed_priority", "largest_mean", "overgrown", "merge_history", "monotone", "mutual_best", "mutual_best_by_component", "mutual_best_local", "parents_of", "propose", "region_graph_after", "rounds", "rounds_local", "violations"]
