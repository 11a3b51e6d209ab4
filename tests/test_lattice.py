import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import affinity, scores, thresholds
from lattica.operators import fragments, geometry, graph, lazy, merge, metrics
from lattica.plans import api
from lattica.schemas import Shape, ShapeError
from lattica.sources import lattice as L
from tests import spec

LOW, HIGH = affinity.LOW * 255, affinity.HIGH * 255


def frags_of(spark, aff, low=LOW, high=HIGH):
    own, shape = L.lattice_from_numpy(spark, aff)
    return L.labels_to_numpy(fragments.watershed(own, shape, low, high), shape, "frag").astype(int)


def random_aff(shape, levels, seed):
    return (np.random.default_rng(seed).integers(0, levels, (3, *shape)) * (255 // (levels - 1))).astype(np.uint8)


def test_quantise_is_half_even_in_float32(spark):
    rows = spark.createDataFrame([(a,) for a in (0.1, 0.25, 0.3, 0.5, 0.7, 0.9, -0.1, 1.2)], "a float")
    assert [r[0] for r in rows.select(affinity.quantise(F.col("a"))).collect()] == [26, 64, 76, 128, 178, 230, 0, 255]


def test_thresholds():
    assert thresholds.resolve_thresholds([0.7], "score") == pytest.approx([0.3])
    assert thresholds.affinity_to_scores([0.2, 0.5]) == pytest.approx([0.8, 0.5])
    with pytest.raises(ValueError, match="threshold_mode"):
        thresholds.resolve_thresholds([0.1], "guess")
    assert (thresholds.resolve_eps([0.3]), thresholds.resolve_eps([0.2, 0.3]), thresholds.resolve_eps([0.3], 0.1)) == (0.40, 0.08, 0.1)
    split, merge_ = thresholds.voi_limits()[0.3]
    assert thresholds.grade_voi(split, merge_, 0.3)[0] and not thresholds.grade_voi(split + 1e-6, merge_, 0.3)[0]


@pytest.mark.parametrize("shape,levels,seed", [((6, 6, 6), 2, 0), ((5, 4, 8), 3, 1), ((4, 7, 5), 8, 2)])
def test_watershed_equals_the_sequential_specification(spark, shape, levels, seed):
    aff = random_aff(shape, levels, seed)
    low, high = 0.1 * 255, 0.8 * 255
    assert (frags_of(spark, aff, low, high) == spec.watershed(aff.astype(int), low, high)).all()


def test_small_cases(spark):
    assert frags_of(spark, np.zeros((3, 1, 1, 1), np.float32)).tolist() == [[[0]]]
    pairs = np.zeros((3, 1, 1, 4), np.float32)
    pairs[2, 0, 0] = [0, 0.9, 0.25, 0.9]
    assert frags_of(spark, pairs).reshape(-1).tolist() == [1, 1, 2, 2]
    got = api.region_graph(pairs, frags_of(spark, pairs), spark=spark)
    assert got["count"].tolist() == [1] and got["mean"][0] == pytest.approx(64 / 255)
    for t, n in ((0.2, 1), (0.3, 2)):
        assert len(np.unique(api.segment(pairs, [t], spark=spark)[0])) == n
    assert np.unique(frags_of(spark, np.ones((3, 2, 2, 2), np.float32))).tolist() == [1]


def test_shape_errors(spark):
    with pytest.raises(ShapeError, match=r"\[3,Z,Y,X\]"):
        api.segment(np.zeros((2, 4, 4, 4)), [0.3], spark=spark)
    with pytest.raises(ShapeError):
        api.region_graph(np.zeros((3, 2, 2, 2)), np.zeros((2, 2, 3)), spark=spark)


def test_region_graph_equals_the_specification(spark):
    aff = random_aff((5, 5, 5), 8, 4)
    frag = np.random.default_rng(5).integers(0, 6, (5, 5, 5))
    got = api.region_graph(aff, frag, spark=spark)
    want = spec.graph(aff, frag)
    assert {(int(u), int(v)): [round(s * 255), int(n)] for u, v, s, n in zip(got["u"], got["v"], got["sum"], got["count"])} == want


def edges_frame(spark, edges):
    return spark.createDataFrame([(u, v, s, n) for (u, v), (s, n) in edges.items()], "u long, v long, sum_bytes long, cnt long")


def partition(pairs, nodes):
    roots = dict(pairs)

    def find(n):
        while roots.get(n, n) != n:
            n = roots[n]
        return n

    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(v) for v in out.values()}


@pytest.fixture(scope="module")
def graph_case():
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(p)) for p in rng.integers(1, 25, (70, 2)).tolist() if p[0] != p[1]}
    return {p: [int(rng.integers(0, 256)) * (n := int(rng.integers(1, 5))), n] for p in sorted(pairs)}


def test_exact_merge_equals_the_global_scan(spark, graph_case):
    frame, nodes = edges_frame(spark, graph_case), {n for p in graph_case for n in p}
    stats = frame.select("u", "v", "cnt", F.col("sum_bytes").cast("double").alias("sum"))
    stats = stats.withColumn("sum", F.col("sum") / 255)
    merged = merge.exact(stats, [0.35, 0.5])
    for score in (0.35, 0.5):
        own = [(r["a"], r["c"]) for r in merged.where((F.col("kind") == "parent") & (F.col("threshold") == score)).collect()]
        assert partition(own, nodes) == partition(spec.merge(graph_case, (1 - score) * 255).items(), nodes)
    history = merge.merge_history(merged).collect()
    assert all(r["c"] == min(r["a"], r["b"]) and r["score"] < r["threshold"] for r in history)


def test_all_merge_rules_leave_no_edge_above_the_threshold(spark, graph_case):
    graph_case = {p: e for p, e in graph_case.items() if p[1] < 11}
    frame, nodes = edges_frame(spark, graph_case).cache(), sorted({n for p in graph_case for n in p})
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    rounds, local = partition(map(tuple, merge.mutual_best(frame, 140.0)[0].collect()), nodes), partition(map(tuple, merge.mutual_best_by_component(frame, 140.0).collect()), nodes)
    assert rounds == local
    for up in (merge.approximate(frame, [140.0], 0.08).select("frag", "root"), merge.mutual_best_by_component(frame, 140.0), merge.rounds(frame, ids, [140.0], 0.4)[140.0]):
        assert merge.violations(frame, up, 140.0).count() == 0


def test_dirty_contraction_is_contraction(spark, graph_case):
    frame = edges_frame(spark, graph_case)
    up = spark.createDataFrame([(n, n - n % 5 or 1) for n in range(1, 25) if n % 3], "frag long, root long")
    fixed = up.join(up.select(F.col("frag").alias("root"), F.lit(1).alias("k")), "root", "left").where("k is null or frag = root").select("frag", "root")
    assert sorted(graph.contract(frame, fixed).collect()) == sorted(graph.contract_dirty(frame, fixed).select("u", "v", "sum_bytes", "cnt").collect())


def test_scores_parse_and_agree_between_column_and_kernel(spark):
    rows = [(1, 2, a) for a in (10, 200, 30, 255)] + [(1, 3, a) for a in (0, 100)]
    contacts = spark.createDataFrame(rows, "u long, v long, aff int")
    sizes = spark.createDataFrame([(1, 4), (2, 2), (3, 7)], "frag long, size long")
    for text in (
        "OneMinus<MeanAffinity<G, V>>", "Divide<Multiply<MinSize<G>, MaxAffinity<G, V>>, ContactArea<G>>", "Square<Subtract<MaxSize<G>, MinAffinity<G>>>",
        "QuantileAffinity<G, 75, V, false>", "HistogramQuantileAffinity<G, 50, V, 16, 0>", "MeanMaxKAffinity<G, 2, V>", "Step<MeanAffinity<G>, Constant<0.5>>", "Invert<Add<ContactArea<G>, Constant<1>>>",
    ):
        score = scores.parse(text)
        stats = {(r["u"], r["v"]): r.asDict(True) for r in graph.statistics(contacts, {"cnt", "sum", "min", "max", "levels", "size_u", "size_v"}, sizes).collect()}
        for r in graph.scored(contacts, score, sizes).collect():
            assert r["score"] == pytest.approx(score.value(merge._edge(stats[r["u"], r["v"]]))), text
    with pytest.raises(ValueError):
        scores.parse("Nothing<At>")


def test_metrics_golden_values(spark):
    np.random.seed(0)
    seg = np.random.randint(500, size=(3, 3, 3))
    gt = np.random.randint(500, size=(3, 3, 3))
    got = api.evaluate(seg, gt, spark=spark)
    want = {"rand_split": 0.8181818181818182, "rand_merge": 0.8709677419354839, "voi_split": 0.2222222222222223, "voi_merge": 0.1481481481481479}
    assert got == pytest.approx(want, abs=1e-12)
    half = api.evaluate(np.array([[[1, 2, 3, 3]]]), np.array([[[1, 1, 2, 2]]]), spark=spark)
    assert (half["voi_split"], half["voi_merge"]) == pytest.approx((0.5, 0.0))
    none = metrics.evaluate(spark.createDataFrame([(1, 0)], "seg long, gt long")).first()
    assert (none["voi_split"], none["rand_split"]) == (0.0, None)


def test_mirror_twice_restores_all_but_the_seam(spark):
    aff = np.random.default_rng(3).integers(1, 255, (3, 4, 5, 6)).astype(np.uint8)
    own, shape = L.lattice_from_numpy(spark, aff)
    for axis in range(3):
        flipped = np.flip(aff, axis + 1)
        want = flipped.copy()
        want[axis] = np.roll(flipped[axis], 1, axis)
        want[(axis, *[0 if a == axis else slice(None) for a in range(3)])] = 0
        got = geometry.mirror(own, shape, axis).orderBy("vox").toArrow()
        assert all((got.column(c).to_numpy().reshape(4, 5, 6) == want[i]).all() for i, c in enumerate(("az", "ay", "ax")))
    big, size = geometry.tile(own, shape, (2, 1, 2))
    assert size == Shape(8, 5, 12) and big.select("vox").distinct().count() == size.cells
    assert geometry.crop(big, (0, 0, 0), (4, 5, 6))[0].exceptAll(own).count() == 0


def test_segment_is_deterministic_and_modes_agree(spark):
    aff = np.random.default_rng(1).random((3, 3, 6, 6), dtype=np.float32)
    first, again = api.segment(aff, [0.3], spark=spark)[0], api.segment(aff, [0.7], threshold_mode="score", spark=spark)[0]
    assert (spec.canonical(first) == spec.canonical(again)).all()
    frag = api.fragments(aff, spark=spark)
    assert (spec.canonical(api.labels_from_fragments(aff, frag, [0.3], spark=spark)[0]) == spec.canonical(first)).all()


def test_score_generator_gives_snapshots(spark):
    aff = random_aff((3, 4, 4), 8, 6)
    frag = spec.watershed(aff.astype(int), LOW, HIGH)
    got = list(api.agglomerate_scores(aff, [0.6, 0.2], gt=frag, frags=frag, return_merge_history=True, return_region_graph=True, spark=spark))
    fine, rough = got[0][0], got[1][0]
    assert len(np.unique(rough)) <= len(np.unique(fine)) and set(got[0][1]) == {"rand_split", "rand_merge", "voi_split", "voi_merge"}
    edges = spec.graph(aff, frag)
    nodes = {int(n) for n in np.unique(frag) if n}
    want = partition(spec.merge(edges, 0.4 * 255).items(), nodes)
    have = {}
    for f, r in set(zip(frag.reshape(-1).tolist(), rough.reshape(-1).tolist())):
        have.setdefault(r, set()).add(f)
    assert {frozenset(v) for k, v in have.items() if k} == want


def levels(values):
    return [(v, values.count(v)) for v in sorted(set(values))]


def test_mean_of_largest_merges_over_the_whole_graph(spark):
    score = scores.parse("OneMinus<MeanMaxKAffinity<G, 3, V>>")
    values = {(1, 2): [0.95], (1, 3): [0.9, 0.1, 0.1], (2, 3): [0.9, 0.1, 0.1]}
    stats = spark.createDataFrame([(u, v, len(x), levels(x)) for (u, v), x in values.items()], "u long, v long, cnt long, levels array<struct<a:double,n:long>>")
    roots = {r["a"]: r["c"] for r in merge.exact(stats, [0.5], score).where("kind = 'parent'").collect()}
    assert roots == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("text", ["OneMinus<MinAffinity<G, V>>", "OneMinus<MaxAffinity<G, V>>", "OneMinus<QuantileAffinity<G, 50, V, true>>", "OneMinus<QuantileAffinity<G, 50, V, false>>", "OneMinus<MeanAffinity<G, V>>", "OneMinus<HistogramQuantileAffinity<G, 50, V, 16, 0>>"])
def test_region_graph_has_edges_between_components_for_every_score(spark, text):
    score = scores.parse(text)
    values = {(1, 2): [0.9, 0.95], (3, 4): [0.8, 0.9], (1, 3): [0.1, 0.3], (2, 4): [0.2], (4, 5): [0.4, 0.05, 0.1]}
    rows = [(u, v, len(x), sum(x), min(x), max(x), levels(x)) for (u, v), x in values.items()]
    stats = spark.createDataFrame(rows, "u long, v long, cnt long, sum double, min double, max double, levels array<struct<a:double,n:long>>").select("u", "v", *sorted(score.needs | {"cnt"}))
    kernel = merge.Kernel([merge._edge({"u": u, "v": v, "cnt": n, "sum": s, "min": a, "max": b, "levels": [{"a": p, "n": q} for p, q in x]}) for u, v, n, s, a, b, x in rows], score)
    list(kernel.until(0.5))
    want = sorted((u, v, e["cnt"], round(kernel._score(u, v, e), 9)) for u, v, e in kernel.live())
    got = merge.region_graph_after(merge.exact(stats, [0.5], score), stats, 0.5, score).collect()
    assert len(want) == 2 and sorted((r["u"], r["v"], r["cnt"], round(r["score"], 9)) for r in got) == want


def sorted_values(values, q):
    own = sorted(values)
    return own[min(len(own) - 1, q * len(own) // 100)]


@pytest.mark.parametrize("seed", range(3))
def test_level_statistics_equal_those_of_all_values(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(1, int(v), int(a)) for v, a in zip(rng.integers(2, 6, 200), rng.choice([0, 3, 90, 91, 200, 255], 200))]
    contacts = spark.createDataFrame(rows, "u long, v long, aff int")
    of = {v: [a / 255 for _, w, a in rows if w == v] for v in range(2, 6)}
    for q in (0, 10, 50, 99, 100):
        got = {r["v"]: r["score"] for r in graph.scored(contacts, scores.QuantileAffinity(q, False)).collect()}
        assert got == pytest.approx({v: sorted_values(x, q) for v, x in of.items()})
    for k in (1, 3, 500):
        got = {r["v"]: r["score"] for r in graph.scored(contacts, scores.MeanMaxKAffinity(k)).collect()}
        assert got == pytest.approx({v: np.mean(sorted(x)[-k:]) for v, x in of.items()})


def live_scores(kernel):
    return [kernel._score(u, v, e) for u, v, e in kernel.live()]


@pytest.mark.parametrize("bins", [0, 1, 2, 16, 256])
def test_any_thresholds_merge_all_that_is_below_the_last(graph_case, bins):
    edges = lambda: [{"u": u, "v": v, "sum": s / 255, "cnt": n} for (u, v), (s, n) in graph_case.items()]
    for steps in ([0.3], [0.05, 0.3], [0.0, 0.1, 0.2, 0.299, 0.3], [0.3, 0.6, 1.0, 2.0]):
        kernel, nodes = merge.Kernel(edges(), scores.DEFAULT, bins), {n for p in graph_case for n in p}
        for t in steps:
            for _, a, b, c, s in kernel.until(t):
                assert s < t and c == min(a, b)
            assert all(s >= t for s in live_scores(kernel))
        if not bins:
            assert partition(kernel.parent.items(), nodes) == partition(spec.merge(graph_case, (1 - steps[-1]) * 255).items(), nodes)
    pair = merge.Kernel([{"u": 1, "v": 2, "sum": 0.9, "cnt": 1}, {"u": 3, "v": 4, "sum": 0.1, "cnt": 1}], scores.DEFAULT, 2)
    assert [len(list(pair.until(t))) for t in (0.05, 0.3)] == [0, 1]


def test_queue_events(spark, graph_case):
    stats = edges_frame(spark, graph_case).select("u", "v", "cnt", (F.col("sum_bytes") / 255.0).alias("sum"))
    rows = merge.exact(stats, [0.3, 0.6], events=True).collect()
    n = {k: sum(r["kind"] == k for r in rows) for k in ("merge", "pop", "deleted", "stale")}
    assert n["pop"] == n["merge"] > 0 and n["deleted"] + n["stale"] > 0
    assert {(r["component"], r["step"], r["a"], r["b"]) for r in rows if r["kind"] == "pop"} == {(r["component"], r["step"], r["a"], r["b"]) for r in rows if r["kind"] == "merge"}


def test_own_statistics_are_merged(spark):
    score = scores.provide(scores.Provider("span", lambda a: F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")), lambda x, y: {"lo": min(x["lo"], y["lo"]), "hi": max(x["hi"], y["hi"])}))

    class Width(scores.Score):
        needs, between = score.needs, False

        def column(self):
            return 1 - (F.col("span.hi") - F.col("span.lo"))

        def value(self, s):
            return 1 - (s["span"]["hi"] - s["span"]["lo"])

    contacts = spark.createDataFrame([(1, 2, 0), (1, 2, 255), (1, 3, 0), (2, 3, 200)], "u long, v long, aff int")
    stats = graph.statistics(contacts, {"span", "cnt", "levels"})
    assert {(r["u"], r["v"]): (r["span"]["hi"], r["cnt"]) for r in stats.collect()} == {(1, 2): (1.0, 2), (1, 3): (0.0, 1), (2, 3): (pytest.approx(200 / 255), 1)}
    roots = {r["a"]: r["c"] for r in merge.exact(stats.drop("levels"), [0.5], Width()).where("kind = 'parent'").collect()}
    assert roots == {1: 1, 2: 1, 3: 1}  # 1 and 2 first; then their edges to 3 span enough together
    with pytest.raises(ValueError):
        scores.provide(scores.Provider("cnt", F.count, max))
    del scores.PROVIDERS["span"]


def best_rounds(edges, threshold):
    """Mutual-best rounds as they are defined, over all edges each time."""
    edges, up = {k: list(x) for k, x in edges.items()}, {}
    while True:
        best = {}
        for (u, v), (s, c) in edges.items():
            if s / c > threshold:
                for n in (u, v):
                    best[n] = min(best.get(n, (0.0, 0, 0)), (-s / c, u, v))
        pairs = {e[2]: e[1] for e in best.values() if best[e[1]] == best[e[2]] == e}
        if not pairs:
            return up
        up |= pairs
        moved = {}
        for (u, v), (s, c) in edges.items():
            a, b = sorted((pairs.get(u, u), pairs.get(v, v)))
            if a != b:
                s0, c0 = moved.get((a, b), (0, 0))
                moved[a, b] = [s + s0, c + c0]
        edges = moved


@pytest.mark.parametrize("levels,few", [(2, 0.01), (3, 0.0), (4, 1.0), (16, 0.1)])
def test_mutual_rounds_that_look_at_changes_only_equal_those_over_all_edges(levels, few):
    rng = np.random.default_rng(levels)
    u = np.repeat(np.arange(1, 301), 3)
    v = u + rng.integers(1, 9, len(u))
    edges = {(int(a), int(b)): [int(rng.integers(0, levels)) * 255 // (levels - 1), 1] for a, b in zip(u, v)}
    up = best_rounds(edges, 127.5)
    a, b, s, c = (np.array(x) for x in zip(*((a, b, s, c) for (a, b), (s, c) in edges.items())))
    ids, x, y = lazy.coded(a, b)
    root = ids[lazy.mutual_rounds(len(ids), x, y, s, c, 127.5, few)]
    for n, r in zip(ids.tolist(), root.tolist()):
        while n in up:
            n = up[n]
        assert n == r


def test_rounds_of_a_long_chain_cost_what_changes(monkeypatch):
    n = 4000  # a chain of rising means merges by one pair in each round
    a, s = np.arange(n, dtype=np.int32), np.arange(n) + 1_000_000
    passes, bests = [], lazy.bests
    monkeypatch.setattr(lazy, "bests", lambda *x: passes.append(1) or bests(*x))
    root = lazy.mutual_rounds(n + 1, a, a + 1, s, np.ones(n, np.int64), 0.0)
    assert (root == 0).all() and len(passes) < 20


@pytest.mark.parametrize("held,window", [(3_000_000, 2_000_000), (40, 30), (200, 1)])
def test_exact_merging_by_arrays_equals_the_kernel_in_every_bit(monkeypatch, held, window):
    monkeypatch.setattr(lazy, "HELD", held)
    rng = np.random.default_rng(held)
    u = np.repeat(np.arange(1, 301), 4)
    edges = {(int(a), int(b)): (int(rng.integers(0, 7)) * 85 / 255.0, int(rng.integers(2, 4))) for a, b in zip(u, u + rng.integers(1, 12, len(u)))}
    kernel = merge.Kernel([{"u": a, "v": b, "sum": s, "cnt": c} for (a, b), (s, c) in edges.items()], scores.DEFAULT)
    a, b, s, c = (np.array(x) for x in zip(*((a, b, s, c) for (a, b), (s, c) in edges.items())))
    ids, x, y = lazy.coded(b, a)  # either way round
    g = lazy.Graph(len(ids), x, y, s, c)
    for t in (0.3, 0.5):
        want = [(a, b, s) for _, a, b, _, s in kernel.until(t)]
        assert [(int(ids[a]), int(ids[b]), s) for a, b, s in lazy.exact_mean(g, t, window)] == want and want
        assert g.held <= max(held, 0) + 200  # no more than a bound is held as dicts
        g.freeze()
        assert sorted(zip(ids[g.a].tolist(), ids[g.b].tolist(), g.total.tolist(), g.count.tolist())) == sorted((a, b, e["sum"], e["cnt"]) for a, b, e in kernel.live())


def plain_rounds(u, v, total, count, thresholds, eps):
    """The rules of ``rounds_local`` over all nodes and edges in every round."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, n = at[: len(u)], at[len(u) :], len(ids)
    parent, size, out, layer = np.arange(n), np.ones(n, np.int64), {}, 0
    for t in sorted(thresholds, reverse=True):
        while len(a) and (total / count).max() > t:
            level = max((total / count).max() / (1 + eps), t)
            for outer in range(64):
                colour = merge._mix(ids.astype(np.uint64) * np.uint64(2654435761) + np.uint64(layer * 1000 + outer)) & np.uint64(1)
                start, left = size.copy(), False
                for inner in range(64):
                    mean = total / count
                    live = (mean >= level) if level > t else (mean > t)
                    left = bool(live.any())
                    best = {}
                    for x, y in zip(a[live].tolist(), b[live].tolist()):
                        red, blue = (x, y) if colour[x] == 1 else (y, x)
                        if colour[x] != colour[y] and size[red] <= (1 + eps) * start[red] and size[red] >= size[blue]:
                            pri = int(merge._mix(ids[[red]].astype(np.uint64) * np.uint64(1_000_003) ^ merge._mix(ids[[blue]].astype(np.uint64) + np.uint64(inner * 100 + outer)))[0] >> np.uint64(33))
                            best[blue] = max(best.get(blue, (-1, -1)), (pri, red))
                    if not best:
                        break
                    cap = np.maximum(np.floor(size * eps + 0.5), 1)
                    grown, step, so_far = size.copy(), np.arange(n), {}
                    for blue, (pri, red) in sorted(best.items(), key=lambda x: (x[1][1], -x[1][0], x[0])):
                        if so_far.get(red, 0) <= cap[red]:
                            step[blue], parent[blue] = red, red
                            grown[red] += size[blue]
                        so_far[red] = so_far.get(red, 0) + size[blue]
                    size = grown
                    a, b, total, count = lazy.summed(step[a], step[b], total, count, n)
                if not left:
                    break
            layer += 1
        out[t] = dict(zip(ids.tolist(), ids[lazy.compressed(parent.copy())].tolist()))
    return out


@pytest.mark.parametrize("levels,eps", [(4, 0.08), (4, 0.5), (200, 0.08)])
def test_rounds_over_what_is_live_equal_those_over_all_edges(levels, eps):
    rng = np.random.default_rng(levels)
    pairs = np.unique(np.sort(rng.integers(0, 300, (900, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]] * 3 + 1
    count = rng.integers(1, 4, len(pairs))
    total = rng.integers(0, levels, len(pairs)) * (255 // (levels - 1)) * count
    own = pairs[:, 0], pairs[:, 1], total, count
    assert merge.rounds_local(*own, [170.0, 127.5, 80.0], eps) == plain_rounds(*own, [170.0, 127.5, 80.0], eps)


def test_a_round_costs_what_is_live(monkeypatch):
    """A long tail of rounds over few edges beside many that are below the level."""
    rng = np.random.default_rng(1)
    few = np.unique(np.sort(rng.integers(0, 3000, (9000, 2)), axis=1), axis=0)
    few = few[few[:, 0] < few[:, 1]]
    low = rng.integers(3000, 60_000, 150_000)
    u, v = np.append(few[:, 0], low), np.append(few[:, 1], low + rng.integers(1, 9, len(low)))
    total = np.append(rng.integers(0, 4, len(few)) * 85, np.full(len(low), 50))
    sorted_, summed = [], lazy.summed
    monkeypatch.setattr(lazy, "summed", lambda a, *x: sorted_.append(len(a)) or summed(a, *x))
    merge.rounds_local(u, v, total, np.ones(len(u), np.int64), [100.0], 0.08)
    assert len(sorted_) > 20 and len(few) < sum(sorted_) < len(u)


def test_components_are_dealt_over_the_tasks(spark):
    pairs = spark.range(2000).select((F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v"), F.lit(200).cast("long").alias("sum_bytes"), F.lit(1).cast("long").alias("cnt"))
    found = merge.approximate(pairs, [127.5], 0.08)
    assert found.withColumn("task", F.spark_partition_id()).groupBy("task").count().where("count > 0").count() >= 8
    assert found.select("root").distinct().count() == 2000 and found.count() == 4000


def test_edges_between_live_components_are_left_out_of_a_round(monkeypatch):
    """Two clusters of live edges with many low ones between them: only the layer's end reads those."""
    rng = np.random.default_rng(2)
    inner = np.unique(np.sort(rng.integers(0, 500, (2000, 2)), axis=1), axis=0)
    inner = inner[inner[:, 0] < inner[:, 1]]
    across = np.unique(np.stack([rng.integers(0, 500, 60_000), rng.integers(500, 1000, 60_000)], axis=1), axis=0)
    pairs = np.concatenate([inner, inner + 500, across])
    total = np.append(rng.integers(2, 4, 2 * len(inner)) * 85, np.full(len(across), 50))
    own = pairs[:, 0], pairs[:, 1], total, np.ones(len(pairs), np.int64)
    read, contracted = [], lazy.contracted
    monkeypatch.setattr(lazy, "contracted", lambda step, a, *x: read.append(len(a)) or contracted(step, a, *x))
    found = merge.rounds_local(*own, [100.0], 0.08)
    assert sum(n > 2 * len(inner) for n in read) <= 4 and len(read) > 20
    assert found == plain_rounds(*own, [100.0], 0.08)


def test_proposals_in_order_with_equal_priorities():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0)
    blue, red, pri = pairs[:, 0], pairs[:, 1], rng.integers(0, 3, len(pairs)) * ((1 << 30) - 1)
    best = merge._best(blue, pri, red, 60)
    order = merge._by_red(red[best], blue[best], pri[best])
    want = {}
    for b, r, p in zip(blue.tolist(), red.tolist(), pri.tolist()):
        want[b] = max(want.get(b, (-1, -1)), (p, r))
    assert list(zip(red[best][order].tolist(), blue[best][order].tolist())) == [(r, b) for r, p, b in sorted(((r, p, b) for b, (p, r) in want.items()), key=lambda x: (x[0], -x[1], x[2]))]


@pytest.mark.parametrize("ids", [np.arange(5, 400), np.arange(5, 400) * 10**14 - 10**16, np.array([-(2**63), 7, 2**63 - 1])])
def test_close_and_far_ids_are_coded_alike(ids):
    rng = np.random.default_rng(4)
    u, v = ids[rng.integers(0, len(ids), 900)], ids[rng.integers(0, len(ids), 900)]
    names, a, b = lazy.coded(u, v)
    assert names.tolist() == sorted({*u.tolist(), *v.tolist()})
    assert (names[a] == np.minimum(u, v)).all() and (names[b] == np.maximum(u, v)).all() and a.dtype == b.dtype == np.int32


def test_columns_of_a_group_are_held_once():
    """Many small batches: no list of pieces beside the arrays that they make."""
    import tracemalloc

    import pyarrow as pa

    def batches():
        for i in range(1000):
            yield pa.record_batch({"u": pa.array(np.arange(i * 2048, i * 2048 + 2048))})

    tracemalloc.start()
    (u,) = lazy.columns(batches(), {"u": np.int64})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (u == np.arange(1000 * 2048)).all() and peak < 1.6 * u.nbytes
    assert [len(x) for x in lazy.columns([], {"u": np.int64, "cnt": np.float64})] == [0, 0]
