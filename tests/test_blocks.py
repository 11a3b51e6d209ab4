import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import blocks, components, flow, fragments, graph
from lattica.plans import arrays
from lattica.sources import lattice as L
from tests import spec
from tests.test_lattice import random_aff

LOW, HIGH = 0.1 * 255, 0.8 * 255


def volume(frame, shape):
    return L.labels_to_numpy(frame, shape, "frag").astype(int)


@pytest.mark.parametrize("shape,tile", [((9, 7, 11), (4, 3, 5)), ((5, 4, 8), (4, 4, 8)), ((6, 6, 6), (1, 2, 3)), ((3, 13, 4), (32, 32, 32))])
@pytest.mark.parametrize("levels", [2, 4, 32])
def test_blocks_equal_the_sequential_specification(spark, shape, tile, levels):
    aff = random_aff(shape, levels, len(shape) + levels)
    own, size = L.lattice_from_numpy(spark, aff)
    want = spec.watershed(aff.astype(int), LOW, HIGH)
    assert (volume(blocks.watershed(own, size, LOW, HIGH, tile=tile), size) == want).all()
    assert (arrays.watershed(aff, 0.1, 0.8) == want).all()


@pytest.mark.parametrize("more", [{"tie_flip": True}, {"coarse": 85.0}, {"slab": 3}, {"tie_flip": True, "slab": 2}])
def test_blocks_equal_the_relational_operators(spark, more):
    aff = random_aff((7, 6, 5), 4, 3)
    own, size = L.lattice_from_numpy(spark, aff)
    assert (volume(blocks.watershed(own, size, LOW, HIGH, tile=(3, 4, 2), **more), size) == volume(fragments.watershed_relational(own, size, LOW, HIGH, **more), size)).all()


def test_one_plateau_over_all_blocks(spark):
    """All faces alike: no outlet, one fragment; with one brighter face all of it drains there."""
    aff = np.full((3, 6, 6, 6), 100, np.uint8)
    aff[2, 3, 3, 3] = 150
    own, size = L.lattice_from_numpy(spark, aff)
    assert (volume(blocks.watershed(own, size, LOW, HIGH, tile=(2, 2, 2)), size) == spec.watershed(aff.astype(int), LOW, HIGH)).all()
    own, size = L.lattice_from_numpy(spark, np.full((3, 4, 4, 4), 100, np.uint8))
    assert (volume(blocks.watershed(own, size, LOW, HIGH, tile=(2, 2, 2)), size) == 1).all()


def test_nothing_flows(spark):
    own, size = L.lattice_from_numpy(spark, np.zeros((3, 3, 3, 3), np.uint8))
    assert (volume(blocks.watershed(own, size, LOW, HIGH, tile=(2, 2, 2)), size) == 0).all()
    assert blocks.watershed(own.limit(0), size, LOW, HIGH).count() == 0


def test_halo_blocks_give_the_same_flow_as_single_cells(spark):
    aff = random_aff((7, 5, 6), 4, 8)
    own, shape = L.lattice_from_numpy(spark, aff)
    want = {r["vox"]: r["bits"] for r in flow.flow(own, shape, LOW, HIGH).collect()}
    seen = {}
    tile = (3, 2, 4)
    for key, rows in blocks.to_blocks(own, shape, tile).toPandas().groupby("block"):
        block = blocks.Block({c: rows[c].to_numpy() for c in ("z", "y", "x", "az", "ay", "ax")}, int(key), shape, tile, LOW, HIGH, False, None, None)
        for place in block.own:
            assert block.vox[place] not in seen
            seen[block.vox[place]] = block.bits[place]
        near = {int(v): int(b) for v, b, inside in zip(block.vox, block.bits, np.isin(block.vox, rows["vox"])) if inside}
        z, y, x = np.unravel_index(block.vox[block.own], (shape.z, shape.y, shape.x))
        faces = [v for v in near if want.get(v) is not None and min(abs(np.array(np.unravel_index(v, (shape.z, shape.y, shape.x)))[:, None] - np.array([z, y, x])).sum(axis=0)) <= 1]
        assert all(near[v] == want[v] for v in faces)  # the halo's flow too
    assert seen == want


def test_two_phase_components_equal_one_phase(spark):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(5, None), (7, 7), (None, None)], "a long, b long")
    own = lambda f: sorted((r["node"], r["root"]) for r in f.collect())
    assert own(blocks.components_by_block(edges, lambda n: F.floor(n / 50))) == own(components.components(edges))
    assert blocks.components_by_block(edges.limit(0), lambda n: n).count() == 0


def test_cubes_of_several_fragments(spark):
    aff = random_aff((4, 4, 4), 4, 1)
    own, shape = L.lattice_from_numpy(spark, aff)
    frag = spec.watershed(aff.astype(int), LOW, HIGH)
    got = {(r["bz"], r["by"], r["bx"]): r["labels"] for r in blocks.undivided_blocks(L.labels_from_numpy(spark, frag), blocks.block_ids(own)).collect()}
    cubes = {(z, y, x): len(np.unique(frag[2 * z : 2 * z + 2, 2 * y : 2 * y + 2, 2 * x : 2 * x + 2])) for z, y, x in np.ndindex(2, 2, 2)}
    assert got == {k: n for k, n in cubes.items() if n > 1}


def test_contacts_of_any_fragments(spark):
    aff = random_aff((4, 5, 6), 16, 2)
    frag = np.random.default_rng(7).integers(0, 5, (4, 5, 6))
    own, shape = L.lattice_from_numpy(spark, aff)
    got = {(r["u"], r["v"]): [r["sum_bytes"], r["cnt"]] for r in graph.region_graph(own, L.labels_from_numpy(spark, frag), shape).collect()}
    assert got == spec.graph(aff, frag)
    pairs = spark.createDataFrame([(2, 1), (1, 2), (1, 99), (None, 1)], "a long, b long")
    found = {(r["a"], r["b"]): r["cnt"] for r in graph.find_edge(graph.region_graph(own, L.labels_from_numpy(spark, frag), shape), pairs).collect()}
    assert found == {(2, 1): got[1, 2][1], (1, 2): got[1, 2][1], (1, 99): None, (None, 1): None}


@pytest.mark.parametrize("kind", ["near", "any", "hub"])
def test_components_of_many_pieces_equal_those_of_one(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 3000, 2600)
    b = {"near": a + rng.integers(0, 3, len(a)), "any": rng.integers(0, 3000, len(a)), "hub": np.where(rng.random(len(a)) < 0.5, 1500, a + 1)}[kind]
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    root = components.local_components(6000, a, b)
    want = sorted((n, int(root[n])) for n in set(a[a != b].tolist()) | set(b[a != b].tolist()))
    own = lambda: sorted((r["node"], r["root"]) for r in components.components(edges).collect())
    assert own() == want
    steps, stars = [], components._stars
    monkeypatch.setattr(components, "PIECE", 100)
    monkeypatch.setattr(components, "_stars", lambda *x: steps.append(1) or stars(*x))
    assert own() == want
    assert kind != "near" or not steps  # near numbers never need steps over the whole graph


def test_small_plateaus_share_a_group(spark, monkeypatch):
    """Each group costs a call of the worker: plateaus are dealt by buckets, and divided as they are one by one."""
    roots = spark.range(5000).select(F.col("id").alias("root"))
    assert roots.select(fragments.bucket(5000)).distinct().count() == 1
    aff = random_aff((9, 8, 10), 3, 4)
    own, size = L.lattice_from_numpy(spark, aff)
    monkeypatch.setattr(fragments, "PIECE", 50)
    assert 1 < roots.select(fragments.bucket(500)).distinct().count() <= 10
    want = spec.watershed(aff.astype(int), LOW, HIGH)
    assert (volume(blocks.watershed(own, size, LOW, HIGH, tile=(2, 3, 2)), size) == want).all()
    assert (volume(fragments.watershed_relational(own, size, LOW, HIGH), size) == want).all()


def test_basins_read_the_division_once(spark, monkeypatch):
    aff = random_aff((4, 5, 6), 4, 2)
    own, size = L.lattice_from_numpy(spark, aff)
    plans, found = [], fragments.components
    monkeypatch.setattr(fragments, "components", lambda edges: plans.append(edges._jdf.queryExecution().toString()) or found(edges))
    got = volume(fragments.watershed_relational(own, size, LOW, HIGH), size)
    assert len(plans) == 2 and not any("FlatMapGroupsInArrow" in p for p in plans)
    assert (got == spec.watershed(aff.astype(int), LOW, HIGH)).all()
