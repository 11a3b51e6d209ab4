import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import lattica
from lattica import __main__ as cli
from lattica import session
from lattica.plans import api, arrays
from lattica.schemas import Shape, ShapeError
from lattica.sources import lattice as L
from lattica.sources import zarr
from tests import spec
from tests.test_lattice import partition, random_aff

EXPORTS = "AFF_THRESHOLDS DevBuf affinity_to_scores agglomerate cuda_libs_ready fragments from_torch grade_voi labels_from_fragments missing_cuda_libs region_graph require_cuda_libs resolve_thresholds scores_to_affinity segment segment_d to_torch voi_limits"


def test_exports():
    for name in EXPORTS.split():
        assert name in lattica.__all__ and getattr(lattica, name) is not None
    assert lattica.cuda_libs_ready() and lattica.missing_cuda_libs() == [] and lattica.require_cuda_libs() is None
    assert (api.repo_root() / "lattica" / "plans" / "api.py").is_file()
    with pytest.raises(AttributeError):
        lattica.nothing
    array = np.arange(6).reshape(2, 3)
    assert lattica.from_torch(array) is array
    held = lattica.DevBuf.from_host(array)
    assert held.shape == (2, 3) and held.to_host(4).tolist() == [0, 1, 2, 3] and (np.asarray(held) == array).all()


def test_volumes_that_stay_in_their_frames(spark):
    aff = np.random.default_rng(1).random((3, 3, 4, 4), dtype=np.float32)
    now, later = lattica.segment(aff, [0.3, 0.5], spark=spark), lattica.segment_d(aff, [0.3, 0.5], return_device=True, spark=spark)
    assert all((a == b.to_host()).all() and b.dtype == a.dtype and b.shape == a.shape for a, b in zip(now, later))
    assert all((a == b).all() for a, b in zip(now, lattica.segment_d(aff, [0.3, 0.5], spark=spark)))
    exact, rac = (lattica.segment(aff, [0.3], method=m, spark=spark)[0] for m in ("exact", "rac"))
    assert (exact == rac).all()


def test_array_twins(spark):
    aff = random_aff((4, 5, 6), 16, 5)
    frag = arrays.watershed(aff, 0.1, 0.8)
    assert (frag == spec.watershed(aff.astype(int), 25.5, 204)).all()
    edges = spec.graph(aff, frag.astype(int))
    assert {k: [round(s * 255), n] for k, (s, n, _) in arrays.region_graph(aff, frag).items()} == edges
    nodes = {int(n) for n in np.unique(frag) if n}
    parts = lambda lab: {frozenset(np.unique(frag[lab == r]).tolist()) for r in np.unique(lab) if r}
    for t, lab in arrays.agglomerate_exact(aff, [0.6, 0.2], fragments=frag).items():
        assert parts(lab) == partition(spec.merge(edges, t * 255).items(), nodes)
    for t, lab in arrays.agglomerate_boruvka(aff, [0.6, 0.2], fragments=frag).items():
        left = arrays.region_graph(aff, lab)
        assert all(mean <= t + 1e-9 for *_, mean in left.values())
    assert (arrays.extract(frag, {1: 9}) == np.where(frag == 1, 9, frag)).all()
    assert (arrays.watershed(np.zeros((3, 1, 1, 1))) == 0).all() and arrays.region_graph(np.zeros((3, 2, 2, 2)), np.zeros((2, 2, 2), int)) == {}


@pytest.mark.parametrize("shape", [(5, 9, 7), (8, 8, 8), (1, 1, 3)])
def test_zarr_round_trip(spark, tmp_path, shape):
    aff = random_aff(shape, 16, 5)
    own, size = L.lattice_from_numpy(spark, aff)
    path = str(tmp_path / "aff.zarr")
    zarr.write_lattice(own, size, path, chunk=(4, 4, 4))
    told = json.loads((tmp_path / "aff.zarr" / ".zarray").read_text())
    assert told["shape"] == [3, *shape] and told["chunks"] == [3, 4, 4, 4]
    back, again = zarr.read(spark, path)
    assert again == size and back.exceptAll(own).count() == 0 and own.exceptAll(back).count() == 0
    (tmp_path / "aff.zarr" / "0.0.0.0").unlink()  # what isn't stored is the fill value
    gone = zarr.read(spark, path)[0]
    assert gone.count() == size.cells and gone.where("z < 4 and y < 4 and x < 4").agg(F.max(F.greatest("az", "ay", "ax"))).first()[0] == 0
    labels = own.select("vox", (F.col("vox") + 2**40).alias("label"))
    zarr.write_labels(labels, size, str(tmp_path / "lab.zarr"), chunk=(2, 4, 3))
    found, _ = zarr.read_labels(spark, str(tmp_path / "lab.zarr"))
    assert found.exceptAll(labels).count() == 0 and found.count() == size.cells


def test_zarr_forms(spark, tmp_path):
    import zlib

    aff = np.random.default_rng(2).random((3, 4, 4, 4)).astype("<f4")
    folder = tmp_path / "x.zarr"
    folder.mkdir()
    told = {"zarr_format": 2, "shape": [3, 4, 4, 4], "chunks": [1, 4, 4, 4], "dtype": "<f4", "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "order": "F", "filters": None}
    (folder / ".zarray").write_text(json.dumps(told))
    for c in range(3):
        (folder / f"{c}.0.0.0").write_bytes(zlib.compress(aff[c : c + 1].tobytes(order="F")))
    want, _ = L.lattice_from_numpy(spark, aff)
    got, _ = zarr.read(spark, str(folder))
    assert got.exceptAll(want).count() == 0
    (folder / ".zarray").write_text(json.dumps(told | {"compressor": {"id": "blosc"}}))
    with pytest.raises(ValueError):
        zarr.read(spark, str(folder))
    (folder / ".zarray").write_text(json.dumps(told | {"shape": [2, 4, 4, 4]}))
    with pytest.raises(ShapeError):
        zarr.read(spark, str(folder))


def test_command_line(spark, tmp_path, capsys):
    aff = np.random.default_rng(3).random((3, 4, 5, 6), dtype=np.float32)
    np.save(tmp_path / "aff.npy", aff)
    own, shape = L.read_npy(spark, str(tmp_path / "aff.npy"))
    assert own.exceptAll(L.lattice_from_numpy(spark, aff)[0]).count() == 0 and shape == Shape(4, 5, 6)
    want = lattica.segment(aff, [0.3], spark=spark)[0]
    assert cli.main([str(tmp_path / "aff.npy"), "--out-dir", str(tmp_path / "out"), "--thresholds", "0.3"]) == 0
    assert (np.load(tmp_path / "out" / "labels_thr0.3.npy") == want).all() and "segments" in capsys.readouterr().out
    zarr.write_lattice(own, shape, str(tmp_path / "a.zarr"))
    cli.main([str(tmp_path / "a.zarr"), "--out-dir", str(tmp_path), "--thresholds", "0.7", "--threshold-mode", "score"])
    got, _ = zarr.read_labels(spark, str(tmp_path / "labels_thr0.7.zarr"))
    assert (L.labels_to_numpy(got, shape) == want).all()
    L.write_lattice(own, str(tmp_path / "lattice"), tile=(2, 2, 2))
    cli.main([str(tmp_path / "lattice"), "--out-dir", str(tmp_path), "--thresholds", "0.3", "--shape", "4", "5", "6"])
    assert (L.labels_to_numpy(spark.read.parquet(str(tmp_path / "labels_thr0.3")), shape) == want).all()


def test_sources_of_graphs_and_reports(spark, tmp_path):
    np.savez(tmp_path / "g.npz", keys=np.array([[2, 1], [1, 3]]), stats=np.array([[1.5, 2], [0.5, 1]]))
    assert sorted(map(tuple, L.read_graph_npz(spark, str(tmp_path / "g.npz")).collect())) == [(1, 2, 383, 2), (1, 3, 128, 1)]
    L.write_report({"b": 1, "a": [2]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [2], "b": 1}
    a, b = L.synthetic(spark, Shape(3, 4, 5), 4, 1), L.synthetic(spark, Shape(3, 4, 5), 4, 1).repartition(3)
    assert a.exceptAll(b).count() == 0 and a.count() == 60 and {r[0] for r in a.select("az").distinct().collect()} <= {0, 85, 170, 255}


def test_clusters_need_a_shared_checkpoint_folder(spark):
    assert all(session.LOCAL.fullmatch(m) for m in ("local", "local[8]", "local[*]", "local[2, 3]"))
    assert not any(session.LOCAL.fullmatch(m) for m in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077", "k8s://h"))
