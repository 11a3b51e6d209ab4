"""Segment a volume: ``python -m lattica INPUT --out-dir DIR --thresholds T ... --dataset NAME``.

INPUT is a parquet lattice (with --shape), a .zarr folder, or a .npy or .h5 file of affinities
[3,Z,Y,X].  Labels go to ``labels_thrT.*`` in the form of the input: parquet, zarr, npy or h5.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.functions.thresholds import AFF_THRESHOLDS, resolve_thresholds
from lattica.plans.api import segment_frames
from lattica.schemas import Shape
from lattica.session import cut, prepare
from lattica.sources import lattice as L
from lattica.sources import zarr


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lattica", description=__doc__.split("\n")[0])
    p.add_argument("input")
    p.add_argument("--out-dir", default=".")
    p.add_argument("--thresholds", nargs="+", type=float, default=list(AFF_THRESHOLDS))
    p.add_argument("--threshold-mode", default="affinity", choices=("affinity", "score"))
    p.add_argument("--dataset", default="affinity")
    p.add_argument("--eps", type=float)
    p.add_argument("--method", default="approximate", choices=("approximate", "rounds", "exact", "rac"))
    p.add_argument("--shape", nargs=3, type=int, metavar=("Z", "Y", "X"), help="of a parquet lattice")
    args = p.parse_args(argv)
    spark = prepare(SparkSession.builder.appName("lattica").getOrCreate())
    kind = Path(args.input).suffix
    if kind == ".zarr":
        lattice, shape = zarr.read(spark, args.input)
    elif kind in (".h5", ".hdf5"):
        lattice, shape = L.read_hdf5(spark, args.input, (args.dataset,))
    elif kind == ".npy":
        lattice, shape = L.read_npy(spark, args.input)
    elif args.shape:
        lattice, shape = L.read_lattice(spark, args.input), Shape(*args.shape)
    else:
        p.error("a parquet lattice needs --shape")
    thresholds = resolve_thresholds(args.thresholds, args.threshold_mode)
    labels = cut(segment_frames(cut(lattice), shape, thresholds, eps=args.eps, method=args.method))
    for given, t in zip(args.thresholds, thresholds):
        own = labels.where(F.col("threshold") == t).select("vox", "label")
        to = f"{args.out_dir.rstrip('/')}/labels_thr{given}"
        if kind == ".zarr":
            to += ".zarr"
            zarr.write_labels(own, shape, to)
        elif kind in (".npy", ".h5", ".hdf5"):
            to += kind
            L.write_array(L.labels_to_numpy(own, shape), to)
        else:
            own.write.mode("overwrite").parquet(to)
        n = own.where("label <> 0").agg(F.countDistinct("label")).first()[0]
        print(f"wrote {to}: {n} segments")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
