"""Sources and sinks of lattices, labels and graphs."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions.affinity import quantise
from lattica.schemas import LATTICE, Shape, ShapeError
from lattica.session import prepare, table

# -- arrays ----------------------------------------------------------------------------


def as_numpy(array) -> np.ndarray:
    """An array from anything array-like; tensors come to the host first."""
    if hasattr(array, "detach"):
        array = array.detach().cpu()
    return np.asarray(array)


def as_bytes(aff) -> np.ndarray:
    """Bytes of an affinity array: uint8 as it is, else rounded half to even in float32."""
    aff = as_numpy(aff)
    if aff.ndim != 4 or aff.shape[0] != 3:
        raise ShapeError(f"expected affinities of shape [3,Z,Y,X], got {list(aff.shape)}")
    return quantised(aff)


def quantised(aff: np.ndarray) -> np.ndarray:
    if aff.dtype == np.uint8:
        return aff
    return np.clip(np.rint(aff.astype(np.float32) * np.float32(255)), 0, 255).astype(np.uint8)


def lattice_from_numpy(spark: SparkSession, aff) -> tuple[DataFrame, Shape]:
    own = as_bytes(aff)
    shape = Shape(*own.shape[1:])
    vox = np.arange(shape.cells)
    z, y, x = (c.astype(np.int32) for c in np.unravel_index(vox, own.shape[1:]))
    flat = own.reshape(3, -1).astype(np.int32)
    return spark.createDataFrame(pa.table({"vox": vox, "z": z, "y": y, "x": x, "az": flat[0], "ay": flat[1], "ax": flat[2]})), shape


def labels_from_numpy(spark: SparkSession, labels, name: str = "frag") -> DataFrame:
    flat = as_numpy(labels).reshape(-1).astype(np.int64)
    return spark.createDataFrame(pa.table({"vox": np.arange(len(flat)), name: flat}))


def labels_to_numpy(labels: DataFrame, shape: Shape, name: str = "label") -> np.ndarray:
    """A label volume on the driver; for volumes that fit there."""
    got = labels.select("vox", name).toArrow()
    out = np.zeros(shape.cells, dtype=np.uint64)
    out[got.column("vox").to_numpy()] = got.column(name).to_numpy()
    return out.reshape(shape.z, shape.y, shape.x)


def from_torch(tensor):
    """A tensor as an array on the host; anything else as it is."""
    return np.ascontiguousarray(tensor.detach().cpu().numpy()) if hasattr(tensor, "detach") else tensor


def to_torch(array, device: str | None = None):
    """A tensor of a collected array, where torch is installed."""
    import torch

    own = torch.as_tensor(np.ascontiguousarray(as_numpy(array)))
    return own if device is None else own.to(device)


# -- files -----------------------------------------------------------------------------


def read_lattice(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_lattice(lattice: DataFrame, path: str, tile: tuple[int, int, int] = (64, 256, 256)) -> None:
    """Parquet in spatial tiles, gzip: cells of a tile share files, so crops prune."""
    at = [F.floor(F.col(a) / n).cast("int").alias(f"t{a}") for a, n in zip("zyx", tile)]
    lattice.select("*", *at).repartition("tz", "ty", "tx").sortWithinPartitions("tz", "ty", "tx", "vox").write.mode("overwrite").option("compression", "gzip").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """A folder for each threshold."""
    labels.write.mode("overwrite").partitionBy("threshold").parquet(path)


SLAB = 8  # planes that one task reads of an array file


def _read_slabs(spark: SparkSession, shape: tuple[int, ...], read, slab: int = SLAB) -> tuple[DataFrame, Shape]:
    """A lattice from ``read(low, high)``, which gives planes of [3,Z,Y,X] where it is called; the driver sees the shape only."""
    if len(shape) != 4 or shape[0] != 3:
        raise ShapeError(f"expected affinities of shape [3,Z,Y,X], got {list(shape)}")
    own = Shape(*shape[1:])
    prepare(spark)

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                low, high = k * slab, min(own.z, (k + 1) * slab)
                block = quantised(read(low, high))
                z, y, x = (i.reshape(-1) for i in np.indices(block.shape[1:]))
                flat, z = block.reshape(3, -1).astype(np.int32), z + low
                yield pa.record_batch({
                    "vox": pa.array((z * own.y + y) * own.x + x), **{n: pa.array(v.astype(np.int32)) for n, v in zip("zyx", (z, y, x))},
                    **{n: pa.array(flat[i]) for i, n in enumerate(("az", "ay", "ax"))},
                })

    n = -(-own.z // slab)
    return spark.range(0, n, numPartitions=max(1, n)).mapInArrow(run, LATTICE), own


def read_npy(spark: SparkSession, path: str) -> tuple[DataFrame, Shape]:
    """An array file that all executors can open; each task maps its own planes."""
    return _read_slabs(spark, np.load(path, mmap_mode="r").shape, lambda low, high: np.load(path, mmap_mode="r")[:, low:high])


def read_hdf5(spark: SparkSession, path: str, keys: tuple[str, ...] = ("affinity",)) -> tuple[DataFrame, Shape]:
    """The first key that the file has, read by planes in tasks; needs h5py, and a path that all executors can open."""
    import h5py

    with h5py.File(path, "r") as f:
        key = next((k for k in keys if k in f), None)
        if key is None:
            raise KeyError(f"none of {keys} in {path}")
        shape = f[key].shape

    def planes(low, high):
        with h5py.File(path, "r") as f:
            return f[key][:, low:high]

    return _read_slabs(spark, shape, planes)


def write_array(labels: np.ndarray, path: str, key: str = "labels") -> None:
    """A collected volume as .npy, or as .h5 where h5py is installed."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if path.endswith(".npy"):
        np.save(path, labels)
        return
    import h5py

    with h5py.File(path, "w") as f:
        f.create_dataset(key, data=labels, compression="gzip")


def read_graph_npz(spark: SparkSession, path: str) -> DataFrame:
    """u, v, sum_bytes, cnt of a cached graph: keys [n, 2] and stats [n, 2] (sum in [0, 1], count)."""
    with np.load(path) as f:
        keys, stats = f["keys"].astype(np.int64), f["stats"]
    lo, hi = keys.min(axis=1), keys.max(axis=1)
    total = np.floor(stats[:, 0] * 255 + 0.5).astype(np.int64)
    return spark.createDataFrame(pa.table({"u": lo, "v": hi, "sum_bytes": total, "cnt": stats[:, 1].astype(np.int64)}))


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """A table of measured alternatives: CSV with a header."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=1, sort_keys=True) + "\n")


def synthetic(spark: SparkSession, shape: Shape, levels: int = 4, seed: int = 0) -> DataFrame:
    """A lattice of few affinity levels, from hashes: the same rows on any cluster."""
    vox, step = F.col("id"), 255 // max(levels - 1, 1)
    byte = lambda c: (F.pmod(F.xxhash64(vox, F.lit(c), F.lit(seed)), F.lit(levels)) * step).cast("int")
    z, y, x = F.floor(vox / shape.strides[0]), F.floor(vox / shape.x) % shape.y, vox % shape.x
    return spark.range(shape.cells).select(vox.alias("vox"), z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), byte(0).alias("az"), byte(1).alias("ay"), byte(2).alias("ax"))


# -- driver tables ---------------------------------------------------------------------


def events_shape(n: int) -> Shape:
    y, x = (10, 10) if n <= 1000 else (25, 40) if n <= 10_000 else (50, 50)
    return Shape(-(-n // (y * x)), y, x)


def _grid(events: DataFrame, shape: Shape, *channels) -> DataFrame:
    vox = F.col("event_id")
    return events.select(
        vox.alias("vox"), F.floor(vox / shape.strides[0]).cast("int").alias("z"), (F.floor(vox / shape.x) % shape.y).cast("int").alias("y"), (vox % shape.x).cast("int").alias("x"),
        *(c.alias(n) for c, n in zip(channels, ("az", "ay", "ax"))),
    )


def events_lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Shape]:
    """Four byte levels by event: rich in plateaus."""
    events = table(prepare(spark), sf_dir, "events")
    shape = events_shape(events.count())
    level = lambda c: (F.pmod(c, F.lit(4)) * 85).cast("int")
    return _grid(events, shape, level(F.floor("value")), level(F.floor(F.col("value") * 10)), level(F.col("user_id"))), shape


def events_lattice_tiefree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Shape]:
    """All faces different: ordinal affinities from the rank of (value, event_id)."""
    events = table(prepare(spark), sf_dir, "events")
    shape = events_shape(events.count())
    # a rank without one sorted task: ranges by value, then their sizes as offsets
    ranged = events.select("event_id", "value").repartitionByRange("value", "event_id").sortWithinPartitions("value", "event_id").withColumn("part", F.spark_partition_id())
    own = W.partitionBy("part").orderBy("value", "event_id")
    ranked = ranged.withColumn("n", F.row_number().over(own))
    sizes = ranked.groupBy("part").agg(F.max("n").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("before"))
    rank = ranked.join(F.broadcast(before), "part").select("event_id", (F.col("before") + F.col("n")).alias("rank"))
    r = F.col("rank").cast("long") * 3
    return _grid(rank, shape, r, r + 1, r + 2), shape


def events_lattice_float(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Shape]:
    """Float affinities in [0, 1), quantised."""
    events = table(prepare(spark), sf_dir, "events")
    shape = events_shape(events.count())
    a = (F.col("value") / 600.0).cast("float")
    return _grid(events, shape, quantise(a), quantise((F.lit(1).cast("float") - a)), quantise((F.pmod("user_id", F.lit(100)) / 100.0).cast("float"))), shape


def block_fragments(lattice: DataFrame, side: int = 5) -> DataFrame:
    """A fixed rule instead of a watershed: blocks of cells, every 17th cell background."""
    block = (F.floor(F.col("z") / side) * 10_000 + F.floor(F.col("y") / side) * 100 + F.floor(F.col("x") / side) + 1).cast("long")
    return lattice.select("vox", F.when(F.col("vox") % 17 == 0, 0).otherwise(block).cast("long").alias("frag"))


def lineitem_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bipartite contact table: suppliers and parts, one contact for each line, bytes from discounts."""
    rows = table(prepare(spark), sf_dir, "lineitem")
    return rows.select((F.col("l_suppkey") + 1).alias("u"), (F.col("l_partkey") + 1_000_000).alias("v"), (F.round(F.col("l_discount") * 100) * 25).cast("int").alias("aff"))


def lineitem_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (seg, gt) with zeros on both sides."""
    rows = table(prepare(spark), sf_dir, "lineitem")
    return rows.select((F.col("l_partkey") % 16).alias("seg"), (F.col("l_suppkey") % 8).alias("gt"))
