"""Zarr arrays (format 2), block by block.

Chunks are read by Spark's binary file source, so any store that Spark reads will do, and
each is decoded where its task runs; only the array's description reaches the driver.
Chunks are written by the tasks that hold them, to a folder that all executors share.
Compressors: none, zlib, gzip, zstd.  Missing chunks are filled.
"""

from __future__ import annotations

import gzip
import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.schemas import LATTICE, Shape, ShapeError
from lattica.session import prepare

CHUNK = (64, 128, 128)


def _small_file(spark: SparkSession, path: str) -> str:
    """A text from any store that Spark reads; its file source passes over names with a leading dot."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def describe(spark: SparkSession, path: str) -> dict:
    """The array's description, checked."""
    told = json.loads(_small_file(spark, f"{path.rstrip('/')}/.zarray"))
    if told.get("zarr_format") != 2 or told.get("filters"):
        raise ValueError("only zarr format 2 without filters is read")
    kind = (told.get("compressor") or {}).get("id")
    if kind not in (None, "zlib", "gzip", "zstd"):
        raise ValueError(f"an unknown compressor: {kind}")
    return told


def unpacked(data: bytes, told: dict) -> np.ndarray:
    kind = (told.get("compressor") or {}).get("id")
    if kind == "zlib":
        data = zlib.decompress(data)
    elif kind == "gzip":
        data = gzip.decompress(data)
    elif kind == "zstd":
        data = zstandard.ZstdDecompressor().stream_reader(data).read()
    return np.frombuffer(data, dtype=np.dtype(told["dtype"])).reshape(told["chunks"], order=told.get("order", "C"))


def chunks(spark: SparkSession, path: str, told: dict) -> DataFrame:
    """at (the chunk's place along each axis) and data of every stored chunk."""
    n = len(told["shape"])
    mark = told.get("dimension_separator", ".")
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    gap = "/" if mark == "/" else r"\."
    tail = F.regexp_extract("path", rf"/((?:\d+{gap}){{{n - 1}}}\d+)$", 1)
    return own.select(tail.alias("at"), F.col("content").alias("data")).where("at <> ''").select(F.split("at", gap).cast("array<int>").alias("at"), "data")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Shape]:
    """The lattice of an affinity array [3,Z,Y,X]; what isn't stored is the fill value."""
    from lattica.sources.lattice import quantised

    prepare(spark)
    told = describe(spark, path)
    if len(told["shape"]) != 4 or told["shape"][0] != 3:
        raise ShapeError(f"expected affinities of shape [3,Z,Y,X], got {told['shape']}")
    shape, size = Shape(*told["shape"][1:]), told["chunks"]

    def run(batches):
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist()):
                block = quantised(unpacked(data, told))
                low = [a * s for a, s in zip(at, size)]
                block = block[tuple(slice(0, n - lo) for n, lo in zip(told["shape"], low))]
                c, z, y, x = (i.reshape(-1) + lo for i, lo in zip(np.indices(block.shape), low))
                yield pa.record_batch({"vox": pa.array((z * shape.y + y) * shape.x + x), "c": pa.array(c.astype(np.int32)), "aff": pa.array(block.reshape(-1).astype(np.int32))})

    cells = chunks(spark, path, told).mapInArrow(run, "vox long, c int, aff int").groupBy("vox").agg(*(F.max(F.when(F.col("c") == i, F.col("aff"))).alias(n) for i, n in enumerate(("az", "ay", "ax"))))
    fill = int(quantised(np.array([told.get("fill_value") or 0], dtype=told["dtype"]))[0])
    all_ = spark.range(shape.cells).withColumnRenamed("id", "vox").join(cells, "vox", "left").fillna(fill)
    vox = F.col("vox")
    place = {"z": F.floor(vox / shape.strides[0]), "y": F.floor(vox / shape.x) % shape.y, "x": vox % shape.x}
    named = [F.col(c) if c not in place else place[c].cast("int").alias(c) for c in (x.split()[0] for x in LATTICE.split(", "))]
    return all_.select(*named), shape


def _write(rows: DataFrame, shape: tuple[int, ...], dtype: str, path: str, chunk: tuple[int, ...], cells) -> None:
    """``rows``: vox and the values that ``cells`` makes a block [..., z, y, x] of; one task for each chunk."""
    prepare(rows.sparkSession)
    folder = Path(path.removeprefix("file://"))
    folder.mkdir(parents=True, exist_ok=True)
    told = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunk), "dtype": dtype, "compressor": {"id": "gzip", "level": 1}, "fill_value": 0, "order": "C", "filters": None}
    (folder / ".zarray").write_text(json.dumps(told, indent=1))
    whole, size = Shape(*shape[-3:]), chunk[-3:]
    vox = F.col("vox")
    at = [F.floor(vox / whole.strides[0] / size[0]), F.floor(F.floor(vox / whole.x) % whole.y / size[1]), F.floor(vox % whole.x / size[2])]
    placed = rows.withColumns({n: a.cast("int") for n, a in zip(("cz", "cy", "cx"), at)})

    def run(key, group):
        here = [k.as_py() for k in key]
        cell = group.column("vox").to_numpy()
        z, y, x = cell // whole.strides[0] - here[0] * size[0], cell // whole.x % whole.y - here[1] * size[1], cell % whole.x - here[2] * size[2]
        for name, block in cells(group, (z, y, x), here):
            part = folder / f".{name}.part"
            part.write_bytes(gzip.compress(np.ascontiguousarray(block).tobytes(), 1, mtime=0))
            part.replace(folder / name)  # the same bytes again if a task runs twice
        return pa.table({"cells": pa.array([len(cell)], pa.int64())})

    placed.groupBy("cz", "cy", "cx").applyInArrow(run, "cells long").agg(F.sum("cells")).collect()


def write_lattice(lattice: DataFrame, shape: Shape, path: str, chunk: tuple[int, int, int] = CHUNK) -> None:
    """Affinities [3,Z,Y,X] as bytes."""

    def cells(group, place, here):
        block = np.zeros((3, *chunk), np.uint8)
        for i, c in enumerate(("az", "ay", "ax")):
            block[(i, *place)] = group.column(c).to_numpy()
        yield "0." + ".".join(map(str, here)), block

    _write(lattice.select("vox", "az", "ay", "ax"), (3, shape.z, shape.y, shape.x), "|u1", path, (3, *chunk), cells)


def write_labels(labels: DataFrame, shape: Shape, path: str, name: str = "label", chunk: tuple[int, int, int] = CHUNK) -> None:
    """Labels [Z,Y,X] as unsigned 64-bit numbers."""

    def cells(group, place, here):
        block = np.zeros(chunk, "<u8")
        block[place] = group.column(name).to_numpy()
        yield ".".join(map(str, here)), block

    _write(labels.select("vox", name), (shape.z, shape.y, shape.x), "<u8", path, chunk, cells)


def read_labels(spark: SparkSession, path: str, name: str = "label") -> tuple[DataFrame, Shape]:
    """vox and label of the stored chunks of a label array [Z,Y,X]."""
    prepare(spark)
    told = describe(spark, path)
    shape, size = Shape(*told["shape"]), told["chunks"]

    def run(batches):
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist()):
                low = [a * s for a, s in zip(at, size)]
                block = unpacked(data, told)[tuple(slice(0, n - lo) for n, lo in zip(told["shape"], low))]
                z, y, x = (i.reshape(-1) + lo for i, lo in zip(np.indices(block.shape), low))
                yield pa.record_batch({"vox": pa.array((z * shape.y + y) * shape.x + x), name: pa.array(block.reshape(-1).astype(np.int64))})

    return chunks(spark, path, told).mapInArrow(run, f"vox long, {name} long"), shape
