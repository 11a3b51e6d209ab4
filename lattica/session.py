"""Session helpers: worker import path, checkpoint folder, lineage cuts, adaptive sizing."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2048  # rows that go to a Python worker at once, at most
LOCAL = re.compile(r"local(\[[^\]]*\])?")
_ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound their batches, and see that checkpoints have a folder.

    The folder is the one that ``spark.checkpoint.dir`` names.  Where that is unset, a local
    session (as in tests) gets a temporary one; on a cluster executors couldn't share it, so
    there it is an error.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)
    # batches of whole texts stand in both processes' memory at once
    if int(spark.conf.get(_BATCH)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", "")
        if not folder and not LOCAL.fullmatch(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="lattica-ckpt-")
        sc.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; used only to choose numbers of partitions."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
    except Exception:  # a plan without statistics
        return 1 << 30


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
