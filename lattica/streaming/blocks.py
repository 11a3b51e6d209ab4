"""Blocks that arrive over time: region graphs kept up to date with Structured Streaming.

Contacts arrive as files of (u, v, sum_bytes, cnt) rows, block by block; each
micro-batch is aggregated and merged into a table of one version per batch, so a
batch that runs twice after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.graph import contract_rows
from lattica.schemas import GRAPH


def _version(path: str, n: int) -> str:
    return f"{path}/version={n:09d}"


def grow_graph(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a stream over contact files in ``source`` that keeps ``target`` aggregated."""
    arriving = spark.readStream.schema(GRAPH).parquet(source)

    def merge(batch: DataFrame, n: int) -> None:
        own = contract_rows(batch)
        if n:
            own = contract_rows(own.unionByName(spark.read.schema(GRAPH).parquet(_version(target, n - 1))))
        own.write.mode("overwrite").parquet(_version(target, n))

    writer = arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_graph(spark: SparkSession, target: str, version: int) -> DataFrame:
    return spark.read.schema(GRAPH).parquet(_version(target, version))
