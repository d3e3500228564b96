"""Packing of episodes as they arrive: a streaming file source, one pack version a batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pack import PackConfig, _located, complete_packs, current, pack_shards

FRAMES = "episode string, camera string, frame_idx long, data binary"


def pack_arrivals(spark: SparkSession, source: str, config: PackConfig, checkpoint: str):
    """Pack what is new in ``source`` (Parquet files of whole episodes) and stop.

    Each batch is a version below ``output_dir``.  A batch that is repeated after a failure
    makes another pack of its own version, and the newest counts, so nothing is packed twice; the checkpoint remembers what is done.
    """

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            pack_shards(batch, replace(config, output_dir=f"{config.output_dir}/version={number}"))

    stream = spark.readStream.schema(FRAMES).parquet(source).writeStream.foreachBatch(one)
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merged(spark: SparkSession, folder: str, kind: str = "clips") -> DataFrame:
    """Clips or shards of all versions, of the newest pack of each, with their version."""
    path, fs = _located(spark, f"{folder.rstrip('/')}/version=*")
    found = [current(spark, f.getPath().toString()) for f in fs.globStatus(path) or () if complete_packs(spark, f.getPath().toString())]
    if not found:
        raise FileNotFoundError(f"no pack in {folder}")
    read = spark.read.option("basePath", folder).parquet(*[f"{p}/{kind}" for p in found])
    return read.withColumn("version", F.col("version").cast("long")).drop("pack")
