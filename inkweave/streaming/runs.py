"""Runs a stream to the end of what its source holds and hands the sink's table on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: transformWithState keeps its state there.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The rows that a stream in append mode yields for all that its source holds now. Checkpoint and sink lie in the shared folder."""
    folder, before = shared_folder(spark), spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path)
