"""Run a streaming plan over files to completion and read back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wardline.session import checkpoint_folder


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The Parquet file of a table as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available on the RocksDB state store, append to Parquet in the shared folder, return the rows."""
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    base = f"{checkpoint_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start(f"{base}/rows"))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")
