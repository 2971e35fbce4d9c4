"""Where streams end: Parquet in the folder that the cluster shares. No row passes through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from hushframe.sources.staging import shared_folder
from hushframe.sources.versions import KeyedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession):
    """Lists and timers in state need RocksDB. A stream reads the setting as it starts; afterwards it is as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def finished(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs the stream to the end of what is there, and returns the table that it wrote.

    State and progress lie beside the rows, so that a lost executor costs a retry of its tasks. In mode append the
    file sink commits each batch once; in mode complete each batch replaces the one before it. A stream without input
    gives an empty table.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows = f"{folder}/rows"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "complete":
        spark.createDataFrame([], df.schema).write.parquet(rows)
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    else:
        writer = writer.format("parquet").option("path", rows)
    _ended(spark, writer)
    return spark.read.schema(df.schema).parquet(rows)


def _ended(spark: SparkSession, writer) -> None:
    with _rocksdb(spark):
        q = writer.start()
        try:
            q.awaitTermination()
        finally:
            q.stop()


def each_batch(df: DataFrame, name: str, parts: Callable[[DataFrame], dict[str, DataFrame]], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Runs the stream to the end of what is there; each batch is taken apart into named tables, which are returned.

    A batch writes a folder of its own in each table, in place of what it may have written before it was interrupted: a
    batch that runs again changes nothing. schemas: of each table.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for part, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{part}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        for part, rows in parts(batch).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{part}/batch={number}")

    _ended(spark, df.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write))
    return {part: spark.read.schema(schema).parquet(f"{folder}/{part}") for part, schema in schemas.items()}


def upserted(df: DataFrame, name: str, table: KeyedTable) -> KeyedTable:
    """Runs the stream to the end of what is there and merges each batch into the table, once, however often it runs."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    _ended(spark, writer.foreachBatch(lambda batch, number: table.upsert(batch, folder, number) and None))
    return table
