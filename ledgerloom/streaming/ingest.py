"""Incremental ingestion (an extension): micro-batches of raw rows into a keyed store.

Each micro-batch is an upsert by key, so a batch that is replayed after a
failure changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.store import KEYS, Store


def watch(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over Parquet files dropped into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def into_store(stream: DataFrame, store: Store, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert every micro-batch into a table of the store; of rows of one key, one is kept."""

    def put(batch: DataFrame, _: int) -> None:
        store.update(name, batch.dropDuplicates(KEYS[name]))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def movements(stream: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Net movement and number of lines by account and window of transaction time, late lines within a bound."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "account")
    return w.agg(F.sum("movement").alias("movement"), F.count("*").alias("lines"))
