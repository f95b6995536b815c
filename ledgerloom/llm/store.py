"""Shared scratch tables: how an operator cuts its lineage.

A long plan whose inner result is read more than once is written as Parquet to
the shared folder that the cluster names in ``spark.checkpoint.dir`` and read
back, so a lost executor costs one re-read and never a recomputation of the
corpus scan.  Where the setting is absent (tests, notebooks) the folder is
``_scratch`` in the warehouse, which every executor can reach by definition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder for scratch tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def fresh_path(spark: SparkSession, name: str, purged: bool = True) -> str:
    """A path below the shared folder that nothing has used before; ``purge`` deletes it unless told not to."""
    path = f"{root(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    if purged:
        _written.append(path)
    return path


def unused(name: str, columns: list[str]) -> str:
    """A column name like this one that a table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete the scratch tables that this driver has written so far.

    Only for callers who have stored every result that reads them."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)
