"""Tables of a plan that are written once and scanned from then on.

The mart is made of few tables that many others read.  Each is stored as
Parquet in the shared folder (``spark.checkpoint.dir``, else ``_kept`` in the
warehouse), so a later table's plan holds scans and not the plans of all tables
before it, and a lost executor costs a scan."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_schemas: dict[str, T.StructType] = {}


def root(spark: SparkSession) -> str:
    """The folder that every executor reaches."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_kept").rstrip("/") + "/ledgerloom-tables"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whatever store it lies in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Keeper:
    """Keeps tables below a folder; of one name, the first that is made stays."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self.path = f"{root(spark)}/{spark.sparkContext.applicationId}-{name or uuid.uuid4().hex}"

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.path}/{name}"
        at, files = hadoop_path(self.spark, path)
        if path not in _schemas or not files.exists(at):
            df = make()
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            _schemas[path] = df.schema
        return self.spark.read.schema(_schemas[path]).parquet(path)


def stamp(spark: SparkSession, paths: list[str]) -> str:
    """What tells one state of some files from another: sizes and times of change."""
    out = []
    for path in paths:
        at, files = hadoop_path(spark, path)
        out += [f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}" for s in files.listStatus(at)]
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(out))).hex


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has kept."""
    mine = f"{root(spark)}/{spark.sparkContext.applicationId}-"
    for folder in {p.rsplit("/", 1)[0] for p in _schemas if p.startswith(mine)}:
        at, files = hadoop_path(spark, folder)
        files.delete(at, True)
    for p in [p for p in _schemas if p.startswith(mine)]:
        del _schemas[p]
