"""Dense surrogate keys without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the partition above this bit and the row's place below it.
PLACE_BITS = 33


def dense_key(df: DataFrame, name: str, key: str, keep: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """Number rows 1, 2, ... in order of ``key``; equal keys in any order.

    Rows are dealt by ranges of the key and sorted inside them, which is the
    only shuffle; ``keep`` stores them with partition and place, so both are
    the same whenever they are read.  A row's number is its place plus the rows
    of the partitions before, of which there is one count each: that table is
    as long as the write had tasks, and is broadcast."""
    place = F.monotonically_increasing_id()
    rows = keep(lambda: df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", place))
    part, inside = F.shiftright("__at", PLACE_BITS), F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = sorted(rows.groupBy(part.alias("p")).count().toLocalIterator(), key=lambda r: r["p"])
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    if len(starts) < 2:
        return rows.withColumn(name, inside + 1).drop("__at")
    starts = df.sparkSession.createDataFrame(starts, "__p long, __start long")
    return rows.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, F.col("__start") + inside + 1).drop("__at", "__p", "__start")
