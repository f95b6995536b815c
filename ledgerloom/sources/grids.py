"""String grids of statements: the rows of cells that extraction starts from.

A document's pages come as text (one line a row, cells parted by tabs or runs
of blanks) or from a reader of the caller's own: reading PDF geometry needs a
library that isn't here, so ``pages`` takes a function from file content to
page texts and runs it where the files lie."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a folder: ``path, content``, ordered by nothing; sort by path where order counts."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def pages(found: DataFrame, reader: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """``doc_id, page, text`` of each page; a file that the reader can't open has no pages."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    texts = list(reader(content))
                except ValueError:
                    texts = []
                rows += [(path, i, t) for i, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return found.mapInPandas(run, "doc_id string, page int, text string")


def grid(paged: DataFrame, cells: str = r"\t| {2,}") -> DataFrame:
    """``doc_id, page, row, cells`` from page texts, rows counted from 0 and blank lines left out."""
    lines = paged.select("doc_id", "page", F.posexplode(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")).alias("row", "line"))
    return lines.select("doc_id", "page", "row", F.split(F.trim("line"), cells).alias("cells"))


def crop(words: DataFrame, left: float | None = None, top: float | None = None, right: float | None = None, bottom: float | None = None) -> DataFrame:
    """Word boxes ``x0, y0, x1, y1`` inside a region; a side not given doesn't bound it."""
    for column, low, value in (("x0", True, left), ("y0", True, top), ("x1", False, right), ("y1", False, bottom)):
        if value is not None:
            words = words.where(F.col(column) >= value if low else F.col(column) <= value)
    return words


def strip_header(rows: DataFrame, header: str | None = None, always: bool = False) -> DataFrame:
    """Drop the first row of each page's grid: always, or if it reads as the header but for case and blanks."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row")) == 1
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    same = F.lit(True) if always else plain(F.array_join("cells", "")) == plain(F.lit(header or ""))
    return rows.withColumn("__head", first & same).where("not __head").drop("__head")


def at_least(rows: DataFrame, columns: int) -> DataFrame:
    """Rows of pages whose widest row has enough cells."""
    widest = rows.groupBy("doc_id", "page").agg(F.max(F.size("cells")).alias("__n")).where(F.col("__n") >= columns).drop("__n")
    return rows.join(widest, ["doc_id", "page"], "left_semi")
