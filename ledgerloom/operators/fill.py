"""Filling of gaps in ordered series."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def forward(value: Column, by: list[str], order: list) -> Column:
    """The last known value up to each row."""
    return F.last(value, True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def backward(value: Column, by: list[str], order: list) -> Column:
    """The next known value from each row on."""
    return F.first(value, True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))


def running(value: Column, by: list[str], order: list) -> Column:
    """The sum of all values up to each row."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def island(start: Column, by: list[str], order: list) -> Column:
    """Numbers of stretches that begin where ``start`` holds; 0 before the first."""
    return running(start.cast("long"), by, order)
