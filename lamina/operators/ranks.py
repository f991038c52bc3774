"""Numbering rows in an order without one task that sees all of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import materialise


def ranked(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str = "number") -> DataFrame:
    """The rows with their number (from 1) among those of equal ``by`` columns in ascending ``order``.

    Rows are dealt to ranges of (by, order), so that a large group lies in several ranges. Rows of a
    range are counted by group, the counts before a range are its offset, and within a range a window
    numbers what it has. Nothing but counts is seen across ranges. Groups must not be null in ``by``.
    """
    ranged = materialise(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return ranged.join(offsets, [*by, "_range"]).withColumn(name, F.col("_offset") + own).drop("_range", "_offset")
