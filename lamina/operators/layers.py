"""Layered exact counting: a layer is a table of (state, count), a step a flat-map, a filter and a grouped sum.

Counts are DECIMAL(38,0): exact, and an overflow is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNT = "decimal(38,0)"


def merge(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds up the counts of equal states."""
    return rows.groupBy(*keys).agg(F.sum("count").cast(COUNT).alias("count"))


def step(layer: DataFrame, expand: Callable[[Column, Column], Column], *keep: str) -> DataFrame:
    """Replaces each (word, h, count) by the states that expand(word, h) gives, filtered there, before they move; other columns named in ``keep`` are part of the state."""
    out = layer.select(*keep, F.explode(expand(F.col("word"), F.col("h"))).alias("s"), "count").select(*keep, "s.word", "s.h", "count")
    return merge(out, *keep, "word", "h")


def seeds(spark: SparkSession) -> DataFrame:
    """(p, h, e, bits, count): states before the east end from which it finishes an order of parity p."""
    rows = "(1, 1, 5L), (0, 0, 5L), (0, 0, 1L)"  # '()' above and below, '()' below, nothing
    return spark.sql(f"SELECT p, h, -1 AS e, bits, CAST(1 AS {COUNT}) AS count FROM VALUES {rows} AS t(p, h, bits)")
