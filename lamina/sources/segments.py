"""Layers kept as tables of segments: extended by depth, or bucketed by state for joins that move nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import packed
from lamina.operators.layers import merge
from lamina.sources.values import fresh

SEGMENT = "seg"


def extend(source: DataFrame, path: str, seg: int, low: int, high: int, *keep: str) -> None:
    """Appends to the layer at ``path`` the predecessors of ``source`` with a depth in (low, high], as one segment.

    The depth is a property of the state, so segments of windows that do not overlap have no state in
    common: what is there already is neither read nor written again, and the union of the segments is
    the layer of the largest bound.
    """
    grown = merge(packed.stepped(source, *keep, backwards=True, window=(low, high)), *keep, "h", "e", "bits", "depth")
    grown.withColumn(SEGMENT, F.lit(seg)).sortWithinPartitions("h", "bits").write.mode("append").partitionBy(SEGMENT).parquet(path)


def write_segments(layer: DataFrame, path: str, *keys: str) -> None:
    """Writes a layer that has a column seg, all segments in one pass, each sorted by the keys."""
    layer.sortWithinPartitions(SEGMENT, *keys).write.partitionBy(SEGMENT).parquet(path)


def read_segments(like: DataFrame, path: str) -> DataFrame:
    """The union of a layer's segments, with their numbers. A filter on seg reads the segments it needs only."""
    spark = like.sparkSession
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema if f.name != SEGMENT)
    return spark.read.schema(f"{fields}, {SEGMENT} int").parquet(path)


def bucketed(spark: SparkSession, layer: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """The layer as a table in ``buckets`` files by the hash of its keys, sorted. Two layers with the same buckets and keys join without a shuffle, as often as they are joined."""
    table = f"{name}_{uuid.uuid4().hex}"
    layer.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", fresh(spark, name)).saveAsTable(table)
    return spark.table(table)
