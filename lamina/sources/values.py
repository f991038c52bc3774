"""Readers and writers of value files and result tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import scratch_path


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared scratch folder. A reader that is given the name of a folder written whole never sees half of a file."""
    return scratch_path(spark, name)


#: In a folder of versions, the file that names the present one.
CURRENT = "_current"


def _hadoop(spark: SparkSession, path: str):
    """The cluster's own file system for a path, whatever store it is in: (context, Path class, file system)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), conf), jvm.org.apache.hadoop.fs.Path, fs


def _named(spark: SparkSession, path: str) -> str | None:
    _, at, fs = _hadoop(spark, path)
    if not fs.exists(at(path, CURRENT)):
        return None
    stream = fs.open(at(path, CURRENT))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Replaces a table so that readers see the old one or the new one, and never a part.

    ``write`` puts the rows into a folder of their own beside the present version; then one rename of the
    file that names the version commits them. A writer that fails leaves everything as it was. The version
    before stays until the next commit, for those who read it now.
    """
    spark = df.sparkSession
    context, at, fs = _hadoop(spark, path)
    version, before = f"version-{uuid.uuid4().hex}", _named(spark, path)
    write(df, f"{path}/{version}")
    aside = at(path, f"_next-{version}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    over = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(aside, at(path, CURRENT), over)
    for status in fs.listStatus(at(path)):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def present(spark: SparkSession, path: str) -> str:
    """The folder of the version that a table has now; the path itself if it has no versions."""
    version = _named(spark, path)
    return f"{path}/{version}" if version else path


VALUES = "n int, count decimal(38,0), check decimal(38,0)"


def read_b_file(spark: SparkSession, path: str) -> DataFrame:
    """(n, count) of lines 'n value'; '#' begins a comment."""
    line = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    rows = spark.read.text(path).select(line.alias("f")).where("size(f) >= 2")
    return rows.select(F.col("f")[0].cast("int").alias("n"), F.col("f")[1].cast("decimal(38,0)").alias("count"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, after '#' lines."""
    return spark.read.csv(path, sep="\t", comment="#", header=True, nullValue="-")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="-")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(present(spark, path), sep="\t", schema=VALUES, nullValue="-")


def write_values(df: DataFrame, path: str) -> None:
    """Replaces the value file, whole or not at all."""
    replace(df.select("n", "count", "check"), path, lambda rows, to: rows.write.csv(to, sep="\t", nullValue="-"))


def verdict(count: Column, expected: Column) -> Column:
    """'ok', or what was expected instead."""
    return F.when(count == expected, "ok").otherwise(F.concat(F.lit("MISMATCH("), expected.cast("string"), F.lit(")")))
