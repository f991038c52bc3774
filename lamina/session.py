"""Session factory, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lamina", **conf: str) -> SparkSession:
    """A session with the settings that the library expects; the cluster's own settings stay where they are set."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lamina.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("lamina.scratch.dir", root)
    return root.rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the scratch folder, which release() will delete."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the scratch tables that this application has written, once their last reader is done: frames that were returned and not yet written can't be read any more. Returns how many folders there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the scratch folder and reads it again, which ends the lineage of a loop."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once for an application, so that they need no copy of their own.

    Rows here are texts, so Arrow batches are made smaller than Spark's default, unless the session has set their size.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH) == "10000" and not context.getConf().contains(BATCH):
        spark.conf.set(BATCH, "256")
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lamina-")) / "lamina.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
