"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "corpusward", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only where all executors are threads of this machine; a cluster
    must name a folder that its executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cut lineage with a table written to the shared folder, read by ``spark`` or the frame's session.

    A lost executor costs one re-read; later joins prune its columns and know its size.
    """
    spark = spark or df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Remove tables made by ``cut`` that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "scratch", None)
        if path:
            remove(table.sparkSession, path)


def qualified(spark: SparkSession, path: str):
    """The file system of ``path``, and the path as that file system spells it out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def exists(spark: SparkSession, path: str) -> bool:
    system, place = qualified(spark, path)
    return bool(system.exists(place))


def remove(spark: SparkSession, path: str) -> None:
    system, place = qualified(spark, path)
    system.delete(place, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counted in place."""
    return df.count() <= rows
