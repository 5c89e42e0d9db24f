"""Cutting long plans: results that are read many times become tables in the cluster's checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written and a weak reference each to the list of files that all plans over the table share.
_kept: list[tuple[str, object]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. One of our own is set only where the session names
    none and all executors are threads of this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    atexit.register(_remove_quietly, spark, own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may already be gone when the process ends
        pass


def sweep(spark: SparkSession) -> None:
    """Delete the tables that no plan reads any more."""
    for path, files in _kept[:]:
        if files.get() is None:
            _kept.remove((path, files))
            _remove(spark, path)


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` computed now and kept as a table; plans on top start from its files, so a lost executor costs a re-read.
    The files go once no plan reads them, or with the process. Column names are kept; two may not be equal."""
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove_quietly, spark, path)
    fields = sorted(df.schema, key=lambda f: f.name == partition_by)
    out = spark.read.schema(type(df.schema)(list(fields))).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _kept.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(files)))
    return out
