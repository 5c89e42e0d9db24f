"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and their lower-case forms: the only letters that normalisation folds.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Arrow batches stay small even when single texts are long.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to a number of rows and bytes, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all
    executors are threads of this machine's one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a written table; silent only when the session has ended before us."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Written tables and a weak reference each to the list of files that all plans over the table share.
_tables: list[tuple[str, object]] = []


def _sweep(spark: SparkSession) -> None:
    """Delete the tables that no plan reads any more, as the engine does with its own checkpoints."""
    for path, ref in _tables[:]:
        if ref.get() is None:
            _tables.remove((path, ref))
            _remove(spark, path)


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs a
    re-read. The files go once no DataFrame over them is left, when :func:`release` says so, or with the process."""
    spark = df.sparkSession
    _sweep(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    atexit.register(_quiet_remove, spark, path)
    schema = df.schema
    if partition_by:
        schema = type(schema)([f for f in schema if f.name != partition_by] + [f for f in schema if f.name == partition_by])
    out = spark.read.schema(schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _tables.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(files)))
    out.written_to = path
    return out


def release(*tables: DataFrame, part: str = "") -> None:
    """Delete tables that :func:`written` gave, or the ``part`` folder of them: no plan over them may run again."""
    for df in tables:
        _remove(df.sparkSession, f"{df.written_to}/{part}".rstrip("/"))


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may already be gone at interpreter exit
        pass


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as no column of ``df`` has (names in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, UPPER.lower())


def ascii_lower_bytes(column):
    """Lower-case A-Z in a binary column; one character a byte, so cuts inside a UTF-8 character do no harm."""
    return F.translate(F.decode(column, "ISO-8859-1"), UPPER, UPPER.lower())
