"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_marked: set[str] = set()
#: Spark then deletes the shuffle files of a write as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of rows that go to a Python worker together.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES, which whole texts fill long before Spark's own bounds: what a task holds of them, in the JVM and in Python, is then a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="pagelens-")
    return _own[context.applicationId]


def _application_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it is deleted when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark).rstrip('/')}/pagelens-{context.applicationId}"
    if folder not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _marked.add(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here and outlives lost executors."""
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by `stored` that no later step reads."""
    for df in tables:
        if df is None:
            continue
        jvm = df.sparkSession._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for parent in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)
