"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # narrow rows take some 25 times their compressed size in the sorts and hash maps of a task: small targets bound its memory
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PACKAGE = Path(__file__).resolve().parent


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC clock, adaptive execution) and send the package to the workers."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: a zip in the shared folder, added to their path."""
    context = spark.sparkContext
    if getattr(context, "_cutledger_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/cutledger/{PACKAGE.name}-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path.toString())
    context._cutledger_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where the session names none, only a local session gets a folder, since its driver and tasks share one machine; elsewhere this is an
    error, as executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{os.environ.get('CUTLEDGER_SHARED', '/tmp/cutledger')}/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root."""
    return f"{shared_root(spark).rstrip('/')}/cutledger/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the reliable checkpoint folder, so that a lost executor costs one re-read."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Queries that start within remove the files of their shuffles when they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back, so that what follows reads the columns it needs instead of working them out again.

    What was shuffled for it is removed at once.
    """
    path = shared_path(df.sparkSession, label)
    with _freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
