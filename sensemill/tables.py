"""Reading tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of sf_dir; columns keep the scan to what a query needs."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one in a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="sensemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_folders: dict[str, str] = {}


def session_folder(spark: SparkSession) -> str:
    """A shared folder of this application, the same at every call. delete() takes it away at the application's end; a
    local session's goes with the process."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_folder(spark)}/sensemill-{app}"
    return _folders[app]


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the session's folder and read again, which cuts its lineage; and the path, for delete()."""
    path = f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Bytes of an Arrow batch that a Python worker gets of long texts; it holds several times that.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_BYTES from here on. A session that sets another limit than Spark's own keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(BATCH_BYTES))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
