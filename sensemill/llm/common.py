"""What the operators of this subpackage share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in Arrow batches of at most BATCH_BYTES, so that 10,000 long texts do not meet in one batch.

    A session that sets another limit than Spark's own keeps it.
    """
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, which becomes its checkpoint folder;
    on a cluster, whose executors would each write to their own disk, that is an error.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sensemill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Deletes, at its end, the tables that written() made inside it, but for those named in keep by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            if path not in keep:
                drop(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after which only those tables of its own are left that its result still reads."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keep: list[str] = []
        with scratch(spark, keep):
            out = query(spark, sf_dir)
            read = {name for f in out.inputFiles() for name in f.split("/")}
            keep += [p for p in _made.get() or [] if p.rsplit("/", 1)[-1] in read]
        return out

    return run


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what written() left, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
