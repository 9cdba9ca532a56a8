"""Keyed writes as DataFrame merges. Parquet has no in-place update: each gives the whole new table,
to be written beside the old one and swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new replace those of old with the same key; the rest of old stays."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new.select(*old.columns))


def upsert_report(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """One row: inserted and updated, by distinct key."""
    keys = new.select(*key).distinct()
    had = keys.join(old.select(*key).distinct().withColumn("__had", F.lit(True)), list(key), "left")
    return had.agg(F.count_if(F.col("__had").isNull()).alias("inserted"), F.count_if("__had").alias("updated"))


def insert_ignore(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Only new keys are added; of new rows with one key the first by all columns."""
    first = new.select(*old.columns).groupBy(*key).agg(F.min(F.struct(*[c for c in old.columns if c not in key])).alias("__r"))
    first = first.select(*key, "__r.*").select(*old.columns)
    return old.unionByName(first.join(old.select(*key), list(key), "left_anti"))


def delete_refresh(child: DataFrame, touched: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All child rows of the touched parents go, the new ones come."""
    return child.join(touched.select(key), key, "left_anti").unionByName(new.select(*child.columns))


def referential(child: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent is known, and the others."""
    known = parents.select(key)
    return child.join(known, key, "left_semi"), child.join(known, key, "left_anti")


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes df beside path and then puts it in path's place, so that df may read path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, new, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".new", ".old"))
    fs = target.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def without_implied_tops(links: DataFrame) -> DataFrame:
    """Category links (sense_id, top, sub) less those to a top class of which the sense has a sub class (sub is '' for a top)."""
    subs = links.where("sub <> ''").select("sense_id", "top")
    return links.where("sub <> ''").unionByName(links.where("sub = ''").join(subs, ["sense_id", "top"], "left_anti").select(*links.columns))


def with_current(root: DataFrame, history: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """root with the columns of the current version in place of its own; keys without one get nulls."""
    current = history.where(F.col("version") == version).select(key, *columns)
    return root.drop(*columns).join(current, key, "left")
