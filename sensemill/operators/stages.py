"""A corpus build as a graph of written stages, of which a rerun does only what has changed.

A stage's output lies in a folder named by its key: a digest of its inputs' contents, its version and its name. Its manifest is
written after the output and names it; a folder without a manifest was not finished, is never read and is written anew. Contents are
known by order-free fingerprints, so a stage that is run again but gives the same rows leaves all later ones as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.tables import delete, exists


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64 bits of a row; nulls count by their place, so (null, 1) and (1, null) differ. Maps are compared as sorted entries."""
    columns = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema.fields]
    nulls = F.concat(*[F.when(F.isnull(f"`{f.name}`"), "1").otherwise("0") for f in df.schema.fields])
    return F.xxhash64(F.lit(seed), nulls, *columns)


def _sums(df: DataFrame) -> list[Column]:
    h = row_hash(df)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("total"), F.coalesce(F.bit_xor(row_hash(df, 1)), F.lit(0)).alias("xor")]


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and a digest of the multiset of rows: two sums of row hashes, whatever their order and partitions."""
    n, total, xor = df.agg(*_sums(df)).first()
    return n, hashlib.sha256(f"{df.schema.simpleString()} {n} {total} {xor}".encode()).hexdigest()


def differences(old: DataFrame, new: DataFrame, *key: str, buckets: int = 1024) -> DataFrame:
    """What a copy (new) has otherwise than its source (old): key, kind (lost, added, doubled, changed) and rows in both.

    Both are summed up by key bucket first, so only buckets whose fingerprints differ are compared row by row. Keys may be null.
    """
    bucket = F.pmod(F.xxhash64(*key, F.concat(*[F.when(F.isnull(k), "1").otherwise("0") for k in key])), F.lit(buckets)).alias("bucket")
    sums = [df.groupBy(bucket).agg(*_sums(df)) for df in (old, new)]
    a, b = sums[0], sums[1].toDF("bucket", "m", "total2", "xor2")
    off = a.join(b, "bucket", "full").where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("total").eqNullSafe(F.col("total2")) & F.col("xor").eqNullSafe(F.col("xor2")))).select("bucket")

    def rows(df: DataFrame, side: str) -> DataFrame:
        some = df.select(*key, bucket, row_hash(df).alias("h")).join(F.broadcast(off), "bucket", "left_semi")  # one row a bucket
        return some.select(*key, F.lit(side).alias("side"), "h")

    of = lambda side: F.col("side") == side
    both = rows(old, "old").unionByName(rows(new, "new")).groupBy(*key).agg(
        F.count_if(of("old")).alias("n_old"), F.count_if(of("new")).alias("n_new"), F.min(F.when(of("old"), F.col("h"))).alias("o0"), F.max(F.when(of("old"), F.col("h"))).alias("o1"),
        F.min(F.when(of("new"), F.col("h"))).alias("w0"), F.max(F.when(of("new"), F.col("h"))).alias("w1"), F.sum(F.when(of("old"), F.col("h").cast("decimal(38,0)"))).alias("so"), F.sum(F.when(of("new"), F.col("h").cast("decimal(38,0)"))).alias("sw"),
    )
    same = (F.col("o0") == F.col("w0")) & (F.col("o1") == F.col("w1"))
    kind = F.when(F.col("n_new") == 0, "lost").when(F.col("n_old") == 0, "added").when(same & (F.col("n_new") > F.col("n_old")), "doubled").when(same & (F.col("n_new") < F.col("n_old")), "lost").when(~same | (F.col("so") != F.col("sw")), "changed")
    return both.select(*key, kind.alias("kind"), "n_old", "n_new").where("kind is not null")


@dataclass(frozen=True)
class Stage:
    """run takes the tables named in inputs (of sources or earlier stages), in that order. version changes when its rule does."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]
    version: str = "1"


class Build:
    """Runs stages in a folder. done lists what the last run() wrote, skipped what it found."""

    def __init__(self, spark: SparkSession, path: str, stages: list[Stage], keep: int = 2) -> None:
        self.spark, self.path, self.stages, self.keep = spark, path, stages, keep
        self.done: list[str] = []
        self.skipped: list[str] = []

    def _manifests(self, stage: str) -> list[dict]:
        if not exists(self.spark, f"{self.path}/manifests/{stage}"):
            return []
        rows = self.spark.read.schema("value string").option("recursiveFileLookup", "true").text(f"{self.path}/manifests/{stage}").collect()  # one row a version
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["number"])

    def manifest(self, stage: str) -> dict | None:
        """The last whole output: key, path, rows, digest, inputs, number."""
        return next(reversed(self._manifests(stage)), None)

    def run(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Brings all stages up to date with the sources and returns the stages' tables."""
        self.done, self.skipped = [], []
        digest = {name: fingerprint(df)[1] for name, df in sources.items()}
        tables = dict(sources)
        for stage in self.stages:
            inputs = {i: digest[i] for i in stage.inputs}
            key = hashlib.sha256(json.dumps([stage.name, stage.version, inputs], sort_keys=True).encode()).hexdigest()[:24]
            held = self._manifests(stage.name)
            found = next((m for m in reversed(held) if m["key"] == key), None)
            if found is None:
                path = f"{self.path}/data/{stage.name}/{key}"
                stage.run(*[tables[i] for i in stage.inputs]).write.mode("overwrite").parquet(path)
                n, seen = fingerprint(self.spark.read.parquet(path))
                found = {"key": key, "path": path, "rows": n, "digest": seen, "inputs": inputs, "number": held[-1]["number"] + 1 if held else 1}
                # the manifest commits the stage
                self.spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{stage.name}/{key}")
                self.done.append(stage.name)
                for old in held[: max(0, len(held) + 1 - self.keep)]:  # the newest versions stay
                    delete(self.spark, f"{self.path}/manifests/{stage.name}/{old['key']}")
                    delete(self.spark, old["path"])
            else:
                self.skipped.append(stage.name)
            tables[stage.name], digest[stage.name] = self.spark.read.parquet(found["path"]), found["digest"]
        return {s.name: tables[s.name] for s in self.stages}
