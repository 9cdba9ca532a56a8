"""Embedding generation: pending work by digest, an injected encoder in Arrow batches, versioned results."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.tables import delete, staged

VERSION = "emb-v1"
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dims: int) -> Encoder:
    """Signed word hashes, unit length: deterministic, for tests and for machines without a model."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(out[i])
            out[i] /= n or 1
        return out

    return encode


def pending(recipes: DataFrame, stored: DataFrame) -> DataFrame:
    """Recipes (key, text) with their digest whose stored digest (key, sha, version) is missing, stale or of another version."""
    own = recipes.select("key", "text", F.sha2("text", 256).alias("sha"))
    held = stored.where(F.col("version") == VERSION).select("key", F.col("sha").alias("__had"))
    return own.join(held, "key", "left").where(~F.col("__had").eqNullSafe(F.col("sha"))).drop("__had")


def generate(work: DataFrame, encoder: Encoder, dims: int, batch: int = 64) -> DataFrame:
    """key, sha, embedding, dims, version, failed. A batch that the encoder can't take is marked failed, not fatal, so a
    rerun finds it pending again. Tasks are independent: a lost one is simply repeated."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                try:
                    vectors, failed = [v.astype(np.float32).tolist() for v in encoder(part["text"].tolist())], False
                except Exception:  # noqa: BLE001  the encoder is foreign code
                    vectors, failed = [None] * len(part), True
                yield pd.DataFrame({"key": part["key"], "sha": part["sha"], "embedding": vectors, "dims": dims, "version": VERSION, "failed": failed})

    kind = dict(work.dtypes)["key"]
    return work.select("key", "text", "sha").mapInPandas(run, f"key {kind}, sha string, embedding array<float>, dims int, version string, failed boolean")


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The store after a run: new vectors in place of old, other versions gone."""
    good = new.where(~F.col("failed")).select(*stored.columns)
    return stored.where(F.col("version") == VERSION).join(good.select("key"), "key", "left_anti").select(*stored.columns).unionByName(good)


def problems(result: DataFrame, dims: int) -> DataFrame:
    """What is wrong with a result set before it is loaded: wrong version or length, repeated keys."""
    again = result.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("repeated").alias("problem"))
    wrong = F.when(F.col("version") != VERSION, "version").when(F.size("embedding") != dims, "length")
    return result.select("key", wrong.alias("problem")).where("problem is not null").unionByName(again)


class Store:
    """Vectors of a version as a table of written batches: a key's last vector counts. A batch's folder is overwritten as a
    whole, so a batch that is run again leaves the same store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, kind: str, schema: str, before: float = math.inf) -> DataFrame:
        """The rows of all whole batches before one. A batch without its _SUCCESS was not finished and will be run again."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [f"{self.path}/{kind}/{n}" for n in names if int(n.removeprefix("batch=")) < before and fs.exists(jvm.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def vectors(self) -> DataFrame:
        """key, sha, embedding, dims, version: the last good vector of each key in VERSION."""
        rows = self._read("vectors", "key string, sha string, embedding array<float>, dims int, version string, batch long").where(F.col("version") == VERSION)
        last = F.max_by(F.struct("sha", "embedding", "dims", "version"), "batch").alias("v")
        return rows.groupBy("key").agg(last).select("key", "v.*")

    def failures(self, before: float = math.inf) -> DataFrame:
        """key, text, batch of recipes whose last try failed."""
        rows = self._read("failures", "key string, text string, sha string, batch long", before)
        last = rows.groupBy("key").agg(F.max_by(F.struct("text", "sha", "batch"), "batch").alias("f")).select("key", "f.*")
        done = self._read("vectors", "key string, batch long", before).groupBy("key").agg(F.max("batch").alias("since"))
        return last.join(done, "key", "left").where("since is null or since < batch").select("key", "text", "batch")

    def put(self, recipes: DataFrame, batch: int, encoder: Encoder, dims: int, at_once: int = 64) -> None:
        """Encodes what is pending among recipes (key, text) and what failed before, and writes it as this batch. Nothing of
        this batch or later ones is read, so a batch that is run again starts from the same store."""
        again = self.failures(batch).select("key", "text")
        rows = again.join(recipes.select("key"), "key", "left_anti").unionByName(recipes.select("key", "text"))
        held = self._read("vectors", "key string, sha string, version string, batch long", batch)
        held = held.groupBy("key").agg(F.max_by(F.struct("sha", "version"), "batch").alias("v")).select("key", "v.*")
        work = pending(rows, held)
        made, path = staged(generate(work, encoder, dims, at_once), "encoded")
        made.where("not failed").drop("failed").withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/vectors/batch={batch}")
        missed = made.where("failed").select("key").join(work, "key").withColumn("batch", F.lit(batch).cast("long"))
        missed.write.mode("overwrite").parquet(f"{self.path}/failures/batch={batch}")
        delete(self.spark, path)


def generated_stream(recipes: DataFrame, store: Store, checkpoint: str, encoder: Encoder, dims: int, at_once: int = 64):
    """Keeps a store up with a stream of recipes (key, text), a trigger at a time: a batch is in the store before the
    checkpoint advances, so a run that is stopped in between does that batch again, with the same result.

    Returns the writer to start: available_now triggers work off what is there.
    """

    def put(rows: DataFrame, batch: int) -> None:
        one = rows.groupBy("key").agg(F.max("text").alias("text"))  # a key's last texts of one trigger have no order
        store.put(one, batch, encoder, dims, at_once)

    return recipes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
