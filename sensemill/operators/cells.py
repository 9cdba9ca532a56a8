"""Range search over vectors by cosine distance, exact, over cells that a distance bound prunes.

Vectors are stored by the nearest of some centres, each with its distance to it. On the unit sphere cosine distance
d is Euclidean distance sqrt(2 d), for which the triangle inequality holds: a vector within r of the query is between |query - centre| - r
and |query - centre| + r from its centre. So a search reads the folders of the cells whose shell meets that range, skips rows
outside it, and measures the rest exactly. No vector is missed, whatever the centres are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensemill.functions import score as S
from sensemill.tables import delete, staged

#: Centres, taken from so many vectors at most: those with the smallest hashes of their id. Both only bear on the work.
CELLS, SAMPLE = 64, 4096
#: Added to every bound, far above the rounding of doubles.
SLACK = 1e-6


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows as unit vectors, and which of them are usable."""
    lists = column.to_pylist()
    width = max((len(v) for v in lists if v is not None), default=0)
    x = np.array([v if v is not None and len(v) == width and None not in v else [0.0] * width for v in lists], float).reshape(len(lists), width)
    with np.errstate(invalid="ignore"):
        n = np.linalg.norm(x, axis=1)
        good = np.isfinite(n) & (n > 0)
        x[good] /= n[good, None]
    return x, good


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of unit vectors x, spread by farthest points and moved once to the mean of what is nearest to them."""
    if not len(x):
        return x
    at, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < min(k, len(x)):
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    c = x[at]
    near = (x @ c.T).argmax(1)
    return np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])


class Cells:
    """Vectors in a folder, by cell. build() writes it; within() only reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, id_: str, vector: str, cells: int = CELLS) -> Cells:
        """Stores every row of vectors with its columns; those whose vector is null, zero, not finite or of another length than the
        centres have no direction and are left out."""
        usable = F.col(vector).isNotNull()
        few = vectors.where(usable).select(id_, vector).orderBy(F.xxhash64(id_), id_).limit(SAMPLE).select(vector).toArrow()
        x, good = _unit(few.column(0).combine_chunks()) if few.num_rows else (np.zeros((0, 0)), np.zeros(0, bool))
        centres = _centres(x[good], cells)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(vector)
                right = pa.array([v is not None and len(v) == centres.shape[1] for v in column.to_pylist()])
                batch = batch.filter(right)
                if not batch.num_rows or not len(centres):
                    continue
                x, good = _unit(batch.column(vector))
                cell = (2 * x @ centres.T - (centres**2).sum(1)).argmax(1)
                radius = np.linalg.norm(x - centres[cell], axis=1)
                rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(radius), pa.array(cell.astype(np.int32))], [*batch.schema.names, "radius", "cell"])
                yield rows.filter(pa.array(good))

        schema = T.StructType([*vectors.schema.fields, T.StructField("radius", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        placed, path = staged(vectors.mapInArrow(assign, schema), "placed")
        self.spark.createDataFrame([(schema.json(),)], "columns string").write.mode("overwrite").parquet(f"{self.path}/columns")
        shells = placed.groupBy("cell").agg(F.min("radius").alias("least"), F.max("radius").alias("most"), F.count(F.lit(1)).alias("n"))
        at = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        shells.join(F.broadcast(at), "cell").write.mode("overwrite").parquet(f"{self.path}/shells")
        # a cell's rows lie in several partitions if they are many; inside them by radius, so that row groups are skipped too
        placed.repartitionByRange("cell", "radius").sortWithinPartitions("cell", "radius").write.partitionBy("cell").mode("overwrite").parquet(f"{self.path}/rows")
        delete(self.spark, path)
        return self

    def reached(self, query: Sequence[float], cutoff: float) -> list[tuple[int, float]]:
        """Cells that may hold a vector within the cutoff, and their centres' distances from the query."""
        q = np.array(query, float)
        q, r = q / np.linalg.norm(q), float(np.sqrt(2 * max(0.0, cutoff))) + SLACK
        out = []
        for s in self.spark.read.parquet(f"{self.path}/shells").collect():  # one row a cell
            d = float(np.linalg.norm(q - np.array(s["centre"])))
            if s["least"] <= d + r and s["most"] >= d - r:
                out.append((s["cell"], d))
        return out

    def within(self, query: Sequence[float], vector: str, cutoff: float, scope: Column | None = None) -> DataFrame:
        """All stored rows within that cosine distance of the query that are in scope, with their distance: as a scan of all
        vectors gives, from the cells that are reached only."""
        r = float(np.sqrt(2 * max(0.0, cutoff))) + SLACK
        schema = T.StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.path}/columns").first()["columns"]))
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        cells = self.reached(query, cutoff)
        shell = F.lit(False)
        for cell, d in cells:
            shell = shell | ((F.col("cell") == cell) & F.col("radius").between(d - r, d + r))
        rows = rows.where(F.col("cell").isin([c for c, _ in cells]) & shell)
        if scope is not None:
            rows = rows.where(scope)
        q = F.array(*[F.lit(float(x)) for x in query])
        return rows.drop("cell", "radius").withColumn("distance", S.cosine_distance(F.col(vector), q)).where(F.col("distance") <= cutoff)
