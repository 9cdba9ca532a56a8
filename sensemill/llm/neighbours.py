"""Approximate nearest neighbours: a small-world graph for each shard, shard results merged.

Equal vectors are one point. Points of one length are dealt to shards by hash; a shard's graph is built
in one task of bounded size and stored as flat arrays, cut in pieces. A shard's pieces and the blocks of
queries then meet in sorted order: a task takes up a graph once and streams queries past it. The best
points of all shards are merged by exact inner products in double precision.

Distances are Euclidean over vectors with one more component, which makes all points equally long, so
nearest there means largest inner product, whatever the norms are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hnsw
from .common import map_arrow, written

#: A shard has at most about so many points (some 14 MB with its graph at 64 dimensions). Larger ones need wider
#: beams for the same recall. Up to LEAST_SHARDS are made before shards get more than LEAST_ROWS, so that small
#: tables too use several cores.
SHARD_ROWS, LEAST_SHARDS, LEAST_ROWS = 32_768, 8, 8_192
QUERY_BLOCK, PIECE_BYTES = 1_024, 4 << 20
K_BEST, BEAM, QUERY_EVERY = 20, 192, 20
#: The table of vector lengths is sent to every executor up to so many of them.
MOST_LENGTHS_SENT = 10_000

_INDEX = "dims int, shard int, part int, piece binary"


def _index(key: tuple, rows: pa.Table) -> pa.Table:
    """The graph of one shard, as pieces: node ids, vectors, and the arrays of its layers, flat."""
    node = rows.column("node").to_numpy()
    x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
    level = hnsw.levels(rows.column("h").to_numpy().view(np.uint64))
    order = np.lexsort((node, -level))
    node, x, level = node[order], x[order], level[order]
    square = (x.astype(np.float64) ** 2).sum(1)
    extra = np.sqrt(np.maximum(rows.column("longest")[0].as_py() - square, 0)).astype(np.float32)
    graph = hnsw.build(np.ascontiguousarray(np.column_stack([x.astype(np.float32), extra])), level)
    out = io.BytesIO()
    for a in (node, x, extra, *graph.layers):
        np.save(out, a, allow_pickle=False)
    raw = out.getvalue()
    pieces = [raw[a : a + PIECE_BYTES] for a in range(0, len(raw), PIECE_BYTES)]
    dims, shard = (pa.array([k.as_py()] * len(pieces), pa.int32()) for k in key)
    return pa.table([dims, shard, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["dims", "shard", "part", "piece"])


def _graph(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, hnsw.Graph]:
    raw, arrays = b"".join(pieces), []
    f = io.BytesIO(raw)
    while f.tell() < len(raw):
        arrays.append(np.load(f, allow_pickle=False))
    node, x, extra, *layers = arrays
    return node, x, hnsw.Graph(np.ascontiguousarray(np.column_stack([x.astype(np.float32), extra])), layers)


def _searcher(k: int, beam: int):
    """Rows come in the order of shard: its pieces, then blocks of queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                piece, queries = batch.column("piece")[i], batch.column("queries")[i]
                if piece.is_valid:
                    if held is not None:
                        pieces, held = [], None
                    pieces.append(piece.as_py())
                    continue
                if held is None:
                    held, pieces = _graph(pieces), []
                node, x, graph = held
                asked = queries.values.field("node").to_numpy()
                q = queries.values.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
                ids, _ = graph.search(np.column_stack([q.astype(np.float32), np.zeros(len(q), np.float32)]), beam)
                some, at = ids >= 0, np.maximum(ids, 0)
                score = np.where(some, np.einsum("qkd,qd->qk", x[at].astype(np.float64), q.astype(np.float64)), -np.inf)
                order = np.lexsort((node[at], -score), axis=1)[:, :k]
                ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, keep.sum(1))), pa.array(node[ids[keep]]), pa.array(score[keep])], ["query", "node", "score"])

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (of floats or doubles) and its length dims, of the rows that take part."""
    e = F.col("embedding")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(f"array<{kind}>").alias("embedding"))
    return rows.where("vec_id is not null and embedding is not null").where(~bad & F.exists(e, lambda v: v != 0)).withColumn("dims", F.size("embedding"))


def nearest(vectors: DataFrame, k: int = K_BEST, every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, beam: int = BEAM, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) with the largest inner product for each row whose vec_id
    is divisible by `every`: query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those of the query's own vec_id; ties go to the smaller vec_id. Inner
    products exist between vectors of one length only, so each length is searched on its own. Vectors that
    are null, zero, or hold null or non-finite components, and rows with a null vec_id, take no part. Rows
    that repeat vec_id and vector count once. No usable rows give no rows.
    """
    spark = vectors.sparkSession
    rows, _ = written(usable(vectors), "vectors")
    first = rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.first("dims").alias("dims"))
    points, _ = written(first.withColumn("h", F.xxhash64("node", F.lit(7))), "points")
    of_node = rows.join(points.select("embedding", "node"), "embedding").select("node", "vec_id").distinct()
    copies = of_node.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= k + 1).select("node", "vec_id")
    asking, _ = written(of_node.where(F.col("vec_id") % every == 0).select("vec_id", "node"), "asking")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    wanted = F.ceil(F.col("n") / F.lit(shard_rows))
    small = F.least(F.lit(least_shards), F.ceil(F.col("n") / F.lit(min(LEAST_ROWS, shard_rows))))
    plan, _ = written(points.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).withColumn("shards", F.greatest(wanted, small).cast("int")), "shards")
    lengths, shards = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("shards"), F.lit(1))).first()
    by_length = F.broadcast(plan) if lengths <= MOST_LENGTHS_SENT else plan
    shard = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard")
    dealt = points.join(by_length, "dims").select("dims", shard, "node", "h", "longest", "embedding").repartition(shards, "dims", "shard")
    index, _ = written(dealt.groupBy("dims", "shard").applyInArrow(_index, _INDEX), "index")
    queries = points.join(asking.select("node").distinct(), "node")
    blocks = (
        queries.join(by_length, "dims").join(queries.groupBy("dims").agg(F.count(F.lit(1)).alias("asked")), "dims")
        .withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("asked") / QUERY_BLOCK)).cast("int"))
        .groupBy("dims", "part", "shards").agg(F.collect_list(F.struct("node", "embedding")).alias("queries"))
    )
    # Each shard's queries are split, and its graph repeated, where there are fewer shards than cores.
    splits = max(1, spark.sparkContext.defaultParallelism // shards)
    told = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("dims", "shard", (F.col("part") % splits).alias("split"), F.lit(1).alias("kind"), "part", F.lit(None).cast("binary").alias("piece"), "queries")
    graphs = index.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).select("dims", "shard", "split", F.lit(0).alias("kind"), "part", "piece")
    meeting = graphs.unionByName(told, allowMissingColumns=True).repartition(shards * splits, "dims", "shard", "split").sortWithinPartitions("dims", "shard", "split", "kind", "part")
    best = map_arrow(meeting, _searcher(k + 1, beam), "query long, node long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    best = best.withColumn("n", rank).where(F.col("n") <= k + 1)
    out = (
        best.join(asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "query")
        .join(copies, "node").where("vec_id <> query_id")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
