"""Connected components as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (u, v) longs, any order, repeats and loops allowed. Returns (node, root) for every
    node with a link; root is the smallest node that links lead to.

    Large-star and small-star steps take turns: a logarithmic number of rounds, no list of
    neighbours is ever gathered, and each round is a written table.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, path = written(e, name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        new, to = written(small, name)
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, path)
        e, path = new, to
        if mark == before:
            break
        before = mark
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
