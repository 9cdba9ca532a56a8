"""Audit of stored priorities, and seeded samples of their strata for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensemill.functions import score as S

#: Differences up to this are rounding.
TOLERANCE = 1e-9
#: A level's mean is told from so many senses on.
LEAST_OF_LEVEL = 100
COMPONENTS = ("frequency", "learner", "polish", "quality", "penalty")


def checks(rows: DataFrame, least: int = LEAST_OF_LEVEL) -> DataFrame:
    """(check, item, n, value) over rows (key, score, level, cefr, and the components frequency, learner, polish, quality, penalty).

    level: rows whose level is not that of their score. recompute: rows whose score is not that of their components. inversions:
    neighbours by frequency that differ in nothing else, of which the more frequent scores lower. mean: of rows with and without a
    penalty, and of each level of `least` rows or more. neutral: rows all of whose components say nothing, by their level.
    """
    again = S.priority_score(*[F.col(c) for c in COMPONENTS])
    neutral = (F.col("penalty") == 1) & (F.col("frequency") == 0.5) & (F.col("learner") == 0.5) & (F.col("polish") == 0.5) & (F.col("quality") == 0.0)
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("level").eqNullSafe(S.priority_level(F.col("score")))).alias("level"),
        F.count_if(~F.coalesce(F.abs(again - F.col("score")) <= TOLERANCE, F.lit(False))).alias("recompute"),
        F.count_if(F.col("penalty") < 1).alias("flagged"), F.avg(F.when(F.col("penalty") < 1, F.col("score"))).alias("flagged_mean"),
        F.count_if(F.col("penalty") == 1).alias("clean"), F.avg(F.when(F.col("penalty") == 1, F.col("score"))).alias("clean_mean"),
    )
    none = F.lit(None).cast("double")
    said = [("rows", "all", F.col("rows"), none), ("level", "mismatch", F.col("level"), none), ("recompute", "mismatch", F.col("recompute"), none), ("mean", "flagged", F.col("flagged"), F.col("flagged_mean")), ("mean", "clean", F.col("clean"), F.col("clean_mean"))]
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.lit(i).alias("item"), n.alias("n"), F.round(v, 6).alias("value")) for c, i, n, v in said])).alias("x")).select("x.*")
    # equal frequencies of a stratum are one neighbour, with its extremes; strata are as many as components have values
    same = rows.groupBy("learner", "polish", "quality", "penalty", "frequency").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    before = F.lag("high").over(Window.partitionBy("learner", "polish", "quality", "penalty").orderBy("frequency"))
    down = same.withColumn("before", before).agg(F.count_if(F.col("low") < F.col("before") - TOLERANCE).alias("n"))
    out = out.unionByName(down.select(F.lit("inversions").alias("check"), F.lit("frequency").alias("item"), "n", none.alias("value")))
    by = rows.where("cefr is not null").groupBy("cefr").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("value")).where(F.col("n") >= least)
    out = out.unionByName(by.select(F.lit("mean").alias("check"), F.col("cefr").alias("item"), "n", "value"))
    still = rows.where(neutral).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(still.select(F.lit("neutral").alias("check"), F.col("level").alias("item"), "n", none.alias("value")))


def samples(rows: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    """k rows of each stratum by the smallest digests of seed and key: the same for a seed, whatever the partitions.

    The ranks' limit is applied in each map task before the shuffle, so a stratum sends k rows a task.
    """
    return _first(rows, stratum, k, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key))


def boundary(rows: DataFrame, key: str, stratum: str, k: int, lowest: bool) -> DataFrame:
    """The k rows of each stratum with the lowest, or the highest, scores."""
    return _first(rows, stratum, k, F.col("score").asc() if lowest else F.col("score").desc(), F.col(key))


def _first(rows: DataFrame, stratum: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("place") <= k)
