"""From dictionary entries to sense candidates, and from clusters of candidates to master senses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensemill.functions import text as X
from sensemill.functions.score import LEVELS, ordinal


def candidates(entries: DataFrame) -> DataFrame:
    """A row per glossed sense of the processed entries of a dictionary dump; what belongs to the word goes to each of its senses."""
    e = entries.where("verdict = 'processed'").select("word", "pos", "polish", F.posexplode("senses").alias("n", "s"))
    gloss = X.clean_gloss(F.col("s.gloss"))
    return e.withColumn("gloss", gloss).where("gloss <> ''").select(
        F.col("word").alias("headword"), X.search_key(F.col("word")).alias("key"), X.canonical_pos(F.col("pos")).alias("pos"), "n", "gloss",
        X.significant_tokens(X.search_key(F.col("gloss"))).alias("tokens"), F.col("s.examples").alias("examples"), F.col("s.tags").alias("tags"),
        F.concat(F.col("polish"), X.inline_polish(F.col("s.gloss"))).alias("translations"),
    )


def best_translations(rows: DataFrame, key: str) -> DataFrame:
    """(key, text, method, confidence): of one text and method the best confidence, ordered best first."""
    best = rows.groupBy(key, F.lower("text").alias("__t"), "method").agg(F.max(F.struct("confidence", "text")).alias("b"))
    item = F.struct((-F.col("b.confidence")).alias("minus"), F.col("b.text").alias("text"), F.col("method"))
    ordered = F.array_sort(F.collect_list(item))
    return best.groupBy(key).agg(ordered.alias("translations"))


def merged(members: DataFrame, cluster: str, order: Column) -> DataFrame:
    """A master sense per cluster: the first member's display forms, the smallest gloss, united lists."""

    def united(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

    return members.groupBy(cluster).agg(
        F.min_by("headword", order).alias("headword"), F.min_by("pos", order).alias("pos"), F.min("gloss").alias("gloss"), united("examples").alias("examples"),
        united("tags").alias("tags"), united("translations").alias("translations"), F.count(F.lit(1)).alias("members"),
    )


def reconcile_levels(evidence: DataFrame, key: str) -> DataFrame:
    """One level from evidence (key, level, source, pos_matches): that of the same part of speech first, any other at 0.85 at most;
    agreement gives 0.95 from several sources and 0.85 from one, a conflict the highest level at 0.50."""
    rank = ordinal(F.col("level"), LEVELS)
    e = evidence.withColumn("__rank", rank).where("__rank is not null")
    own = e.groupBy(key, "pos_matches").agg(F.min("__rank").alias("lo"), F.max("__rank").alias("hi"), F.min("source").alias("s0"), F.max("source").alias("s1"))
    best = own.groupBy(key).agg(F.max(F.struct("pos_matches", "lo", "hi", "s0", "s1")).alias("b")).select(key, "b.*")
    conflict = F.col("lo") != F.col("hi")
    confidence = F.when(conflict, 0.50).when(F.col("s0") != F.col("s1"), 0.95).otherwise(0.85)
    rule = F.concat(F.when(F.col("pos_matches"), "").otherwise("pos-mismatch:"), F.when(conflict, "conflict").when(F.col("s0") != F.col("s1"), "agreement").otherwise("single"))
    return best.select(
        key, F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("hi").cast("int")).alias("level"),
        F.when(F.col("pos_matches"), confidence).otherwise(F.least(confidence, F.lit(0.85))).alias("confidence"), rule.alias("rule"), conflict.alias("conflict"),
    )
