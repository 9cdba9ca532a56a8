"""Reconciled evidence, merged clusters, embeddings, profiles and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.operators import audit, embed, normalise
from sensemill.registry import query
from sensemill.tables import table


@query(
    "evidence_reconcile",
    """WITH e AS (SELECT o_custkey AS k, ['A1','A2','B1','B2','C1'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS level, o_orderstatus AS source, o_orderkey % 3 = 0 AS own FROM orders),
        g AS (SELECT k, own, min(level) AS lo, max(level) AS hi, count(DISTINCT source) AS sources FROM e GROUP BY k, own),
        b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY own DESC) = 1)
        SELECT k, hi AS level, (CASE WHEN own THEN c ELSE least(c, 0.85) END)::DOUBLE AS confidence,
          CASE WHEN own THEN '' ELSE 'pos-mismatch:' END || CASE WHEN lo <> hi THEN 'conflict' WHEN sources > 1 THEN 'agreement' ELSE 'single' END AS rule, lo <> hi AS conflict
        FROM (SELECT *, CASE WHEN lo <> hi THEN 0.5 WHEN sources > 1 THEN 0.95 ELSE 0.85 END AS c FROM b)""",
)
def evidence_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    level = F.element_at(F.array(*[F.lit(x) for x in S.LEVELS]), F.substring("o_orderpriority", 1, 1).cast("int"))
    e = o.select(F.col("o_custkey").alias("k"), level.alias("level"), F.col("o_orderstatus").alias("source"), (F.col("o_orderkey") % 3 == 0).alias("pos_matches"))
    return normalise.reconcile_levels(e, "k")


@query(
    "translations_merged",
    """WITH b AS (SELECT l_orderkey AS k, lower(l_shipmode) AS t, l_linestatus AS method, max(l_discount) AS c FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'Bank' ELSE 'brzeg' END AS l_shipmode FROM lineitem) GROUP BY ALL)
        SELECT k, string_agg(t || '/' || method || '/' || CAST(round(c * 100) AS INTEGER), ',' ORDER BY c DESC, t, method) AS translations FROM b GROUP BY k""",
)
def translations_merged(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linestatus", "l_discount")
    rows = li.select(
        F.col("l_orderkey").alias("k"), F.when(F.col("l_partkey") % 2 == 0, "bank").otherwise("brzeg").alias("text"), F.col("l_linestatus").alias("method"), F.col("l_discount").alias("confidence")
    )
    out = normalise.best_translations(rows, "k")
    shown = F.transform("translations", lambda x: F.concat_ws("/", x["text"], x["method"], F.round(-x["minus"] * 100).cast("int")))
    return out.select("k", F.array_join(shown, ",").alias("translations"))


@query(
    "clusters_merged",
    """SELECT p_name, min(p_brand) AS gloss, count(*) AS members, first(p_type ORDER BY p_partkey) AS pos, list_aggregate(list_sort(list_distinct(list(p_type))), 'string_agg', ',') AS tags FROM part GROUP BY p_name""",
)
def clusters_merged(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    m = p.select(
        "p_name", "p_partkey", F.col("p_name").alias("headword"), F.col("p_type").alias("pos"), F.col("p_brand").alias("gloss"), F.array("p_type").alias("tags"),
        F.array().cast("array<string>").alias("examples"), F.array().cast("array<string>").alias("translations"),
    )
    out = normalise.merged(m, "p_name", F.col("p_partkey"))
    return out.select("p_name", "gloss", "members", "pos", F.array_join("tags", ",").alias("tags"))


@query("embedding_generate")
def embedding_generate(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of every conversation line by the hashing encoder; nothing is stored yet, so all are pending."""
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    stored = spark.createDataFrame([], "key string, sha string, version string")
    return embed.generate(embed.pending(c, stored), embed.hashing_encoder(32), 32)


@query(
    "priority_audit",
    """WITH s AS (SELECT p_partkey, p_type, p_size, p_retailprice, lag(p_retailprice) OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) AS before FROM part)
        SELECT p_type, count(*) AS n, round(avg(p_retailprice), 4) AS mean, count(*) FILTER (WHERE before > p_retailprice) AS inversions FROM s GROUP BY p_type""",
)
def priority_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Means per group, and neighbours inside a stratum whose scores run against the order."""
    before = F.lag("p_retailprice").over(Window.partitionBy("p_type", "p_size").orderBy("p_partkey"))
    s = table(spark, sf, "part", "p_partkey", "p_type", "p_size", "p_retailprice").withColumn("before", before)
    return s.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.count_if(F.col("before") > F.col("p_retailprice")).alias("inversions"))


_STORED = """(SELECT p_partkey AS key, p_type AS t, ['A1','A2','B1','B2','C1','C2'][1 + p_size % 6] AS cefr, (p_partkey % 10 + 1) / 20.0::DOUBLE AS frequency, CASE p_size % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS learner,
    0.5::DOUBLE AS polish, CASE WHEN p_size % 2 = 0 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS quality, CASE WHEN p_type = 'PROMO' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS penalty FROM part)"""
_SCORED = f"(SELECT *, round(least(1.0, (0.35::DOUBLE * frequency + 0.15::DOUBLE * learner + 0.2::DOUBLE * polish + 0.3::DOUBLE * quality) * penalty) + 1e-9, 4) AS again FROM {_STORED})"
_AUDITED = f"""(SELECT *, CASE WHEN key % 97 = 0 THEN again + 0.05 ELSE again END AS score, CASE WHEN key % 89 = 0 THEN 'HIGH' WHEN again >= 0.7 THEN 'VERY HIGH' WHEN again >= 0.55 THEN 'HIGH' WHEN again >= 0.4 THEN 'MEDIUM' WHEN again >= 0.25 THEN 'LOW' ELSE 'VERY LOW' END AS level FROM {_SCORED})"""


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    """Stored priorities of which some scores and some levels are wrong."""
    p = table(spark, sf, "part", "p_partkey", "p_type", "p_size")
    size = F.col("p_size")
    c = p.select(
        F.col("p_partkey").alias("key"), F.get(F.array(*[F.lit(x) for x in S.LEVELS]), size % 6).alias("cefr"), ((F.col("p_partkey") % 10 + 1) / 20.0).alias("frequency"), F.when(size % 3 == 0, 1.0).when(size % 3 == 1, 0.9).otherwise(0.5).alias("learner"),
        F.lit(0.5).alias("polish"), F.when(size % 2 == 0, 0.0).otherwise(0.7).alias("quality"), F.when(F.col("p_type") == "PROMO", 0.5).otherwise(1.0).alias("penalty"),
    )
    c = c.withColumn("score", S.priority_score(*[F.col(x) for x in audit.COMPONENTS])).withColumn("level", F.when(F.col("key") % 89 == 0, "HIGH").otherwise(S.priority_level(F.col("score"))))
    return c.withColumn("score", F.when(F.col("key") % 97 == 0, F.col("score") + 0.05).otherwise(F.col("score")))


@query(
    "audit_checks",
    f"""WITH a AS (SELECT *, CASE WHEN score >= 0.7 THEN 'VERY HIGH' WHEN score >= 0.55 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score >= 0.25 THEN 'LOW' ELSE 'VERY LOW' END AS right_level FROM {_AUDITED}),
        s AS (SELECT learner, polish, quality, penalty, frequency, min(score) AS low, max(score) AS high FROM a GROUP BY ALL), n AS (SELECT low, lag(high) OVER (PARTITION BY learner, polish, quality, penalty ORDER BY frequency) AS before FROM s)
        SELECT 'rows' AS "check", 'all' AS item, count(*) AS n, NULL::DOUBLE AS value FROM a UNION ALL SELECT 'level', 'mismatch', count(*) FILTER (WHERE level <> right_level), NULL FROM a
        UNION ALL SELECT 'recompute', 'mismatch', count(*) FILTER (WHERE abs(again - score) > 1e-9), NULL FROM a UNION ALL SELECT 'mean', 'flagged', count(*), round(avg(score), 6) FROM a WHERE penalty < 1
        UNION ALL SELECT 'mean', 'clean', count(*), round(avg(score), 6) FROM a WHERE penalty = 1 UNION ALL SELECT 'inversions', 'frequency', count(*) FILTER (WHERE low < before - 1e-9), NULL FROM n
        UNION ALL SELECT 'mean', cefr, count(*), round(avg(score), 6) FROM a GROUP BY cefr HAVING count(*) >= 100 UNION ALL SELECT 'neutral', level, count(*), NULL FROM a WHERE penalty = 1 AND frequency = 0.5 AND learner = 0.5 AND polish = 0.5 AND quality = 0 GROUP BY level""",
)
def audit_checks(spark: SparkSession, sf: str) -> DataFrame:
    return audit.checks(_audited(spark, sf))


@query(
    "audit_samples",
    f"""SELECT level, key, place, 'random' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('42:' || key), key) AS place FROM {_AUDITED}) WHERE place <= 5
        UNION ALL SELECT level, key, place, 'lowest' FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score, key) AS place FROM {_AUDITED}) WHERE place <= 3""",
)
def audit_samples(spark: SparkSession, sf: str) -> DataFrame:
    """For review: five senses of each level by seed 42, and its three weakest."""
    rows = _audited(spark, sf)
    shown = lambda df, kind: df.select("level", "key", F.col("place").cast("long").alias("place"), F.lit(kind).alias("kind"))
    return shown(audit.samples(rows, "key", "level", 5, 42), "random").unionByName(shown(audit.boundary(rows, "key", "level", 3, True), "lowest"))


@query(
    "inspect_lists",
    """SELECT count(*) AS rows, count(DISTINCT p_name) AS headwords, count(*) FILTER (WHERE contains(p_name, ' ')) AS multiword, count(*) FILTER (WHERE contains(p_name, '/')) AS slashes,
         count(*) - count(DISTINCT (p_name, p_type, p_brand)) AS repeats, min(p_size) AS low, max(p_size) AS high, count(*) FILTER (WHERE p_type IS NOT NULL) AS filled FROM part""",
)
def inspect_lists(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_name", "p_type", "p_brand", "p_size")
    return p.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("p_name").alias("headwords"), F.count_if(F.contains("p_name", F.lit(" "))).alias("multiword"),
        F.count_if(F.contains("p_name", F.lit("/"))).alias("slashes"), (F.count(F.lit(1)) - F.countDistinct(F.struct("p_name", "p_type", "p_brand"))).alias("repeats"),
        F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.count_if(F.col("p_type").isNotNull()).alias("filled"),
    )
