"""Keyed writes and resumable work. Orders are the stored table; its keys' parity splits old from new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensemill.operators import merge as M
from sensemill.operators.keyed import numbered
from sensemill.registry import query
from sensemill.tables import table

_OLD = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"
_NEW = "(SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0)"


def _old_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query("upsert_merge", f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_NEW})")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    return M.upsert(*_old_new(spark, sf), "o_orderkey")


@query("upsert_report", f"SELECT count(*) FILTER (WHERE o.o_orderkey IS NULL) AS inserted, count(*) FILTER (WHERE o.o_orderkey IS NOT NULL) AS updated FROM {_NEW} n LEFT JOIN {_OLD} o USING (o_orderkey)".replace("USING (o_orderkey)", "ON o.o_orderkey = n.o_orderkey"))
def upsert_report(spark: SparkSession, sf: str) -> DataFrame:
    return M.upsert_report(*_old_new(spark, sf), "o_orderkey")


@query("insert_ignore", f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_OLD})")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return M.insert_ignore(*_old_new(spark, sf), "o_orderkey")


@query(
    "delete_refresh",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {_NEW})
        UNION ALL SELECT o_orderkey, 1, o_custkey, o_totalprice FROM {_NEW}""",
)
def delete_refresh(spark: SparkSession, sf: str) -> DataFrame:
    _, new = _old_new(spark, sf)
    child = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = new.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_custkey").alias("l_partkey"), F.col("o_totalprice").alias("l_quantity"))
    return M.delete_refresh(child, rows, rows, "l_orderkey")


@query(
    "versioned_upsert",
    f"""WITH v AS (SELECT *, 'v1' AS version FROM {_OLD} UNION ALL SELECT *, 'v2' FROM {_NEW})
        SELECT o_orderkey, count(*) AS versions, max(o_totalprice) FILTER (WHERE version = 'v2') AS current FROM v GROUP BY o_orderkey""",
)
def versioned_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """History by (key, version); the current value is that of the current version."""
    old, new = (d.withColumn("version", F.lit(v)) for d, v in zip(_old_new(spark, sf), ("v1", "v2")))
    kept = M.upsert(old, new, "o_orderkey", "version")
    return kept.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("versions"), F.max(F.when(F.col("version") == "v2", F.col("o_totalprice"))).alias("current"))


@query(
    "referential_filter",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS known FROM lineitem",
)
def referential_filter(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    kept, dropped = M.referential(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parents, "l_suppkey")
    return kept.withColumn("known", F.lit(True)).unionByName(dropped.withColumn("known", F.lit(False)))


_STORED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256('stale') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 7 <> 0)"


@query("resume_pending", f"SELECT d.doc_id, sha256(d.text) AS sha FROM documents d LEFT JOIN {_STORED} s ON s.doc_id = d.doc_id WHERE s.sha IS DISTINCT FROM sha256(d.text)")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Work whose stored digest is missing or stale."""
    d = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha"))
    stored = d.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("stale"), 256)).otherwise(F.col("sha")).alias("stored"))
    return d.join(stored, "doc_id", "left").where(~F.col("stored").eqNullSafe(F.col("sha"))).select("doc_id", "sha")


@query("stride_shard", "SELECT doc_id, (row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1) % 4 AS shard FROM documents")
def stride_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Strides over all sorted keys: numbers of the total order, found range by range."""
    d = numbered(table(spark, sf, "documents", "source", "doc_id"), "source", "doc_id")
    return d.select("doc_id", (F.col("number") % 4).alias("shard"))
