"""Aggregates, reports, reconciled evidence and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.functions import text as X
from sensemill.operators.stages import differences
from sensemill.registry import query
from sensemill.tables import table


@query(
    "coverage_qc",
    """SELECT c_mktsegment, count(DISTINCT c_custkey) AS total, count(DISTINCT o_custkey) AS linked, round(100.0 * count(DISTINCT o_custkey) / count(DISTINCT c_custkey), 2) AS percent
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def coverage_qc(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct entries and those with evidence, per group. Keys are reduced to one row each before the join."""
    seen = table(spark, sf, "orders", "o_custkey").distinct()
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment").join(seen, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = c.groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("total"), F.countDistinct("o_custkey").alias("linked"))
    return out.withColumn("percent", F.round(100.0 * F.col("linked") / F.col("total"), 2))


@query("crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders", "o_orderstatus", "o_orderpriority").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("profile_topk", "SELECT p_name, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_name ORDER BY n DESC, first_seen LIMIT 15")
def profile_topk(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "part", "p_name", "p_partkey").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(15)


@query(
    "histogram_bins",
    """SELECT CASE WHEN x < 0.2 THEN 1 WHEN x < 0.4 THEN 2 WHEN x < 0.6 THEN 3 WHEN x < 0.8 THEN 4 ELSE 5 END AS bin, count(*) AS n
       FROM (SELECT l_discount * 10 AS x FROM lineitem) GROUP BY 1""",
)
def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem", "l_discount").select((F.col("l_discount") * 10).alias("x"))
    bin_ = F.when(F.col("x") < 0.2, 1).when(F.col("x") < 0.4, 2).when(F.col("x") < 0.6, 3).when(F.col("x") < 0.8, 4).otherwise(5)
    return x.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "qc_counts",
    """SELECT count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_totalprice IS NULL) AS unpriced,
       count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 4) AS mean_price FROM orders""",
)
def qc_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice").isNull()).alias("unpriced"),
        F.countDistinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
    )


@query(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
)
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "verify_copy",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'lost' WHEN o_orderkey % 103 = 0 THEN 'doubled' WHEN o_orderkey % 107 = 0 THEN 'changed' END AS kind, 1::BIGINT AS n_old,
         CASE WHEN o_orderkey % 101 = 0 THEN 0 WHEN o_orderkey % 103 = 0 THEN 2 ELSE 1 END::BIGINT AS n_new FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 OR (o_orderkey % 107 = 0 AND o_totalprice IS NOT NULL)
       UNION ALL SELECT -7, 'added', 0, 1""",
)
def verify_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A copy of orders that lost, doubled, changed and added some, against its source."""
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    copy = o.where(k % 101 != 0).withColumn("o_totalprice", F.when((k % 107 == 0) & (k % 103 != 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    copy = copy.unionByName(copy.where(k % 103 == 0)).unionByName(o.limit(1).withColumn("o_orderkey", F.lit(-7).cast("long")))
    return differences(o, copy, "o_orderkey")


@query(
    "evidence_conflict",
    """SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) ELSE max(o_orderpriority) END AS level,
         CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 0.5 WHEN count(DISTINCT o_orderstatus) > 1 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence,
         count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY o_custkey""",
)
def evidence_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """One level from several sources: agreement is trusted, a conflict gives the highest level, flagged."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").groupBy("o_custkey")
    g = o.agg(F.max("o_orderpriority").alias("level"), F.min("o_orderpriority").alias("low"), F.min("o_orderstatus").alias("s0"), F.max("o_orderstatus").alias("s1"))
    conflict = F.col("low") != F.col("level")
    return g.select(
        "o_custkey", "level", F.when(conflict, 0.5).when(F.col("s0") != F.col("s1"), 0.95).otherwise(0.85).alias("confidence"), conflict.alias("conflict")
    )


@query(
    "best_rank",
    "SELECT l_partkey, min(l_linenumber) AS best, count(*) - 1 AS dropped, first(l_orderkey ORDER BY l_linenumber, l_orderkey, l_suppkey) AS of_order FROM lineitem GROUP BY l_partkey",
)
def best_rank(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_partkey", "l_linenumber", "l_orderkey", "l_suppkey")
    best = li.groupBy("l_partkey").agg(F.min(F.struct("l_linenumber", "l_orderkey", "l_suppkey")).alias("b"), (F.count(F.lit(1)) - 1).alias("dropped"))
    return best.select("l_partkey", F.col("b.l_linenumber").alias("best"), "dropped", F.col("b.l_orderkey").alias("of_order"))


@query("evidence_collapse", "SELECT l_orderkey, l_suppkey, min(l_returnflag || '/' || l_linestatus) AS kept FROM lineitem GROUP BY ALL")
def evidence_collapse(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return li.groupBy("l_orderkey", "l_suppkey").agg(F.min(F.concat_ws("/", "l_returnflag", "l_linestatus")).alias("kept"))


@query("json_field", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    "examples_capped",
    rf"""WITH e AS (SELECT conv_id, role, turn, {_CLEAN} AS example FROM conversations),
        k AS (SELECT * FROM e WHERE length(example) BETWEEN 3 AND 300 AND regexp_matches(example, '[\p{{L}}\p{{N}}]')),
        d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(example) ORDER BY role DESC, turn) AS again FROM k)
        SELECT conv_id, position, example FROM (SELECT conv_id, example, row_number() OVER (PARTITION BY conv_id ORDER BY role DESC, turn) AS position FROM d WHERE again = 1) WHERE position <= 5""",
)
def examples_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned examples, each once, at most five to an entry; the preferred source's come first."""
    e = table(spark, sf, "conversations").withColumn("example", X.clean_example(F.col("text"))).where("example is not null")
    order = (F.desc("role"), F.col("turn"))
    e = e.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", F.lower("example")).orderBy(*order))).where("again = 1")
    e = e.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    return e.where("position <= 5").select("conv_id", "position", "example")


_STATS = "(SELECT l_partkey, count(*) AS n, min(l_linenumber) AS best, avg(l_discount * 10) AS conf FROM lineitem GROUP BY l_partkey)"


@query(
    "priority_score",
    f"""WITH s AS (SELECT p_partkey, (p_partkey * 37) % 60000 AS r, ['A1','A2','B1','B2','C1','C2','x'][1 + p_size % 7] AS lv, n, conf, p_type FROM part LEFT JOIN {_STATS} ON l_partkey = p_partkey),
        c AS (SELECT *, CASE WHEN r < 1 THEN 1.0 WHEN r >= 50000 THEN 0.3 ELSE round(pow(r, -0.07), 4) END AS f,
            CASE lv WHEN 'A1' THEN 1.0 WHEN 'A2' THEN 0.9 WHEN 'B1' THEN 0.78 WHEN 'B2' THEN 0.68 WHEN 'C1' THEN 0.6 WHEN 'C2' THEN 0.55 ELSE 0.5 END AS l,
            coalesce(round(conf, 4), 0.5) AS p, CASE WHEN coalesce(n, 0) > 0 THEN 0.4 ELSE 0 END + CASE WHEN coalesce(n, 0) >= 3 THEN 0.3 WHEN coalesce(n, 0) >= 1 THEN 0.15 ELSE 0 END + 0.3 AS q,
            CASE p_type WHEN 'PROMO' THEN 0.5 WHEN 'SMALL' THEN 0.75 ELSE 1.0 END AS pen FROM s)
        SELECT p_partkey, round(least(1.0, (0.35::DOUBLE * f + 0.15::DOUBLE * l + 0.2::DOUBLE * p + 0.3::DOUBLE * q) * pen) + 1e-9, 4) AS score FROM c""",
)
def priority_score(spark: SparkSession, sf: str) -> DataFrame:
    stats = table(spark, sf, "lineitem", "l_partkey", "l_discount").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("l_discount") * 10).alias("conf"))
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_type").join(stats, F.col("p_partkey") == F.col("l_partkey"), "left")
    rank, n = F.col("p_partkey") * 37 % 60_000, F.coalesce("n", F.lit(0))
    level = F.element_at(F.array(*[F.lit(x) for x in [*S.LEVELS, "x"]]), (F.col("p_size") % 7 + 1).cast("int"))
    tags = F.when(F.col("p_type") == "PROMO", F.array(F.lit("Rare "))).when(F.col("p_type") == "SMALL", F.array(F.lit("slang"), F.lit("slang"))).otherwise(F.array().cast("array<string>"))
    polish = S.polish_component(F.when(F.col("conf").isNull(), F.array().cast("array<double>")).otherwise(F.array("conf")))
    score = S.priority_score(S.frequency_component(rank), S.learner_component(level), polish, S.quality_component(n, n, F.lit(True)), S.penalty(tags))
    return p.select("p_partkey", score.alias("score"))


@query(
    "quality_score",
    f"""SELECT p_partkey, round(least(1.0, 0.3::DOUBLE * coalesce(conf, 0) + 0.25::DOUBLE * least(1.0::DOUBLE, p_size / 50.0::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, coalesce(n, 0) / 2.0::DOUBLE) + 0.15 * CASE WHEN p_type IN ('PROMO','LARGE') THEN 1 ELSE 0 END
          + 0.1 * CASE WHEN best IS NOT NULL THEN 1 ELSE 0 END) + 1e-9, 4) AS score FROM part LEFT JOIN {_STATS} ON l_partkey = p_partkey""",
)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    stats = (
        table(spark, sf, "lineitem", "l_partkey", "l_discount", "l_linenumber").groupBy("l_partkey")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("l_discount") * 10).alias("conf"), F.min("l_linenumber").alias("best"))
    )
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_type").join(stats, F.col("p_partkey") == F.col("l_partkey"), "left")
    definition = F.least(F.lit(1.0), F.col("p_size") / 50.0)
    level = F.when(F.col("p_type").isin("PROMO", "LARGE"), F.col("p_type"))
    score = S.quality_score(F.coalesce("conf", F.lit(0.0)), definition, F.coalesce("n", F.lit(0)), level, F.col("best"))
    return p.select("p_partkey", score.alias("score"))


_INDICATED = r"""SELECT p_partkey, conf IS NOT NULL AS translation_available, round(coalesce(round(conf + 1e-9, 4), 0), 4) AS translation_confidence,
      len(list_filter(string_split_regex(p_name, '\s+'), lambda t: length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) >= 2)) >= 1 AS definition_available,
      coalesce(examples, 0) > 0 AS example_available, p_type IN ('PROMO','LARGE') AS cefr_available, best IS NOT NULL AS frequency_available,
      round(CASE WHEN p_size > 25 THEN p_size / 50.0::DOUBLE ELSE 0 END + 1e-9, 4) AS category_confidence, coalesce(examples, 0) AS examples
    FROM part LEFT JOIN (SELECT l_partkey, avg(CASE WHEN l_quantity > 40 THEN l_discount * 10 END) AS conf, count(*) FILTER (WHERE l_tax > 0.06) AS examples,
      min(CASE WHEN l_quantity < 5 THEN l_linenumber END) AS best FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""
_INDICATORS = f"""SELECT * EXCLUDE (examples), round(least(1.0::DOUBLE, 0.3::DOUBLE * translation_confidence + 0.25::DOUBLE * definition_available::INT
      + 0.2::DOUBLE * least(1.0::DOUBLE, examples / 2.0::DOUBLE) + 0.15::DOUBLE * cefr_available::INT + 0.1::DOUBLE * frequency_available::INT) + 1e-9, 4) AS sense_confidence FROM ({_INDICATED})"""


@query("quality_indicators", _INDICATORS)
def quality_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are senses; their lines give translations (quantity over 40), examples (high tax) and ranks (quantity under 5)."""
    stats = (
        table(spark, sf, "lineitem", "l_partkey", "l_discount", "l_linenumber", "l_quantity", "l_tax").groupBy("l_partkey")
        .agg(
            F.avg(F.when(F.col("l_quantity") > 40, F.col("l_discount") * 10)).alias("conf"), F.count_if(F.col("l_tax") > 0.06).alias("examples"),
            F.min(F.when(F.col("l_quantity") < 5, F.col("l_linenumber"))).alias("best"),
        )
    )
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size", "p_type").join(stats, F.col("p_partkey") == F.col("l_partkey"), "left")
    level, category = F.when(F.col("p_type").isin("PROMO", "LARGE"), F.col("p_type")), F.when(F.col("p_size") > 25, F.col("p_size") / 50.0)
    all_ = S.quality_indicators(F.col("conf"), X.gloss_depth(F.col("p_name")), F.col("examples"), level, F.col("best"), category)
    return p.select("p_partkey", *[c.alias(name) for name, c in all_.items()])


_AVAILABLE = ["translation", "definition", "example", "cefr", "frequency"]


@query(
    "quality_report",
    f"""SELECT count(*) AS senses_total, {', '.join(f"count(*) FILTER (WHERE {a}_available) AS with_{a}" for a in _AVAILABLE)},
          count(*) FILTER (WHERE category_confidence > 0) AS with_category, round(avg(sense_confidence) + 1e-9, 4) AS mean_sense_confidence FROM ({_INDICATORS})""",
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many senses have each kind of evidence, and the mean of their confidence."""
    have = [F.count_if(f"{a}_available").alias(f"with_{a}") for a in _AVAILABLE] + [F.count_if(F.col("category_confidence") > 0).alias("with_category")]
    return quality_indicators(spark, sf).agg(F.count(F.lit(1)).alias("senses_total"), *have, F.round(F.avg("sense_confidence") + 1e-9, 4).alias("mean_sense_confidence"))


@query(
    "adapter_validate",
    """SELECT c_custkey, CASE WHEN try_cast(substr(c_name, 10) AS BIGINT) IS NULL THEN 'failed' WHEN c_acctbal < 0 THEN 'failed' WHEN c_mktsegment = 'MACHINERY' THEN 'skipped' ELSE 'processed' END AS verdict,
       row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey) > 1 AS duplicate FROM customer""",
)
def adapter_validate(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    bad = F.substring("c_name", 10, 100).try_cast("long").isNull() | (F.col("c_acctbal") < 0)
    verdict = F.when(bad, "failed").when(F.col("c_mktsegment") == "MACHINERY", "skipped").otherwise("processed")
    again = F.row_number().over(Window.partitionBy("c_nationkey", F.lower("c_mktsegment")).orderBy("c_custkey")) > 1
    return c.select("c_custkey", verdict.alias("verdict"), again.alias("duplicate"))
