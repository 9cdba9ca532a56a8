"""Whole requests: filters, sort, page and total of a browse; channels, fusion, diversity and page of a search; an export.

Parts stand for senses: lines for their translations and assignments (supplier is student), brands for
flags and forms, nations and regions for the category tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.functions import text as X
from sensemill.operators import requests as R
from sensemill.operators.composer import Filters, Tables
from sensemill.operators.search import Request
from sensemill.plans.channels import VECTORS, documents_index, indexed
from sensemill.registry import query
from sensemill.tables import table

AS_OF = "2000-01-01"
_LEVELS = ", ".join(f"'{x}'" for x in S.LEVELS)
_NAMES = [name for name, _ in S.PRIORITIES]
_SENSES = f"""(SELECT p_partkey AS sense_id, p_name AS headword, lower(p_type) AS pos, [{_LEVELS}][p_size % 7 + 1] AS cefr, {_NAMES}[p_size % 5 + 1] AS priority_level,
    p_size <> 13 AS is_active, p_retailprice AS score, p_size * 80 AS rank, p_brand AS flag, 'NATION_' || (p_partkey % 25) AS category FROM part)"""
_OWN = "(SELECT l_partkey AS sense_id, l_suppkey AS student_id, l_returnflag <> 'A' AS is_active, l_linestatus AS state, l_shipdate AS due_at, l_linenumber - 1 AS lapses FROM lineitem)"
_TR = "(SELECT l_partkey AS sense_id, CASE WHEN l_discount >= 0.05 THEN 0.9 ELSE 0.35 END AS confidence FROM lineitem WHERE l_quantity > 40)"
_TREE = "(SELECT r_name AS key, NULL::VARCHAR AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
_SQL_CEFR = f"list_position([{_LEVELS}], cefr)"


def _tables(spark: SparkSession, sf: str) -> Tables:
    p = table(spark, sf, "part")
    level, names = F.array(*[F.lit(x) for x in S.LEVELS]), F.array(*[F.lit(x) for x in _NAMES])
    senses = p.select(
        F.col("p_partkey").alias("sense_id"), F.col("p_name").alias("headword"), F.lower("p_type").alias("pos"), F.get(level, F.col("p_size") % 7).alias("cefr"),
        F.get(names, F.col("p_size") % 5).alias("priority_level"), (F.col("p_size") != 13).alias("is_active"), F.col("p_retailprice").alias("score"),
    )
    key = F.col("p_partkey").alias("sense_id")
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    tree = r.select(F.col("r_name").alias("key"), F.lit(None).cast("string").alias("parent")).unionByName(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("key"), F.col("r_name").alias("parent")))
    li = table(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_discount", "l_quantity").withColumnRenamed("l_partkey", "sense_id")
    return Tables(
        senses, p.select(key, F.concat(F.lit("NATION_"), F.col("p_partkey") % 25).alias("key")), tree, p.select(key, (F.col("p_size") * 80).alias("rank")), p.select(key, F.col("p_brand").alias("flag")),
        p.select(key, F.lower("p_brand").alias("form")), li.where("l_quantity > 40").select("sense_id", F.when(F.col("l_discount") >= 0.05, 0.9).otherwise(0.35).alias("confidence")),
        li.select("sense_id", F.col("l_suppkey").alias("student_id"), (F.col("l_returnflag") != "A").alias("is_active"), F.col("l_linestatus").alias("state"), F.col("l_shipdate").alias("due_at"), (F.col("l_linenumber") - 1).alias("lapses")),
    )


_ROW = "is_active AND cefr IN ('A1','A2','B1','B2')"
_BELOW = f"category IN (WITH RECURSIVE b(key) AS (SELECT 'ASIA' UNION SELECT t.key FROM b JOIN {_TREE} t ON t.parent = b.key) SELECT key FROM b)"
#: name: the request, its sort, its text as a prefix, and the same filters in SQL.
_BROWSES: dict[str, tuple[Filters, str, str, str]] = {
    "browse_levels": (Filters(cefr=["A1", "A2", "B1", "B2"], priority_at_least="MEDIUM+", bands=["top2000", "nonsense"]), "cefr", f"{_SQL_CEFR} NULLS LAST", f"{_ROW} AND list_position({_NAMES}, priority_level) <= 3 AND rank <= 2000"),
    "browse_category": (Filters(category="ASIA", flags=["Brand#3", "Brand#17", "Brand#12", "Brand#2"], max_rank=3500), "pos", "pos NULLS LAST", f"is_active AND {_BELOW} AND flag IN ('Brand#3','Brand#17','Brand#12','Brand#2') AND rank <= 3500"),
    "browse_prefix": (Filters(prefix="s", availability="reliable"), "headword", "headword", f"is_active AND (starts_with(headword, 's') OR starts_with(lower(flag), 's')) AND sense_id IN (SELECT sense_id FROM {_TR} WHERE confidence >= 0.5)"),
    "browse_student": (
        Filters(student=7, assigned=True, states=["O"], due=True, difficult=True), "priority", "score DESC NULLS LAST",
        f"is_active AND sense_id IN (SELECT sense_id FROM {_OWN} WHERE student_id = 7 AND is_active AND state = 'O' AND due_at <= TIMESTAMP '{AS_OF}' AND lapses > 0)"),
    "browse_unassigned": (Filters(student=7, assigned=False, pos=["promo", "small"]), "relevance", "score DESC NULLS LAST", f"is_active AND pos IN ('promo','small') AND sense_id NOT IN (SELECT sense_id FROM {_OWN} WHERE student_id = 7)"),
}


def _sorts() -> dict[str, Column]:
    return {"headword": F.col("headword"), "pos": F.col("pos").asc_nulls_last(), "cefr": S.ordinal(F.col("cefr"), S.LEVELS).asc_nulls_last(), "priority": F.col("score").desc_nulls_last()}


def _browse(name: str, filters: Filters, sort: str, sql_order: str, where: str):
    sql = f"""WITH f AS (SELECT * FROM {_SENSES} WHERE {where}) SELECT sense_id, headword, cefr, (SELECT count(*) FROM f) AS total FROM f ORDER BY {sql_order}, headword, sense_id LIMIT 25 OFFSET 3"""

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = R.browse(_tables(spark, sf), filters, _sorts(), sort=sort, offset=3, limit=25, as_of=F.lit(AS_OF).cast("timestamp"))
        return out.select("sense_id", "headword", "cefr", "total")


for _name, _b in _BROWSES.items():
    _browse(_name, *_b)


@query(
    "export_filtered",
    f"""SELECT headword, sense_id, coalesce(cefr, '') AS cefr, t AS translations FROM {_SENSES} s LEFT JOIN (SELECT sense_id AS k, string_agg(confidence::DOUBLE::VARCHAR, ' | ' ORDER BY confidence) AS t
          FROM (SELECT DISTINCT sense_id, confidence FROM {_TR}) GROUP BY 1) ON k = sense_id WHERE is_active AND pos = 'promo' AND cefr IN ('A1','B2') ORDER BY headword, sense_id LIMIT 50000""",
)
def export_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """An export takes a browse's filters, but neither a student's nor the availability of translations."""
    t = _tables(spark, sf)
    kept = R.exported(t, Filters(pos=["promo"], cefr=["A1", "B2"], availability="missing"))
    several = t.translations.groupBy("sense_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("confidence")), lambda x: x.cast("string")), " | ").alias("translations"))
    return kept.join(several, "sense_id", "left").orderBy("headword", "sense_id").limit(R.MOST_EXPORTED).select("headword", "sense_id", F.coalesce("cefr", F.lit("")).alias("cefr"), "translations")


_T = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_LEX = f"""SELECT doc_id, source, lang, n_chars, len(list_filter({_T.format('text')}, lambda x: x IN ('license','apache'))) AS s FROM documents d
    WHERE list_has_any({_T.format('text')}, ['license','apache']) OR list_has_any({_T.format('source')}, ['license','apache']) OR starts_with(source, 'src1')
      OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id AND list_has_any({_T.format('c.text')}, ['license','apache']))"""
_COS = """(SELECT e.vec_id, 1.0 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])
    / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS distance
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def _search(name: str, mode: str):
    lex_on, sem_on = mode != "semantic", mode != "lexical"
    sql = f"""WITH lx AS ({_LEX}), lex AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS lex FROM lx QUALIFY lex <= 200),
        sm AS (SELECT vec_id AS doc_id, round(distance, 9) AS distance FROM {_COS} WHERE distance <= 0.9), sem AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS sem FROM sm QUALIFY sem <= 200),
        tp AS (SELECT doc_id, n_chars, source FROM documents WHERE lang IN ('fr','de')), top AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, source, doc_id) AS top FROM tp QUALIFY top <= 200),
        u AS ({"SELECT doc_id, lex, NULL AS sem, NULL AS top FROM lex" if lex_on else "SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS lex, NULL::BIGINT AS sem, NULL::BIGINT AS top WHERE false"}
              {"UNION ALL SELECT doc_id, NULL, sem, NULL FROM sem" if sem_on else ""} {"UNION ALL SELECT doc_id, NULL, NULL, top FROM top" if mode == "hybrid" else ""}),
        m AS (SELECT doc_id, max(lex) AS lex, max(sem) AS sem, max(top) AS top FROM u GROUP BY doc_id),
        f AS (SELECT m.doc_id, source, round(0.5 * (coalesce(1.0 / (60 + lex), 0) + CASE WHEN starts_with(source, 'src1') AND lex IS NOT NULL THEN 0.25 ELSE 0 END)
            + 0.25 * coalesce(1.0 / (60 + sem), 0) + 0.2 * coalesce(1.0 / (60 + top), 0) + 0.05 * (CASE WHEN n_chars <= 3000 THEN 0.5 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.5 ELSE 0 END), 10) AS score FROM m JOIN documents d USING (doc_id)),
        p AS (SELECT *, row_number() OVER (ORDER BY score DESC, lower(source), doc_id) AS place FROM f), g AS (SELECT *, row_number() OVER (PARTITION BY lower(source) ORDER BY place) - 1 AS tier FROM p)
        SELECT doc_id, source, score, greatest({"(SELECT count(*) FROM lx)" if lex_on else "0"}, {"(SELECT count(*) FROM sm)" if sem_on else "0"}, {"(SELECT count(*) FROM tp)" if mode == "hybrid" else "0"}) AS total
        FROM g ORDER BY tier, place LIMIT 30 OFFSET 5"""

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Words in a text, a source or a child's text, or a source's start; near vectors; topics by priority."""
        d = table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
        hits = indexed(spark, sf, Request(any_of=["license", "apache"]), {"text": 1.0})
        found = R.disjunction(d, "doc_id", hits, F.startswith("source", F.lit("src1"))).select("doc_id", F.col("lexical").alias("s"))
        e = table(spark, sf, "embeddings")
        q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
        near = e.join(F.broadcast(q), F.lit(True)).select(F.col("vec_id").alias("doc_id"), F.round(S.cosine_distance(F.col("embedding"), F.col("q")), 9).alias("distance")).where("distance <= 0.9")
        topic = d.where(F.col("lang").isin("fr", "de")).select("doc_id", "n_chars", "source")
        channels = {"lex": (found, [F.desc("s"), F.col("doc_id")]), "sem": (near, [F.col("distance"), F.col("doc_id")]), "top": (topic, [F.col("n_chars").desc_nulls_last(), F.col("source"), F.col("doc_id")])}
        on = {"hybrid": ("lex", "sem", "top"), "lexical": ("lex",), "semantic": ("sem",)}[mode]
        meta = S.metadata_bonus(F.col("n_chars"), F.when(F.col("lang") == "en", "HIGH"))
        out = R.search(d, "doc_id", "source", {k: channels[k] for k in on}, F.startswith("source", F.lit("src1")), meta, offset=5, limit=30)
        return out.select("doc_id", "source", "score", "total")


for _mode in ("hybrid", "lexical", "semantic"):
    _search(f"search_{_mode}", _mode)


@query("query_string", rf"""SELECT doc_id FROM (SELECT doc_id, {_T.format("text")} AS t FROM documents) WHERE (list_contains(t, 'license') AND contains(' ' || list_aggregate(t, 'string_agg', ' ') || ' ', ' under the ') AND NOT list_contains(t, 'mit')) OR list_contains(t, 'gnu')""")
def query_string(spark: SparkSession, sf: str) -> DataFrame:
    q = R.query_text('License "under the" -MIT OR gnu')
    found = documents_index(spark, sf).matches(q.condition, q.terms(), q.rank(), {}, VECTORS, ["text"])
    return found.select(F.col("key").alias("doc_id"))


@query(
    "roster",
    """SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag <> 'A') AS active FROM supplier WHERE s_nationkey = 3 AND s_acctbal >= 0 ORDER BY s_name, s_suppkey""",
)
def roster(spark: SparkSession, sf: str) -> DataFrame:
    """Students of one tenant (nation 3) that are not deleted, with their active assignments."""
    s = R.scoped(table(spark, sf, "supplier").withColumn("status", F.when(F.col("s_acctbal") < 0, "DELETED").otherwise("ACTIVE")), "s_nationkey", 3)
    n = table(spark, sf, "lineitem", "l_suppkey", "l_returnflag").where("l_returnflag <> 'A'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("active"))
    out = s.join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("active", F.lit(0)).cast("long").alias("active"))
    return out.orderBy("s_name", "s_suppkey")


@query("key_list", """WITH l AS (SELECT p_partkey, list_transform(string_split(p_name || ',' || p_brand || ', ,' || p_name || ' , x', ','), lambda x: trim(x)) AS k FROM part) SELECT p_partkey, array_to_string(list_filter(k, lambda x, i: x <> '' AND list_position(k, x) = i), ';') AS keys FROM l""")
def key_list(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    text = F.concat("p_name", F.lit(","), "p_brand", F.lit(", ,"), "p_name", F.lit(" , x"))
    return p.select("p_partkey", F.array_join(X.key_list(text), ";").alias("keys"))
