"""Full-text, vector and topic channels and their fusion.

Documents stand for glosses (text: the heavy field, source: the light one), embeddings for sense
vectors with the query vector of vec_id 0, regions and nations for topics.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.functions.text import category_matches
from sensemill.operators import search
from sensemill.operators.cells import Cells
from sensemill.operators.index import Index, opened, source_state
from sensemill.operators.requests import query_text, with_total
from sensemill.operators.search import Request, merged, ranked
from sensemill.registry import query
from sensemill.tables import exists, session_folder, table

_T = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_REQUESTS = {
    "fts_and": (Request(all_of=["license", "under"]), "list_contains(t, 'license') AND list_contains(t, 'under')"),
    "fts_or": (Request(any_of=["apache", "gnu"]), "list_contains(t, 'apache') OR list_contains(t, 'gnu')"),
    "fts_phrase": (Request(phrases=["apache license"]), "contains(' ' || list_aggregate(t, 'string_agg', ' ') || ' ', ' apache license ')"),
    "fts_not": (Request(all_of=["license"], none_of=["apache"]), "list_contains(t, 'license') AND NOT list_contains(t, 'apache')"),
}


#: The vector of each field, see operators/index.py.
VECTORS = {"text": "own", "source": "own", "turn": "turns"}


def documents_index(spark: SparkSession, sf: str) -> Index:
    """The index of documents by text and source, and of the turns that belong to them."""
    d, c = table(spark, sf, "documents", "doc_id", "text", "source"), table(spark, sf, "conversations", "conv_id", "turn", "text")
    own = d.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("child"), F.col(f).alias("text")) for f in ("text", "source")])).alias("u")).select("u.*")
    turns = c.select(F.lit("turn").alias("field"), F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("child"), "text")
    return opened(spark, f"documents-{zlib.crc32(sf.encode()):08x}", own.unionByName(turns), d, c)


def indexed(spark: SparkSession, sf: str, request: Request, weights: dict[str, float], within: list[str] | None = None) -> DataFrame:
    """(key, score) of a request; one for several words that nothing matches falls back to any of them."""
    index = documents_index(spark, sf)
    found = index.matches(request.condition, request.terms(), request.words(), weights, VECTORS, within)
    if len(request.all_of) > 1 and found.isEmpty():
        return indexed(spark, sf, request.loose(), weights, within)
    return found


def _fts(name: str, request: Request, condition: str):
    @query(name, f"SELECT doc_id, source FROM (SELECT doc_id, source, {_T} AS t FROM documents) WHERE {condition}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = indexed(spark, sf, request, {}, ["text"]).select(F.col("key").alias("doc_id"))
        return table(spark, sf, "documents", "doc_id", "source").join(found, "doc_id")


for _name, (_request, _condition) in _REQUESTS.items():
    _fts(_name, _request, _condition)


@query(
    "fts_ranked",
    f"""SELECT doc_id, lex_score, row_number() OVER (ORDER BY lex_score DESC, doc_id) AS rank FROM (
          SELECT doc_id, CAST(len(list_filter(t, lambda x: x IN ('license','src1'))) AS DOUBLE) + 0.4 * CAST(CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS DOUBLE) AS lex_score
          FROM (SELECT doc_id, source, {_T} AS t FROM documents) WHERE list_contains(t, 'license') OR list_contains(t, 'src1')) QUALIFY rank <= 100""",
)
def fts_ranked(spark: SparkSession, sf: str) -> DataFrame:
    request = Request(any_of=["license", "src1"])
    found = indexed(spark, sf, request, {"text": 1.0, "source": 0.4}, ["text"]).select(F.col("key").alias("doc_id"), F.col("score").alias("lex_score"))
    order = (F.desc("lex_score"), F.col("doc_id"))
    return found.join(ranked(found, "doc_id", "rank", *order, most=100), "doc_id")


@query(
    "fts_weighted",
    f"""WITH u AS (SELECT doc_id AS key, 'own' AS vector, 0 AS child, {_T} AS a, {_T.replace('text', 'source')} AS b FROM documents UNION ALL SELECT conv_id, 'turns', turn, {_T}, [] FROM conversations),
          s AS (SELECT key, vector, child, CASE vector WHEN 'own' THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END * len(list_filter(a, lambda x: x IN ('license', 'apache', 'the'))) + 0.4::DOUBLE * len(list_filter(b, lambda x: x IN ('license', 'apache', 'the'))) AS score FROM u
                WHERE (list_contains(a, 'license') AND contains(' ' || coalesce(list_aggregate(a, 'string_agg', ' '), '') || ' ', ' the apache ')) OR (list_contains(a, 'the') AND NOT list_contains(a, 'license') AND NOT list_contains(a, 'apache')))
        SELECT key AS doc_id, round(sum(score), 6) AS score FROM (SELECT key, vector, max(score) AS score FROM s GROUP BY ALL) GROUP BY key""",
)
def fts_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """A query string with a phrase, negations and an alternative over all vectors: the document's own by weighted fields, and the best of its turns."""
    q = query_text('license "the apache" OR the -license -apache')
    found = documents_index(spark, sf).matches(q.condition, q.terms(), q.rank(), {"text": 1.0, "source": 0.4, "turn": 0.1}, VECTORS)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_COS = """(SELECT e.vec_id, e.label, 1.0 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])
    / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS distance
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors with their cosine distance to that of vec_id 0, which is one row."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return e.join(F.broadcast(q), F.lit(True)).select("vec_id", "label", S.cosine_distance(F.col("embedding"), F.col("q")).alias("distance"))


@query("vector_topk", f"SELECT vec_id, round(distance, 9) AS distance FROM {_COS} ORDER BY round(distance, 9), vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    d = _distances(spark, sf).select("vec_id", F.round("distance", 9).alias("distance"))
    return d.orderBy("distance", "vec_id").limit(20)


@query("vector_within_cutoff", f"SELECT vec_id, round(distance, 9) AS distance, count(*) OVER () AS total FROM {_COS} WHERE distance <= 0.7")
def vector_within_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """All within the cutoff, with their exact number."""
    near = _distances(spark, sf).where("distance <= 0.7").select("vec_id", F.round("distance", 9).alias("distance"))
    total = near.agg(F.count(F.lit(1)).alias("total"))
    return near.join(F.broadcast(total), F.lit(True))  # one row


def _cells(spark: SparkSession, sf: str) -> Cells:
    """The session's cells of the table, built anew if its files have changed."""
    e = table(spark, sf, "embeddings")
    cells = Cells(spark, f"{session_folder(spark)}/cells-{zlib.crc32((sf + source_state(e)).encode()):08x}")
    return cells if exists(spark, f"{cells.path}/rows/_SUCCESS") else cells.build(e, "vec_id", "embedding")


@query(
    "vector_range",
    f"""WITH f AS (SELECT vec_id, label, round(distance, 9) AS distance FROM {_COS} WHERE distance <= 0.85 AND label IN (1, 3, 5, 7))
        SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY distance, vec_id LIMIT 40 OFFSET 5""",
)
def vector_range(spark: SparkSession, sf: str) -> DataFrame:
    """A page of what is within the cutoff and in scope, nearest first, with its exact number: from the cells that the cutoff reaches."""
    q = table(spark, sf, "embeddings", "vec_id", "embedding").where("vec_id = 0").first()["embedding"]
    near = _cells(spark, sf).within(q, "embedding", 0.85, F.col("label").isin(1, 3, 5, 7)).select("vec_id", "label", F.round("distance", 9).alias("distance"))
    return with_total(near.orderBy("distance", "vec_id").offset(5).limit(40), near)


@query("vector_scoped", f"SELECT vec_id, label, round(distance, 9) AS distance FROM {_COS} WHERE label IN (1, 3, 5) ORDER BY round(distance, 9), vec_id LIMIT 20")
def vector_scoped(spark: SparkSession, sf: str) -> DataFrame:
    near = _distances(spark, sf).where(F.col("label").isin(1, 3, 5)).withColumn("distance", F.round("distance", 9))
    return near.orderBy("distance", "vec_id").limit(20)


@query(
    "topic_channel",
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE lower(r_name) = 'europe' OR starts_with(lower(r_name), 'asia') OR starts_with('asian', lower(r_name))""",
)
def topic_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Query tokens name topics by equality or a common start; entries below a topic belong to it."""
    words = F.split(F.lower("r_name"), " ")
    hit = category_matches(F.lit("europe"), words) | category_matches(F.lit("asian"), words)
    r = table(spark, sf, "region").where(hit)
    n = table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, sf, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query(
    "hybrid_fusion",
    f"""WITH lex AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS lex FROM (
            SELECT doc_id, len(list_filter(t, lambda x: x IN ('license','apache'))) AS s FROM (SELECT doc_id, {_T} AS t FROM documents)
            WHERE list_contains(t, 'license') OR list_contains(t, 'apache')) QUALIFY lex <= 200),
          sem AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(distance, 9), vec_id) AS sem FROM {_COS} QUALIFY sem <= 200),
          top AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS top FROM documents WHERE source IN ('src0','src1') QUALIFY top <= 200),
          m AS (SELECT coalesce(lex.doc_id, sem.doc_id, top.doc_id) AS doc_id, lex, sem, top FROM lex FULL JOIN sem ON lex.doc_id = sem.doc_id FULL JOIN top ON coalesce(lex.doc_id, sem.doc_id) = top.doc_id)
        SELECT m.doc_id, lex, sem, top, round(0.5 * (coalesce(1.0 / (60 + lex), 0) + CASE WHEN starts_with(source, 'src1') AND lex IS NOT NULL THEN 0.25 ELSE 0 END)
            + 0.25 * coalesce(1.0 / (60 + sem), 0) + 0.2 * coalesce(1.0 / (60 + top), 0)
            + 0.05 * (CASE WHEN n_chars <= 3000 THEN 0.5 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.5 ELSE 0 END), 10) AS score
        FROM m JOIN documents d ON m.doc_id = d.doc_id""",
)
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Three channels of at most 200 candidates each, merged and scored by weighted reciprocal ranks."""
    d = table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    request = Request(any_of=["license", "apache"])
    found = indexed(spark, sf, request, {"text": 1.0}, ["text"]).select(F.col("key").alias("doc_id"), F.col("score").alias("s"))
    lex = ranked(found, "doc_id", "lex", F.desc("s"), F.col("doc_id"), most=200)
    near = _distances(spark, sf).select(F.col("vec_id").alias("doc_id"), F.round("distance", 9).alias("distance"))
    sem = ranked(near, "doc_id", "sem", F.col("distance"), F.col("doc_id"), most=200)
    top = ranked(d.where(F.col("source").isin("src0", "src1")), "doc_id", "top", F.desc("n_chars"), F.col("doc_id"), most=200)
    candidates = merged("doc_id", lex, sem, top)
    meta = S.metadata_bonus(F.col("n_chars"), F.when(F.col("lang") == "en", "HIGH"))
    out = search.fused(candidates.join(d, "doc_id"), "lex", "sem", "top", F.startswith("source", F.lit("src1")), meta)
    return out.select("doc_id", "lex", "sem", "top", "score")
