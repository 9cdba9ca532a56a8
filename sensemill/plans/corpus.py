"""Building and keeping a corpus: sources read from files, evidence joined, positions, flags, keys, reports, retirement."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.functions import text as X
from sensemill.operators import build as B
from sensemill.operators import identity, merge, normalise
from sensemill.operators.stages import Build, Stage
from sensemill.registry import query
from sensemill.sources import adapters as A
from sensemill.sources.profilers import dump_profile, synset_profile
from sensemill.operators.index import source_state
from sensemill.tables import exists, session_folder, table

_LEVELS = ", ".join(f"'{x}'" for x in [*S.LEVELS, "ZZ", ""])
_PROFILE = f"""(SELECT p_partkey, trim(p_name) AS headword, lower(p_type) AS pos, [{_LEVELS}][p_size % 8 + 1] AS level, p_partkey // 500 AS shard, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) + 1 AS row FROM part)"""


#: Rows of a staged file, so that files grow in number with the tables, not in size.
PER_FILE = 500


def _files(spark: SparkSession, name: str, df: DataFrame, place: str, kind: str, source: DataFrame, **options) -> str:
    """Writes df in the files of a source, a file for each PER_FILE values of the column `place`, in its order; the folder of each file is
    shard=<place div PER_FILE>. A session writes a source once for each state of the table it comes from."""
    path = f"{session_folder(spark)}/source-{name}-{zlib.crc32(source_state(source).encode()):08x}"
    if not exists(spark, f"{path}/_SUCCESS"):
        rows = df.withColumn("shard", F.expr(f"{place} div {PER_FILE}"))
        rows = rows.repartition("shard").sortWithinPartitions("shard", place)
        rows.drop(*([place] if place in df.columns and kind == "text" else [])).write.partitionBy("shard").format(kind).options(**options).mode("overwrite").save(path)
    return path


def _renamed(spark: SparkSession, path: str, name: str) -> None:
    """Gives the text files under path's shards a name of their own: name-<shard>.json, all in path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for shard in fs.listStatus(hadoop.Path(path)):
        if shard.getPath().getName().startswith("shard="):
            for f in fs.listStatus(shard.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), hadoop.Path(f"{path}/{name}-{shard.getPath().getName()[6:]}.json"))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size")
    level = F.get(F.array(*[F.lit(x) for x in [*S.LEVELS, "zz", ""]]), F.col("p_size") % 8)
    rows = p.select("p_partkey", F.col("p_name").alias("headword"), F.lower("p_type").alias("pos"), level.alias("CEFR"))
    return A.cefr_profile(spark, _files(spark, "profile", rows, "p_partkey", "csv", p, header="true"))


@query(
    "src_profile",
    f"""SELECT 'cefrj:' || shard || ':row:' || row AS record_id, headword, level, CASE WHEN level IN ('ZZ', '') THEN 'failed' ELSE 'processed' END AS verdict,
          CASE WHEN level NOT IN ('ZZ', '') AND row_number() OVER (PARTITION BY lower(headword), pos ORDER BY shard, row) > 1 THEN 'duplicate' END AS warning FROM {_PROFILE}""",
)
def src_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).select("record_id", "headword", "level", "verdict", "warning")


@query("src_stats", f"SELECT count(*) AS read, count(*) FILTER (WHERE level NOT IN ('ZZ','')) AS processed, 0::BIGINT AS skipped, count(*) FILTER (WHERE level IN ('ZZ','')) AS failed, count(*) FILTER (WHERE level NOT IN ('ZZ','') AND n > 1) AS warnings FROM (SELECT *, row_number() OVER (PARTITION BY lower(headword), pos ORDER BY shard, row) AS n FROM {_PROFILE})")
def src_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.stats(_profile(spark, sf))


@query(
    "src_advanced",
    """SELECT 'octanove:' || p_partkey // 500 || ':row:' || (row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) + 1) AS record_id, CASE WHEN p_size % 3 = 0 THEN 'failed' ELSE 'processed' END AS verdict,
         CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'missing_pos' END AS warning FROM part""",
)
def src_advanced(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    level = F.when(F.col("p_size") % 3 == 0, "B9").when(F.col("p_size") % 3 == 1, "C1").otherwise("C2")
    rows = p.select("p_partkey", F.concat("p_name", F.lit(" "), "p_partkey").alias("headword"), F.when(F.col("p_size") % 5 == 0, "").otherwise("noun").alias("pos"), level.alias("CEFR"))
    return A.advanced_profile(spark, _files(spark, "advanced", rows, "p_partkey", "csv", p, header="true")).select("record_id", "verdict", "warning")


@query(
    "src_frequency",
    """SELECT 'ngsl:' || shard || ':row:' || row AS record_id, lemma, CASE WHEN bad THEN NULL ELSE k END AS rank, CASE WHEN bad THEN 'failed' ELSE 'processed' END AS verdict,
         CASE WHEN NOT bad AND row_number() OVER (PARTITION BY lower(lemma) ORDER BY shard, row) > 1 THEN 'duplicate' END AS warning
       FROM (SELECT p_name AS lemma, p_partkey::INTEGER AS k, p_size % 9 = 0 AS bad, p_partkey // 500 AS shard, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) + 1 AS row FROM part)""",
)
def src_frequency(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size", "p_retailprice")
    rank = F.when(F.col("p_size") % 9 == 0, "none").otherwise(F.col("p_partkey").cast("string"))
    rows = p.select("p_partkey", F.col("p_name").alias("Lemma"), rank.alias("SFI Rank"), F.col("p_retailprice").alias("SFI"), F.lit(1.5).alias("Adjusted Frequency per Million (U)"))
    return A.frequency_list(spark, _files(spark, "frequency", rows, "p_partkey", "csv", p, header="true")).select("record_id", "lemma", "rank", "verdict", "warning")


@query("src_targets", f"SELECT DISTINCT key FROM (SELECT lower(trim(unnest(string_split(headword || '/' || pos, '/')))) AS key FROM {_PROFILE} WHERE level NOT IN ('ZZ','')) WHERE length(key) >= 2")
def src_targets(spark: SparkSession, sf: str) -> DataFrame:
    run = _profile(spark, sf)
    return A.target_keys(run, run.withColumn("headword", F.concat_ws("/", "headword", "pos")))


def _dump(spark: SparkSession, sf: str) -> str:
    """Dictionary lines: examples are objects and plain strings in turn, some lines are of another language, empty or broken."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang")
    text, n = F.to_json(F.struct(F.col("text").alias("x"))), F.col("doc_id") % 10
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)
    example = F.when(n < 5, F.concat(F.lit('{"text": '), quoted, F.lit("}"))).otherwise(quoted)
    senses = F.when(n == 3, "[]").otherwise(F.concat(F.lit('[{"glosses": [" ", "gloss '), "doc_id", F.lit('"], "tags": [" rare "], "examples": ['), example, F.lit(', "second", {"text": "third"}, "fourth"]}]')))
    line = F.concat(F.lit('{"word": "word'), "doc_id", F.lit('", "lang": "'), F.when(F.col("lang") == "de", "German").otherwise("English"), F.lit('", "pos": "noun", "senses": '), senses, F.lit(', "translations": [{"code": "pl", "word": " słowo "}, {"code": "de", "word": "wort"}]}'))
    return _files(spark, "dump", d.select("doc_id", F.when(n == 7, "{broken").otherwise(line).alias("value")), "doc_id", "text", d, compression="gzip")


_VERDICT = "CASE WHEN doc_id % 10 = 7 THEN 'failed' WHEN lang = 'de' OR doc_id % 10 = 3 THEN 'skipped' ELSE 'processed' END"


_EN = "(SELECT count(*) FROM documents WHERE doc_id % 10 <> 7 AND coalesce(lang, '') <> 'de')"
_SENSED = "(SELECT count(*) FROM documents WHERE doc_id % 10 NOT IN (3, 7) AND coalesce(lang, '') <> 'de')"


@query(
    "src_dump_profile",
    f"""SELECT section, item, n, CASE WHEN section IN ('field', 'sense', 'polish') AND item <> 'glossed' THEN round(n / {_EN}::DOUBLE, 6) WHEN item = 'glossed' THEN round(n / {_SENSED}::DOUBLE, 6) END AS share FROM (
        SELECT 'total' AS section, 'records' AS item, count(*) AS n FROM documents UNION ALL SELECT 'total', 'malformed', count(*) FROM documents WHERE doc_id % 10 = 7 UNION ALL SELECT 'total', 'english', {_EN}
        UNION ALL SELECT 'language', CASE WHEN lang = 'de' THEN 'German' ELSE 'English' END, count(*) FROM documents WHERE doc_id % 10 <> 7 GROUP BY 2 UNION ALL SELECT 'pos', 'noun', {_EN}
        UNION ALL SELECT 'field', unnest(['word', 'lang', 'pos', 'senses', 'translations']), {_EN} UNION ALL SELECT 'code', unnest(['pl', 'de']), {_EN} UNION ALL SELECT 'tag', ' rare ', {_SENSED}
        UNION ALL SELECT 'sense', 'entries', {_EN} UNION ALL SELECT 'sense', unnest(['senses', 'glossed']), {_SENSED} UNION ALL SELECT 'polish', unnest(['entries', 'translations']), {_EN} UNION ALL SELECT 'polish', 'hinted', 0)""",
)
def src_dump_profile(spark: SparkSession, sf: str) -> DataFrame:
    return dump_profile(spark, _dump(spark, sf))


@query(
    "src_dump",
    f"""SELECT CASE WHEN doc_id % 10 <> 7 THEN 'word' || doc_id END AS word, {_VERDICT} AS verdict, CASE WHEN doc_id % 10 = 7 THEN 'malformed' WHEN lang = 'de' THEN 'language' WHEN doc_id % 10 = 3 THEN 'no_gloss' END AS reason,
          CASE WHEN doc_id % 10 NOT IN (3, 7) THEN md5(concat_ws('|', 'gloss ' || doc_id, text, 'second', 'third', 'rare')) END AS sense FROM documents""",
)
def src_dump(spark: SparkSession, sf: str) -> DataFrame:
    s = F.get("senses", F.lit(0))
    sense = F.when(F.size("senses") > 0, F.md5(F.concat_ws("|", s["gloss"], F.array_join(s["examples"], "|"), F.array_join(s["tags"], "|"))))
    return A.dictionary_dump(spark, _dump(spark, sf)).select("word", "verdict", "reason", sense.alias("sense"))


@query("src_dump_targets", f"SELECT 'word' || doc_id AS word FROM documents WHERE {_VERDICT} = 'processed' AND doc_id < 500")
def src_dump_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Only wanted headwords are kept; keys are compared without case and marks."""
    wanted = table(spark, sf, "documents", "doc_id").where("doc_id < 500").select(F.concat(F.lit("Wörd"), "doc_id").alias("headword"))
    return A.dictionary_dump(spark, _dump(spark, sf), wanted.select(X.search_key(F.col("headword")).alias("key"))).where("verdict = 'processed'").select("word")


@query("src_examples", "SELECT 'word' || doc_id AS word, md5(text) AS example FROM documents WHERE lang <> 'de' AND doc_id % 10 NOT IN (3, 7) AND doc_id < 40 ORDER BY doc_id LIMIT 12")
def src_examples(spark: SparkSession, sf: str) -> DataFrame:
    """First examples of wanted words, of twelve words at most: a look-up."""
    run = A.dictionary_dump(spark, _dump(spark, sf))
    wanted = table(spark, sf, "documents", "doc_id").where("doc_id < 40").select(F.concat(F.lit("word"), "doc_id").alias("word"), F.col("doc_id").alias("place"))
    return A.examples(run, wanted, 12).select("word", F.md5("example").alias("example"))


def _synsets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A folder of two files of objects: synsets whose definition is a text or a list, and entries."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer", "c_custkey", "c_nationkey")
    key = F.concat(F.lit("s"), "n_nationkey")
    definition = F.when(F.col("n_nationkey") % 4 == 0, F.lit("[]")).when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(F.concat(F.lit('["'), "n_name", F.lit('", "more"]')))
    one = F.concat(F.lit('"'), key, F.lit('": {"definition": '), definition, F.lit(', "hypernym": ["s'), "n_regionkey", F.lit('"], "members": ["m"], "partOfSpeech": "n"}'))
    entry = F.concat(F.lit('"c'), "c_custkey", F.lit('": {"n": {"sense": [{"id": "i'), "c_custkey", F.lit('", "synset": "s'), "c_nationkey", F.lit('"}]}}'))
    folder = f"{session_folder(spark)}/source-synsets-{zlib.crc32(source_state(n, c).encode()):08x}"
    if not exists(spark, f"{folder}/_DONE"):
        for name, rows, of, by in (("noun", n, one, "n_nationkey"), ("entries", c, entry, "c_custkey")):
            # an object for each PER_FILE rows, each in a file of its own
            objects = rows.groupBy(F.expr(f"{by} div {PER_FILE}").alias("shard")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(of), ", "), F.lit("}")).alias("value"))
            objects.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").mode("append").text(folder)
            _renamed(spark, folder, name)
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/_DONE")
    return A.synset_folder(spark, folder)


@query(
    "src_synsets",
    """SELECT 's' || n_nationkey AS synset_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS definition, CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'processed' END AS verdict,
         's' || n_regionkey AS hypernym, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS lemmas FROM nation""",
)
def src_synsets(spark: SparkSession, sf: str) -> DataFrame:
    synsets, relations, links = _synsets(spark, sf)
    lemmas = links.where("verdict = 'processed'").groupBy(F.col("synset").alias("synset_id")).agg(F.count(F.lit(1)).alias("lemmas"))
    out = synsets.join(relations.where("relation = 'hypernym'").select(F.col("from_id").alias("synset_id"), F.col("to_id").alias("hypernym")), "synset_id", "left").join(lemmas, "synset_id", "left")
    return out.select("synset_id", "definition", "verdict", "hypernym", F.coalesce("lemmas", F.lit(0)).cast("long").alias("lemmas"))


@query(
    "src_synset_profile",
    """SELECT 'synset' AS section, 'synsets' AS item, count(*) AS n FROM nation UNION ALL SELECT 'synset', 'definitions', count(*) FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'synset', unnest(['examples', 'ili']), 0
       UNION ALL SELECT 'synset', 'members', count(*) FROM nation UNION ALL SELECT 'pos', 'n', count(*) FROM nation UNION ALL SELECT 'relation', 'hypernym', count(*) FROM nation
       UNION ALL SELECT 'lemma', unnest(['lemmas', 'links']), count(*) FROM customer UNION ALL SELECT 'lemma', 'several', 0""",
)
def src_synset_profile(spark: SparkSession, sf: str) -> DataFrame:
    return synset_profile(*_synsets(spark, sf))


@query(
    "evidence_join",
    """WITH l AS (SELECT lower(p_name) AS k, min(p_size) AS level, count(*) AS n_levels FROM part WHERE p_size < 20 GROUP BY 1), f AS (SELECT lower(p_name) AS k, min(p_partkey) AS rank FROM part WHERE p_size > 40 GROUP BY 1)
       SELECT p_partkey, level, coalesce(n_levels, 0) AS n_levels, rank FROM part LEFT JOIN l ON l.k = lower(p_name) LEFT JOIN f ON f.k = lower(p_name)""",
)
def evidence_join(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the word-level evidence of their key: all levels, and the best frequency rank."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size").withColumn("key", F.lower("p_name"))
    out = B.with_evidence(p.select("p_partkey", "key"), levels=p.where("p_size < 20").select("key", F.col("p_size").alias("level")), frequency=p.where("p_size > 40").select("key", F.col("p_partkey").alias("rank")))
    return out.select("p_partkey", F.array_min("levels").alias("level"), F.size("levels").cast("long").alias("n_levels"), "rank")


@query("lemma_synsets", "SELECT p_partkey, count(c_custkey) AS n, min(c_custkey) AS first FROM part LEFT JOIN customer ON c_mktsegment = CASE p_type WHEN 'PROMO' THEN 'HOUSEHOLD' WHEN 'SMALL' THEN 'BUILDING' ELSE p_type END AND c_nationkey = p_partkey % 25 GROUP BY 1")
def lemma_synsets(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate synsets by lemma and part of speech: market segments are lemmas, nations the letters."""
    p = table(spark, sf, "part", "p_partkey", "p_type")
    lemma = F.when(F.col("p_type") == "PROMO", "HOUSEHOLD").when(F.col("p_type") == "SMALL", "BUILDING").otherwise(F.col("p_type"))
    links = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey").select(F.col("c_mktsegment").alias("lemma"), F.col("c_nationkey").cast("long").alias("letter"), F.col("c_custkey").alias("synset_id"))
    out = B.candidate_synsets(p.select("p_partkey", lemma.alias("lemma"), (F.col("p_partkey") % 25).alias("letter")), links, "p_partkey")
    return out.select("p_partkey", F.size("synsets").cast("long").alias("n"), F.array_min("synsets").alias("first"))


@query("surrogate_keys", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey AS surrogate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
def surrogate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows get their parent's surrogate; rows of unknown keys go."""
    keys = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("surrogate"))
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(keys, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "surrogate")


@query(
    "event_lexicon",
    """SELECT event_type, p_type, count(*) AS n, count(DISTINCT user_id) AS students FROM events JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A') a ON user_id % 100 = l_suppkey
         JOIN part ON p_partkey = l_partkey WHERE p_size = floor(value)::INTEGER % 50 + 1 GROUP BY 1, 2""",
)
def event_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Events meet their student's active assignments and these their senses."""
    e = table(spark, sf, "events", "user_id", "event_type", "value").select("user_id", "event_type", (F.col("user_id") % 100).alias("l_suppkey"), (F.floor("value") % 50 + 1).cast("int").alias("p_size"))
    own = table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_returnflag").where("l_returnflag <> 'A'").select("l_suppkey", "l_partkey").distinct()
    sensed = own.join(table(spark, sf, "part", "p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return e.join(sensed, ["l_suppkey", "p_size"]).groupBy("event_type", "p_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("students"))


@query("append_positions", "SELECT s_suppkey, s_nationkey, coalesce((SELECT max(c_custkey) FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 0), -1) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier")
def append_positions(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "customer", "c_nationkey", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("position"))
    return B.appended(held, table(spark, sf, "supplier", "s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey")


_TAG = "CASE event_type WHEN 'click' THEN 'US' WHEN 'view' THEN 'UK' WHEN 'error' THEN 'obsolete' ELSE event_type END"


@query("tag_flags", f"SELECT flag, tag, count(*) AS n FROM (SELECT {_TAG} AS tag, CASE event_type WHEN 'click' THEN 'american' WHEN 'view' THEN 'british' WHEN 'error' THEN 'obsolete' END AS flag FROM events) GROUP BY ALL")
def tag_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags as flags; those without one are counted beside."""
    kind = F.col("event_type")
    tag = F.when(kind == "click", "US").when(kind == "view", "UK").when(kind == "error", "obsolete").otherwise(kind)
    return table(spark, sf, "events", "event_type").select(tag.alias("tag")).groupBy("tag", X.tag_flag(F.col("tag")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "retire_report",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT (SELECT count(*) FROM gone) AS entities, (SELECT count(*) FROM orders WHERE o_custkey IN (FROM gone)) AS orders,
         (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))) AS lines, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS kept""",
)
def retire_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a rebuild that knows only customers with money would retire, and what hangs on it."""
    c, o, li = table(spark, sf, "customer", "c_custkey", "c_acctbal"), table(spark, sf, "orders", "o_orderkey", "o_custkey"), table(spark, sf, "lineitem", "l_orderkey")
    new = c.where("c_acctbal >= 0").select("c_custkey")
    kept, children = B.retired(c, new, "c_custkey", {"orders": (o, "o_custkey", "o_orderkey"), "lines": (li, "l_orderkey", None)})
    return B.retirement_report(c, kept, children, {"orders": o, "lines": li})


@query("score_report", """SELECT o_orderpriority AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) FILTER (WHERE o_orderstatus = 'P') AS conflicts FROM orders GROUP BY 1""")
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return B.report(o, "o_orderpriority", "o_totalprice", F.col("o_orderstatus") == "P")


@query("taxonomy_nodes", "SELECT key, parent, depth FROM (SELECT r_name AS key, NULL::VARCHAR AS parent, 0 AS depth FROM region UNION ALL SELECT r_name || '/' || n_name, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey)")
def taxonomy_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right")
    return B.taxonomy_nodes(n.select(F.col("r_name").alias("top"), F.col("n_name").alias("sub")))


@query("run_log", f"SELECT 'profile' AS run, 'finished' AS status, count(*) AS read, count(*) FILTER (WHERE level IN ('ZZ','')) AS failed FROM {_PROFILE}")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """A run is begun, and finished with its counts as JSON."""
    log = B.finished(B.begun(None, spark, "1", "profile", "2024-01-01"), A.stats(_profile(spark, sf)), "1", "2024-01-02")
    count = lambda k: F.get_json_object("stats", f"$.{k}").cast("long").alias(k)
    return log.select("run", "status", count("read"), count("failed"))


@query("source_registry", "SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS version FROM supplier")
def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier", "s_suppkey", "s_name")
    old, new = s.select(F.col("s_name").alias("name"), F.lit("v1").alias("version")), s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), F.lit("v2").alias("version"))
    return B.registered(old, new)


@query("dashboard_order", "SELECT c_custkey, c_name, overdue, due, row_number() OVER (ORDER BY overdue DESC, due DESC, c_name, c_custkey) AS place FROM (SELECT c_custkey, c_name, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS overdue, count(o_orderkey) AS due FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) QUALIFY place <= 100")
def dashboard_order(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("overdue"), F.count(F.lit(1)).alias("due"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = table(spark, sf, "customer", "c_custkey", "c_name").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", zero("overdue"), zero("due"))
    order = (F.desc("overdue"), F.desc("due"), F.col("c_name"), F.col("c_custkey"))
    return rows.orderBy(*order).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("topic_window", "SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY c_acctbal DESC NULLS LAST, c_name, c_custkey LIMIT 45")
def topic_window(spark: SparkSession, sf: str) -> DataFrame:
    """A topic's entries by priority: as many as the page's offset and limit ask for."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return c.orderBy(F.col("c_acctbal").desc_nulls_last(), "c_name", "c_custkey").limit(20 + 25).select("c_custkey", "c_name")


def _sensed(candidates: DataFrame) -> DataFrame:
    """Candidates with an id: their entry and place in it tell them apart."""
    return candidates.withColumn("candidate_id", F.xxhash64("headword", "pos", "n", "gloss"))


def _clustered(candidates: DataFrame) -> DataFrame:
    return identity.clusters(candidates.withColumn("ordering", F.concat_ws("|", F.lpad(F.col("n").cast("string"), 6, "0"), "gloss")))


def _merged(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    members = candidates.join(clusters, "candidate_id")
    return normalise.merged(members, "cluster_id", F.struct("n", "candidate_id"))


def _ranked(senses: DataFrame, frequency: DataFrame) -> DataFrame:
    """Senses with the word-level evidence of their headword."""
    ranks = frequency.where("verdict = 'processed'").select(F.col("lemma").alias("key"), "rank").groupBy("key").agg(F.min("rank").alias("rank"))
    return senses.join(ranks.withColumnRenamed("key", "headword"), "headword", "left").select("cluster_id", "headword", "pos", "gloss", "members", "rank")


def _stored(store: DataFrame, senses: DataFrame) -> DataFrame:
    return merge.upsert(store, senses, "cluster_id")


#: A corpus from a dump and a list: candidates, identity, merged senses, evidence, and the store they are put into.
CORPUS = [
    Stage("candidates", ("dump",), lambda dump: _sensed(normalise.candidates(dump))),
    Stage("clusters", ("candidates",), _clustered),
    Stage("senses", ("candidates", "clusters"), _merged),
    Stage("evidence", ("senses", "frequency"), _ranked),
    Stage("store", ("old", "evidence"), _stored),
]


@query(
    "corpus_build",
    f"""SELECT 'word' || doc_id AS headword, 'noun' AS pos, 'gloss ' || doc_id AS gloss, 1::BIGINT AS members, p_partkey::INTEGER AS rank FROM documents LEFT JOIN part ON p_partkey = doc_id AND p_size % 9 <> 0 WHERE {_VERDICT} = 'processed'
        UNION ALL SELECT 'kept', 'noun', 'of an earlier build', 1, NULL""",
)
def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    """From a dump and a frequency list to the store of senses; a second build in a session finds all stages done."""
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    rank = F.when(F.col("p_size") % 9 == 0, "none").otherwise(F.col("p_partkey").cast("string"))
    rows = p.select("p_partkey", F.concat(F.lit("word"), "p_partkey").alias("Lemma"), rank.alias("SFI Rank"), F.col("p_retailprice").alias("SFI"), F.lit(1.5).alias("Adjusted Frequency per Million (U)"))
    sources = {
        "dump": A.dictionary_dump(spark, _dump(spark, sf)), "frequency": A.frequency_list(spark, _files(spark, "words", rows, "p_partkey", "csv", p, header="true")),
        "old": spark.createDataFrame([(-1, "kept", "noun", "of an earlier build", 1, None)], "cluster_id long, headword string, pos string, gloss string, members long, rank int"),
    }
    return Build(spark, f"{session_folder(spark)}/corpus-{zlib.crc32(sf.encode()):08x}", CORPUS).run(sources)["store"].drop("cluster_id")
