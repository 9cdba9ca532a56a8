"""Text functions, entity resolution and enrichment over documents, labels and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensemill.functions import text as X
from sensemill.operators import graph, identity
from sensemill.registry import query
from sensemill.tables import small_batches, table

_STOP = ",".join(f"'{w}'" for w in X.STOPWORDS)
_KEY = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_CANON = "CASE t " + " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in X.CANON.items()) + " ELSE t END"
_TOKENS = f"list_sort(list_distinct(list_transform(list_filter(string_split({_KEY}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})), lambda t: {_CANON})))"


def _native_key(c):
    """The search key without case folding and accents, which SQL can say too."""
    return X.collapsed(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "))


@query("text_significant_tokens", f"SELECT doc_id, list_aggregate({_TOKENS.format('text')}, 'string_agg', ' ') AS tokens FROM documents")
def text_significant_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.nullif(F.array_join(X.significant_tokens(_native_key(F.col("text"))), " "), F.lit("")).alias("tokens"))


def _sql_stem() -> str:
    def once(t: str) -> str:
        cases = " ".join(f"WHEN ends_with({t}, '{s.replace(chr(39), chr(39) * 2)}') AND length({t}) - {len(s)} >= 3 THEN left({t}, length({t}) - {len(s)}) || '{to}'" for s, to in X.SUFFIXES)
        return f"CASE WHEN length({t}) <= 3 THEN {t} {cases} ELSE {t} END"

    return once("t")


@query(
    "text_stem",
    rf"""WITH w0 AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{{L}}]+')) AS word FROM documents), a AS (SELECT word, word AS t FROM w0 WHERE word <> ''),
        b AS (SELECT word, {_sql_stem()} AS t FROM a), c AS (SELECT word, {_sql_stem()} AS t FROM b), d AS (SELECT word, {_sql_stem()} AS t FROM c)
        SELECT word, {_sql_stem()} AS stem FROM d""",
)
def text_stem(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word with its stem: distinct before stemming, so each word is stemmed once."""
    words = table(spark, sf, "documents", "text").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


@query(
    "text_gloss_clean",
    r"""SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace('(noun) (old) ' || text || ' ; 12.', '\s+', ' ', 'g')), '^(\([^)]*\)\s*)+', '')), '[;,]?\s*\d+\.$', ''))) AS digest FROM documents""",
)
def text_gloss_clean(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(X.clean_gloss(F.concat(F.lit("(noun) (old) "), "text", F.lit(" ; 12.")))).alias("digest"))


@query("text_search_key")
def text_search_key(spark: SparkSession, sf: str) -> DataFrame:
    """Case folding and decomposition are beyond SQL; tests hold this against Python's own."""
    small_batches(spark)
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.search_key(F.col("text")).alias("key"))


@query(
    "embedding_recipe",
    r"""SELECT doc_id, sha256(concat_ws(' | ', nullif(trim(source), ''), nullif(trim(lang), ''), nullif(trim(text), ''), nullif(trim(string_split(text, chr(10))[1]), ''), nullif(trim(string_split(text, chr(10))[2]), ''))) AS sha FROM documents""",
)
def embedding_recipe(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    recipe = X.embed_text(F.col("source"), F.col("lang"), t, F.split(t, "\n"))  # lines are examples, of which the first two count
    return table(spark, sf, "documents", "doc_id", "source", "lang", "text").select("doc_id", F.sha2(recipe, 256).alias("sha"))


_GLOSS_SQL = "'made ' || p_name || ' kind' || p_size % 3 || ' size' || p_size % 5"


def _senses(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidate senses: a name is a headword, type and brand are the block it is compared in."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    gloss = F.concat(F.lit("made "), "p_name", F.lit(" kind"), F.col("p_size") % 3, F.lit(" size"), F.col("p_size") % 5)
    return p.select("p_partkey", "p_name", "p_type", "p_brand", X.significant_tokens(_native_key(gloss)).alias("tokens"))


@query(
    "near_dup_pairs",
    rf"""WITH c AS (SELECT *, {_TOKENS.format('(' + _GLOSS_SQL + ')')} AS t FROM part),
        p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.t, b.t)) AS shared, len(a.t) AS na, len(b.t) AS nb, a.t = b.t AS same
              FROM c a JOIN c b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
        SELECT a, b FROM p WHERE least(na, nb) > 0 AND (same OR (shared = least(na, nb) AND shared >= 2) OR shared / (na + nb - shared)::DOUBLE >= 0.75 OR (na = nb AND shared / (na + nb - shared)::DOUBLE >= 0.6))""",
)
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs inside a block that mean the same."""
    return identity.meaning_pairs(_senses(spark, sf), "p_partkey", "p_name", "p_type", "p_brand")


@query("identity_clusters")
def identity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Senses of a headword: parts with one name and type, whose brand and size words are the gloss."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    gloss = F.concat_ws(" ", F.lit("made"), "p_brand", F.concat(F.lit("size"), F.col("p_size") % 5), F.concat(F.lit("kind"), F.col("p_size") % 3))
    c = p.select(
        F.col("p_name").alias("headword"), F.col("p_type").alias("pos"), F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("ordering"),
        X.significant_tokens(_native_key(gloss)).alias("tokens"),
    )
    found = c.join(identity.clusters(c), "candidate_id").groupBy("headword", "pos", "cluster_id").agg(
        F.count(F.lit(1)).alias("members"), F.min("candidate_id").alias("first_id"), F.min_by("tokens", F.struct("ordering", "candidate_id")).alias("tokens")
    )
    keyed = found.withColumn("base", X.sense_key(F.col("headword"), F.col("pos"), X.gloss_digest(F.col("tokens"))))
    return identity.with_suffix(keyed, "base", "first_id").select("sense_key", "cluster_id", "members")


@query(
    "identity_founders",
    rf"""WITH RECURSIVE c AS (SELECT block, id, t, row_number() OVER (PARTITION BY block ORDER BY id) AS k FROM (SELECT 'doc' || (doc_id % 40) AS block, doc_id AS id, list_sort(list_distinct(t[1:6])) AS t FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents))),
        r AS (SELECT block, k, id, id AS cluster_id, CASE WHEN len(t) > 0 THEN [{{'t': t, 'id': id}}] ELSE [] END AS founders FROM c WHERE k = 1
          UNION ALL SELECT block, k, id, coalesce(f.id, id), CASE WHEN f IS NULL AND len(t) > 0 THEN list_append(founders, {{'t': t, 'id': id}}) ELSE founders END FROM (
            SELECT c.block, c.k, c.id, c.t, r.founders, list_filter(r.founders, lambda x: len(c.t) > 0 AND (x.t = c.t OR (len(list_intersect(x.t, c.t)) = least(len(x.t), len(c.t)) AND least(len(x.t), len(c.t)) >= 2)
              OR len(list_intersect(x.t, c.t)) / (len(x.t) + len(c.t) - len(list_intersect(x.t, c.t)))::DOUBLE >= 0.75 OR (len(x.t) = len(c.t) AND len(list_intersect(x.t, c.t)) / (len(x.t) + len(c.t) - len(list_intersect(x.t, c.t)))::DOUBLE >= 0.6)))[1] AS f
            FROM r JOIN c ON c.block = r.block AND c.k = r.k + 1))
        SELECT id AS candidate_id, cluster_id FROM r""",
)
def identity_founders(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as candidates of forty headwords, by their first six significant tokens, in the order of their ids."""
    d = table(spark, sf, "documents", "doc_id", "text")
    tokens = F.slice(X.significant_tokens(_native_key(F.col("text"))), 1, 6)
    c = d.select(F.concat(F.lit("doc"), F.col("doc_id") % 40).alias("headword"), F.lit("noun").alias("pos"), F.col("doc_id").alias("candidate_id"), F.lit("").alias("ordering"), tokens.alias("tokens"))
    return identity.clusters(c)


@query(
    "align_translations",
    rf"""WITH c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
        p AS (SELECT *, array_to_string(w[1:2], ' ') AS a, w[3] AS b, w[4] AS d FROM c WHERE len(w) > 0),
        q AS (SELECT *, {_KEY.format('a')} AS ka, {_KEY.format('b')} AS kb, {_KEY.format('d')} AS h FROM p),
        s AS (SELECT *, list_filter(list_distinct(string_split(ka, ' ')), lambda t: length(t) >= 3) AS sa, coalesce(list_filter(list_distinct(string_split(kb, ' ')), lambda t: length(t) >= 3), []) AS sb FROM q),
        x AS (SELECT conv_id, turn, ka, kb, h, sa, sb, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM s),
        y AS (SELECT *, {_KEY.format('t')} AS k FROM x),
        z AS (SELECT *, len(list_intersect(list_filter(string_split(k, ' '), lambda t: length(t) >= 3), sa)) AS na, len(list_intersect(list_filter(string_split(k, ' '), lambda t: length(t) >= 3), sb)) AS nb FROM y
              WHERE k <> ka AND k IS DISTINCT FROM kb AND k IS DISTINCT FROM h),
        o AS (SELECT conv_id, turn, 0 AS sense, a AS translation, 'inline' AS method FROM p UNION ALL SELECT conv_id, turn, 1, b, 'inline' FROM p WHERE b IS NOT NULL
          UNION ALL SELECT conv_id, turn, unnest([0, 1, 2]), arg_min(t, i), 'cognate' FROM y WHERE k = h GROUP BY conv_id, turn
          UNION ALL SELECT conv_id, turn, CASE WHEN max(na) >= max(nb) THEN 0 ELSE 1 END, arg_min(t, i), 'token' FROM z WHERE na + nb > 0 AND k <> '' GROUP BY conv_id, turn, k
          UNION ALL SELECT conv_id, turn, (n % 3)::INT, t, 'position' FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS n FROM z WHERE na + nb = 0 OR k = '') WHERE n < 9),
        f AS (SELECT *, CASE method WHEN 'inline' THEN 0.95::DOUBLE WHEN 'cognate' THEN 0.5::DOUBLE WHEN 'token' THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM o)
        SELECT conv_id AS entry, turn, sense, row_number() OVER (PARTITION BY conv_id, turn, sense ORDER BY confidence DESC, translation) AS place, translation, confidence, method FROM f""",
)
def align_translations(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation as an entry of three senses: its first two words and its third one are named inside the glosses, its
    fourth is the headword, and all its words are translations to align."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text").where("text is not null")
    c = c.select(F.col("conv_id").alias("entry"), "turn", F.filter(F.split("text", "[ \t\n\r\f]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)

    def keyed(words):
        return F.transform(words, lambda w: F.struct(w.alias("text"), _native_key(w).alias("key")))

    inline = F.array(keyed(F.array(F.array_join(F.slice("w", 1, 2), " "))), keyed(F.slice("w", 3, 1)), keyed(F.slice("w", 1, 0)))
    entries = c.select("entry", "turn", _native_key(F.get("w", F.lit(3))).alias("word_key"), inline.alias("inline"), keyed(F.col("w")).alias("words"))
    # explode_outer, for a filter inferred from explode would align each entry twice more
    rows = identity.align_translations(entries).select("entry", "turn", F.explode_outer("aligned").alias("x")).where("x is not null").select("entry", "turn", "x.*")
    of = Window.partitionBy("entry", "turn", "sense").orderBy(F.desc("confidence"), "translation")  # an entry's few rows
    return rows.withColumn("place", F.row_number().over(of))


@query(
    "synset_link",
    rf"""WITH s AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents), b AS (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark),
        w AS (SELECT item_id, unnest(t) AS w FROM b), sw AS (SELECT doc_id, unnest(t) AS w FROM s),
        lm AS (SELECT item_id, first(w ORDER BY length(w) DESC, w) AS w FROM w GROUP BY 1), ev AS (SELECT doc_id, item_id FROM sw JOIN lm USING (w)),
        p AS (SELECT ev.doc_id, ev.item_id, len(list_intersect(s.t, b.t)) AS shared, len(s.t) AS na, len(b.t) AS nb, s.t = b.t AS same FROM ev JOIN s USING (doc_id) JOIN b USING (item_id)),
        q AS (SELECT *, round(CASE WHEN least(na, nb) = 0 THEN 0 WHEN same THEN 0.95 WHEN shared = least(na, nb) AND shared >= 2 THEN 0.9
              WHEN shared / (na + nb - shared)::DOUBLE >= 0.75 THEN shared / (na + nb - shared)::DOUBLE ELSE shared / (na + nb - shared)::DOUBLE / 2 END::DOUBLE, 6) AS sim FROM p),
        g AS (SELECT *, max(sim) OVER d AS top, max(shared) OVER d AS most, count(*) OVER d AS n FROM q WINDOW d AS (PARTITION BY doc_id)),
        h AS (SELECT doc_id, max(top) AS top, max(most) AS most, max(n) AS n, count(*) FILTER (WHERE sim = top) AS n_sim, count(*) FILTER (WHERE shared = most) AS n_both,
              max(item_id) FILTER (WHERE sim = top) AS by_sim, max(item_id) FILTER (WHERE shared = most) AS by_both FROM g GROUP BY doc_id)
        SELECT doc_id, CASE WHEN top >= 0.6 AND n_sim = 1 THEN by_sim WHEN n = 1 THEN by_sim WHEN top < 0.6 AND most >= 2 AND n_both = 1 THEN by_both END AS item_id,
          CASE WHEN top >= 0.6 AND n_sim = 1 THEN top WHEN n = 1 THEN 0.8::DOUBLE WHEN top < 0.6 AND most >= 2 AND n_both = 1 THEN 0.7::DOUBLE END AS confidence,
          CASE WHEN top >= 0.6 AND n_sim = 1 THEN 'definition-match' WHEN n = 1 THEN 'monosemous' WHEN top < 0.6 AND most >= 2 AND n_both = 1 THEN 'shared-tokens' ELSE 'ambiguous' END AS method FROM h""",
)
def synset_link(spark: SparkSession, sf: str) -> DataFrame:
    """A document is a gloss, benchmark items are synsets; an item's longest token is its lemma, and documents that hold it have it as evidence."""
    s = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("sense_id"), X.significant_tokens(_native_key(F.col("text"))).alias("tokens"))
    b = table(spark, sf, "benchmark", "item_id", "text").select(F.col("item_id").alias("synset_id"), X.significant_tokens(_native_key(F.col("text"))).alias("tokens"))
    lemma = F.get(F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("w")))), F.lit(0))["w"]
    items = b.select("synset_id", F.col("tokens").alias("b"), lemma.alias("word")).where("word is not null")
    held = s.select("sense_id", F.col("tokens").alias("a"), F.explode(graph.words_among(F.col("tokens"), items)).alias("word"))
    out = graph.linked(held.join(items, "word"))
    return out.select(F.col("sense_id").alias("doc_id"), F.col("synset_id").alias("item_id"), "confidence", "method")


@query(
    "hypernym_closure",
    """WITH RECURSIVE up(start, node, d) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT start, node // 2, d + 1 FROM up WHERE d < 5 AND node // 2 <> node)
       SELECT DISTINCT start, node FROM up""",
)
def hypernym_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Edges lead from every key to its half."""
    keys = table(spark, sf, "part", "p_partkey")
    edges = keys.select(F.col("p_partkey").alias("from_id"), F.expr("p_partkey div 2").alias("to_id")).where("from_id <> to_id")
    return graph.closure(keys.select(F.col("p_partkey").alias("start")), edges)


#: Top class, sub class, keyword.
_KEYWORDS = [("law", "license", w) for w in ("license", "apache", "gnu", "mit", "public")] + [("law", "terms", w) for w in ("under", "terms", "general", "released")] + [
    ("mail", "address", w) for w in ("email", "contact", "example", "com")
]


@query(
    "taxonomy_assign",
    rf"""WITH k(top, sub, word) AS (VALUES {','.join(str(x) for x in _KEYWORDS)}), e AS (SELECT doc_id, {_KEY.format('text')} AS key FROM documents),
        h AS (SELECT DISTINCT doc_id, split_part(key, ' ', 1) AS head, unnest(string_split(key, ' ')) AS word FROM e), x AS (SELECT * FROM h JOIN k USING (word)),
        s AS (SELECT doc_id, top, sub, CASE WHEN count(DISTINCT word) >= 2 AND max((word = head)::INT) = 1 THEN 0.9::DOUBLE WHEN count(DISTINCT word) >= 2 THEN 0.8::DOUBLE END AS c FROM x GROUP BY ALL),
        a AS (SELECT doc_id, top, sub, c FROM s WHERE c IS NOT NULL UNION ALL SELECT doc_id, top, '', c FROM s WHERE c IS NOT NULL
              UNION ALL SELECT doc_id, top, '', 0.7::DOUBLE FROM x GROUP BY doc_id, top HAVING count(DISTINCT word) >= 2)
        SELECT doc_id, top, sub, max(c) AS confidence FROM a GROUP BY ALL""",
)
def taxonomy_assign(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), "")
    e = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("entry_id"), F.get(words, F.lit(0)).alias("headword"), F.array_distinct(words).alias("tokens"))
    k = spark.createDataFrame(_KEYWORDS, "top string, sub string, word string")
    return graph.classify(e, F.broadcast(k)).withColumnRenamed("entry_id", "doc_id")  # the keyword table is a constant


#: Top class, part (a sub class, '' for the top's own words, None for its domain words), word.
_TIERS = [("law", "", w) for w in ("license", "public", "terms")] + [("law", "license", w) for w in ("apache", "gnu", "mit", "general")] + [("law", None, "of")] + [
    ("mail", "", w) for w in ("email", "contact")
] + [("mail", "address", w) for w in ("example", "com", "org")] + [("mail", None, "der")]
_TIER_SQL = ", ".join(f"('{top}', {'NULL' if part is None else repr(part)}, '{word}')" for top, part, word in _TIERS)


@query(
    "taxonomy_tiers",
    rf"""WITH RECURSIVE k(top, part, word) AS (VALUES {_TIER_SQL}),
        e AS (SELECT doc_id, string_split({_KEY.format('text')}, ' ') AS t, ['license', 'contact', 'apache', 'x'][doc_id % 4 + 1] AS head FROM documents),
        w AS (SELECT DISTINCT doc_id, head, word FROM (SELECT doc_id, head, unnest(t) AS word FROM e UNION ALL SELECT doc_id, head, head FROM e)),
        h AS (SELECT doc_id, top, part, bool_or(word = head) AS own, count(*) FILTER (WHERE word <> head) AS n FROM w JOIN k USING (word) GROUP BY ALL),
        up(start, node, d) AS (SELECT item_id, item_id, 0 FROM benchmark UNION ALL SELECT start, node // 2, d + 1 FROM up WHERE d < 5 AND node // 2 <> node),
        c AS (SELECT DISTINCT start, top FROM (SELECT start, unnest(string_split({_KEY.format('text')}, ' ')) AS word FROM up JOIN benchmark ON item_id = node) JOIN k USING (word) WHERE part IS NULL),
        b AS (SELECT DISTINCT doc_id, top FROM h WHERE coalesce(part, '') = '' AND n > 0),
        r AS (SELECT h.doc_id, h.top, part, CASE WHEN own AND (n > 0 OR b.doc_id IS NOT NULL) THEN 0.9::DOUBLE WHEN n >= 2 AND part = '' THEN 0.7::DOUBLE WHEN n >= 2 THEN 0.8::DOUBLE END AS c
              FROM h LEFT JOIN b ON b.doc_id = h.doc_id AND b.top = h.top WHERE part IS NOT NULL),
        a AS (SELECT doc_id, top, part AS sub, c FROM r WHERE c IS NOT NULL UNION ALL SELECT doc_id, top, '', c FROM r WHERE c IS NOT NULL
              UNION ALL SELECT doc_id, top, '', 0.85::DOUBLE FROM e JOIN c ON start = doc_id % 40)
        SELECT doc_id, top, sub, max(c) AS confidence, CASE WHEN max(c) = 0.9::DOUBLE THEN 'headword' WHEN max(c) = 0.85::DOUBLE THEN 'wordnet-chain' ELSE 'gloss' END AS method FROM a GROUP BY doc_id, top, sub""",
)
def taxonomy_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as glosses with four headwords in turn, linked to benchmark items as synsets; edges lead from an item to its half."""
    tokens = F.array_distinct(F.split(_native_key(F.col("text")), " "))
    head = F.get(F.array(*[F.lit(w) for w in ("license", "contact", "apache", "x")]), (F.col("doc_id") % 4).cast("int"))
    e = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("entry_id"), head.alias("headword"), tokens.alias("tokens"))
    items = table(spark, sf, "benchmark", "item_id", "text").select(F.col("item_id").alias("synset_id"), tokens.alias("tokens"))
    edges = items.select(F.col("synset_id").alias("from_id"), F.expr("synset_id div 2").alias("to_id")).where("from_id <> to_id")
    k = spark.createDataFrame(_TIERS, "top string, sub string, word string")
    domains, own = k.where("sub is null").select("top", "word"), k.where("sub is not null")
    links = e.select("entry_id", (F.col("entry_id") % 40).alias("synset_id")).join(items.select("synset_id"), "synset_id", "left_semi")
    chains = graph.chain_words(links, edges, items, domains.select("word"))
    return graph.taxonomy(e, own, domains, chains).withColumnRenamed("entry_id", "doc_id")
