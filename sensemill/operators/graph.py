"""Synset graphs: catalogues, neighbours, bounded closures, links from senses and taxonomy classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensemill.functions.text import definition_similarity, relation_group, stem

DEPTH = 5
#: Keyword lists up to this length are matched inside the row, before tokens become rows.
MOST_WORDS = 2_000


def catalogue(synsets: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synsets, the first of an id counting, and edges without repeats and loops, with their group."""
    first = Window.partitionBy("synset_id").orderBy("seq")
    nodes = synsets.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    kept = edges.where("from_id <> to_id").select("from_id", "to_id", "relation").distinct()
    return nodes, kept.withColumn("group", relation_group(F.col("relation")))


def neighbours(edges: DataFrame, group: str) -> DataFrame:
    return edges.where(F.col("group") == group).select("from_id", "to_id").distinct()


def closure(starts: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(start, node): every node within `depth` upward steps, the start itself too; cycles end by themselves.

    Each level is one join of the new nodes only.
    """
    up = edges.select(F.col("from_id").alias("node"), "to_id")
    level = starts.select(F.col("start"), F.col("start").alias("node")).distinct()
    found = level
    for _ in range(depth):
        level = level.join(up, "node").select("start", F.col("to_id").alias("node")).distinct()
        found = found.unionByName(level)
    return found.distinct()


#: Letters of synset ids that a part of speech may have.
LETTERS = {"noun": ["n"], "verb": ["v"], "adjective": ["a", "s"], "adverb": ["r"]}
SENSE_ID = 0.85


def link(senses: DataFrame, evidence: DataFrame, least: float = 0.60) -> DataFrame:
    """Links senses (sense_id, tokens) to candidate synsets (sense_id, synset_id, tokens), as linked() does."""
    pairs = evidence.withColumnRenamed("tokens", "b").join(senses.select("sense_id", F.col("tokens").alias("a")), "sense_id")
    return linked(pairs.select("sense_id", "synset_id", "a", "b"), least)


def linked(pairs: DataFrame, least: float = 0.60) -> DataFrame:
    """Links senses to the best of their candidates, pairs (sense_id, synset_id, and the tokens of both, a and b), by the
    rules of link_senses with tokens as they are; all that stay unlinked are ambiguous. Gives sense_id, synset_id,
    confidence, method for every sense with candidates."""
    similar, shared = F.round(definition_similarity(F.col("a"), F.col("b")), 6), F.size(F.array_intersect("a", "b"))
    out = _decided(pairs.select("sense_id", "synset_id", F.lit(True).alias("loaded"), similar.alias("sim"), shared.alias("shared")), least)
    return out.withColumn("method", F.when(F.col("synset_id").isNull(), "ambiguous").otherwise(F.col("method")))


def link_senses(senses: DataFrame, evidence: DataFrame, synsets: DataFrame, least: float = 0.60) -> DataFrame:
    """Links every sense (sense_id, lemma, pos, tokens of its gloss) to a synset or says why not.

    evidence: lemma, letter, synset_id; synsets: synset_id, tokens of the definition, members (their tokens).
    A candidate's letter fits the part of speech. One candidate links by its similarity if that is `least` or more,
    else as monosemous (0.80), and as sense-id (0.85) if it isn't among the synsets. Of several, those among the
    synsets count: the best similarity, if `least` or more, links unless tied; below that, most shared stems of
    definition and members (less the lemma's own), two at least, link unless tied (0.70). Similarity is that of tokens
    or that of stems, the larger one. Gives sense_id, synset_id, confidence and method; unlinked senses have null, null
    and no-evidence, pos-mismatch, ambiguous or weak-definition. Null tokens and members count as none.
    """
    none = F.array().cast("array<string>")

    def stems(tokens: Column) -> Column:
        return F.array_distinct(F.transform(tokens, stem))

    def named(name: str) -> list[Column]:
        tokens = F.coalesce("tokens", none)
        return [tokens.alias(name), stems(tokens).alias(f"{name}_stems")]

    letters = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in LETTERS.items()]))
    own = senses.select("sense_id", "lemma", stem(F.col("lemma")).alias("own"), F.coalesce(F.try_element_at(letters, F.col("pos")), none).alias("letters"), *named("a"))
    known = synsets.select("synset_id", *named("b"), stems(F.coalesce("members", none)).alias("m_stems"))
    held = evidence.where("synset_id is not null").groupBy("lemma", "synset_id").agg(F.collect_set("letter").alias("of"))  # a few letters
    pairs = own.join(held, "lemma", "left").withColumn("fits", F.coalesce(F.arrays_overlap("letters", "of"), F.lit(False)))
    fitting = pairs.where("fits").join(known, "synset_id", "left")
    similar = F.greatest(definition_similarity(F.col("a"), F.col("b")), definition_similarity(F.col("a_stems"), F.col("b_stems")))
    members = F.array_except("m_stems", F.array("own"))
    shared = F.size(F.array_intersect("a_stems", "b_stems")) + F.size(F.array_intersect("a_stems", members))
    loaded = F.col("b").isNotNull()
    best = _decided(fitting.select("sense_id", "synset_id", loaded.alias("loaded"), F.when(loaded, F.round(similar, 6)).alias("sim"), F.when(loaded, shared).alias("shared")), least)
    seen = pairs.groupBy("sense_id").agg(F.bool_or(F.col("synset_id").isNotNull()).alias("seen"))
    why = F.coalesce("method", F.when(F.col("seen"), "pos-mismatch").otherwise("no-evidence"))
    return seen.join(best, "sense_id", "left").select("sense_id", "synset_id", "confidence", why.alias("method"))


def _decided(scored: DataFrame, least: float) -> DataFrame:
    """One row of each sense of scored (sense_id, synset_id, loaded, sim, shared); sim and shared are null if not loaded."""
    of = Window.partitionBy("sense_id")
    scored = scored.withColumn("top", F.max("sim").over(of)).withColumn("most", F.max("shared").over(of))
    b = scored.groupBy("sense_id").agg(
        F.max("top").alias("sim"), F.max("most").alias("shared"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("sim") == F.col("top")).alias("n_sim"),
        F.count_if(F.col("shared") == F.col("most")).alias("n_shared"), F.max(F.when(F.col("loaded"), F.struct("sim", "synset_id"))).alias("by_sim"),
        F.max(F.when(F.col("loaded"), F.struct("shared", "synset_id"))).alias("by_shared"), F.max("synset_id").alias("any"),
    )
    only, high = F.col("n") == 1, F.col("sim") >= least
    good = high & (F.col("n_sim") == 1)
    tokens = ~high & (F.col("shared") >= 2) & (F.col("n_shared") == 1)
    tied = high | (F.col("shared") >= 2)
    return b.select(
        "sense_id",
        F.when(good, F.col("by_sim.synset_id")).when(only, F.col("any")).when(tokens, F.col("by_shared.synset_id")).alias("synset_id"),
        F.when(good, F.col("sim")).when(only, F.when(F.col("sim").isNull(), SENSE_ID).otherwise(0.80)).when(tokens, 0.70).alias("confidence"),
        F.when(good, "definition-match").when(only, F.when(F.col("sim").isNull(), "sense-id").otherwise("monosemous")).when(tokens, "shared-tokens")
        .when(tied, "ambiguous").otherwise("weak-definition").alias("method"),
    )


def words_among(tokens: Column, words: DataFrame) -> Column:
    """Distinct tokens of a row, only those among `words` (a column word) where these are few: so they are matched
    inside the row, before tokens become rows."""
    few = [r["word"] for r in words.select("word").distinct().limit(MOST_WORDS + 1).collect()]
    return F.array_intersect(tokens, F.array(*[F.lit(w) for w in few]).cast("array<string>")) if len(few) <= MOST_WORDS else F.array_distinct(tokens)


def classify(entries: DataFrame, keywords: DataFrame) -> DataFrame:
    """Taxonomy classes of entries (entry_id, headword, tokens) by a keyword table (top, sub, word).

    The headword as a keyword counts (0.90) if another token of the entry is one of the class too; two distinct
    keywords of a sub class among the tokens give it (0.80), two of a top class give that (0.70). A sub class
    yields its top. The best confidence of each class is kept.
    """
    hits = entries.select("entry_id", "headword", F.explode(words_among(F.col("tokens"), keywords)).alias("word")).join(keywords, "word")
    own = F.struct("sub", "word", (F.col("word") == F.col("headword")).alias("own"))
    per = hits.groupBy("entry_id", "top").agg(F.collect_set(own).alias("h"))  # at most the keywords of a class

    def sub(name: Column) -> Column:
        mine = F.filter("h", lambda x: x["sub"] == name)
        n = F.size(F.array_distinct(F.transform(mine, lambda x: x["word"])))
        return F.struct(name.alias("sub"), F.when(n >= 2, F.when(F.exists(mine, lambda x: x["own"]), 0.90).otherwise(0.80)).alias("confidence"))

    subs = F.filter(F.transform(F.array_distinct(F.transform("h", lambda x: x["sub"])), sub), lambda s: s["confidence"].isNotNull())
    several = F.when(F.size(F.array_distinct(F.transform("h", lambda x: x["word"]))) >= 2, 0.70)
    top = F.greatest(F.array_max(F.transform(F.col("subs"), lambda s: s["confidence"])), several)
    every = F.concat("subs", F.filter(F.array(F.struct(F.lit("").alias("sub"), top.alias("confidence"))), lambda s: s["confidence"].isNotNull()))
    return per.withColumn("subs", subs).select("entry_id", "top", F.inline(every))


def chain_words(links: DataFrame, edges: DataFrame, synsets: DataFrame, words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(entry_id, word): those of `words` (word) that stand in the definitions (synset_id, tokens) of the synsets of links
    (entry_id, synset_id) or of what lies up to `depth` upward edges (from_id, to_id) above. Each synset is walked once."""
    above = closure(links.select(F.col("synset_id").alias("start")), edges, depth)
    said = synsets.select(F.col("synset_id").alias("node"), F.explode(words_among(F.col("tokens"), words)).alias("word")).join(words.distinct(), "word")
    per = above.join(said, "node").select(F.col("start").alias("synset_id"), "word").distinct()
    return links.select("entry_id", "synset_id").join(per, "synset_id").select("entry_id", "word").distinct()


def taxonomy(entries: DataFrame, keywords: DataFrame, domains: DataFrame, chains: DataFrame) -> DataFrame:
    """Classes of entries (entry_id, headword, tokens) by all tiers; all words are stems.

    keywords: top, sub (null: the top's own), word; domains: top, word; chains: entry_id, word, as of chain_words().
    Evidence is the entry's tokens but its headword. A headword that is a keyword of a class counts (0.90, headword)
    with evidence among the class's own words or its top's keywords and domain words; a domain word of the synset
    chain gives the top (0.85, wordnet-chain); two keywords of a sub among the evidence give that (0.80, gloss), two of
    the top's own give the top (0.70, gloss). A sub yields its top; the best tier of each class is kept. Gives
    entry_id, top, sub ('' for the top itself), confidence, method.
    """
    # part: a sub class, '' for the top's own keywords, null for domain words
    k = keywords.select("top", F.coalesce("sub", F.lit("")).alias("part"), "word").unionByName(domains.select("top", F.lit(None).cast("string").alias("part"), "word")).distinct()
    tokens = F.array_union(F.coalesce("tokens", F.array().cast("array<string>")), F.array_compact(F.array("headword")))
    said = entries.select("entry_id", "headword", F.explode(words_among(tokens, k)).alias("word")).join(k, "word")
    own = F.col("word").eqNullSafe(F.col("headword"))
    hits = said.groupBy("entry_id", "top", "part").agg(F.bool_or(own).alias("own"), F.count_if(~own).alias("n"))
    linked_ = chains.distinct().join(domains.distinct(), "word").select("entry_id", "top", F.lit(True).alias("chain")).distinct()
    rows = hits.unionByName(linked_, allowMissingColumns=True)
    per = rows.groupBy("entry_id", "top").agg(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("part", "own", "n"))).alias("h"), F.bool_or("chain").alias("chain"))

    wide = F.exists("h", lambda x: F.coalesce(x["part"], F.lit("")).eqNullSafe(F.lit("")) & (x["n"] > 0))
    per = per.withColumn("wide", wide)

    def tier(x: Column) -> Column:
        return F.when(x["own"] & ((x["n"] > 0) | F.col("wide")), 0.90).when(x["n"] >= 2, F.when(x["part"] == "", 0.70).otherwise(0.80))

    reached = F.filter(F.transform("h", lambda x: F.struct(x["part"].alias("sub"), tier(x).alias("confidence"))), lambda s: s["sub"].isNotNull() & s["confidence"].isNotNull())
    best = F.greatest(F.array_max(F.transform("reached", lambda s: s["confidence"])), F.when(F.col("chain"), 0.85))
    subs = F.filter("reached", lambda s: s["sub"] != "")
    every = F.concat(subs, F.filter(F.array(F.struct(F.lit("").alias("sub"), best.alias("confidence"))), lambda s: s["confidence"].isNotNull()))
    out = per.withColumn("reached", reached).select("entry_id", "top", F.inline(every))
    return out.withColumn("method", F.when(F.col("confidence") == 0.90, "headword").when(F.col("confidence") == 0.85, "wordnet-chain").otherwise("gloss"))
