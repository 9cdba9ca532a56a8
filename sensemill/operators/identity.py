"""Sense identity: greedy clustering of candidates inside (headword, part of speech) blocks.

The rule is a sequential scan: a candidate joins the first cluster whose founder means the same, else founds one. Its
founders are found in rounds instead: of the pairs that mean the same, a candidate founds as soon as none of the earlier ones
it pairs with is undecided, and what pairs with a founder does not found. No block is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensemill.functions.text import same_meaning
from sensemill.tables import delete, staged

#: The least Jaccard similarity of any two token sets that mean the same and don't lie one inside the other.
LEAST_SIMILAR = 0.6


def similar_pairs(sets: DataFrame, *block: str) -> DataFrame:
    """Of sets (block columns, id, tokens; distinct and not empty): (a, b) of all pairs in a block that mean the same, a < b.

    Pairs meet on a token. A set is looked for under its rarest tokens of the block only: if it lies in the other set or shares
    LEAST_SIMILAR of its own tokens with it, the other holds one of the rarest n - ceil(LEAST_SIMILAR n) + 1 of them.
    """
    each = sets.select(*block, "id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    often = each.groupBy(*block, "token").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, [*block, "token"]).groupBy(*block, "id").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("tokens"))
    n = F.size("tokens")
    rare = F.slice("tokens", F.lit(1), n - F.ceil(n * F.lit(LEAST_SIMILAR) - F.lit(1e-9)).cast("int") + 1)
    probe = ranked.select(*block, F.col("id").alias("p"), n.alias("np"), F.explode(rare).alias("t")).select(*block, "p", "np", F.col("t.token").alias("token"))
    met = probe.join(each.withColumnRenamed("id", "q"), [*block, "token"]).where((F.col("p") != F.col("q")) & (F.col("np") <= F.col("size")))
    met = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    text = sets.select("id", "tokens")
    both = met.join(text.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(text.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.where(same_meaning(F.col("ta"), F.col("tb"))).select("a", "b")


def meaning_pairs(senses: DataFrame, key: str, *block: str) -> DataFrame:
    """(a, b) of all pairs of senses (block columns, key, tokens) in a block that mean the same, a < b. Null blocks and keys pair with nothing.

    Meanings are compared once for each two different token sets of a block; their members are then joined, so that the work on
    a pair of senses is writing it."""
    rows = senses.where(F.size("tokens") > 0).select(*block, F.col(key).alias("id"), "tokens")
    sets = rows.select(*block, "tokens").distinct()
    both = sets.withColumnRenamed("tokens", "a").join(sets.withColumnRenamed("tokens", "b"), [*block]).where(same_meaning(F.col("a"), F.col("b")))
    left = rows.withColumnsRenamed({"tokens": "a", "id": "ida"}).join(both, [*block, "a"])
    out = left.join(rows.withColumnsRenamed({"tokens": "b", "id": "idb"}).hint("merge"), [*block, "b"]).where("ida < idb")
    return out.select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def followers(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) with a before b: (b, a) of every node that founds nothing, with its first founder.

    Each round decides the nodes that no undecided one stands before, so a round is two joins of what is left of the pairs.
    """
    pairs, first_path = staged(pairs, "pairs")
    left, path, taken, paths = pairs, None, None, []
    while not left.isEmpty():
        new = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone, gone_path = staged(left.join(new, "a", "left_semi").select("b").distinct(), "followers")
        paths.append(gone_path)
        after = left.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
        left, new_path = staged(after, "undecided")
        if path:
            delete(pairs.sparkSession, path)
        path = new_path
        taken = gone if taken is None else taken.unionByName(gone)
    if taken is None:
        return pairs.select("b", "a")
    taken, _ = staged(taken, "followers")
    out, _ = staged(pairs.join(taken, "b").join(taken.withColumnRenamed("b", "a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("a")), "first-founders")
    for p in [first_path, path, *paths]:
        delete(pairs.sparkSession, p)
    return out


def clusters(candidates: DataFrame) -> DataFrame:
    """candidates: headword, pos, candidate_id, ordering, tokens. Gives candidate_id and the founder's id as cluster_id.

    Candidates are taken by ordering, then candidate_id, in which nulls come first. Equal token sets of a block are
    one candidate, the first of them; no tokens mean the same as nothing, so such candidates found each their own.
    """
    rows = candidates.select("headword", "pos", "candidate_id", F.struct("ordering", "candidate_id").alias("id"), F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens"))
    block = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in ("headword", "pos")]
    rows, _ = staged(rows.select(*block, "candidate_id", "id", "tokens"), "candidates")  # tokens are made once, here
    sets, _ = staged(rows.where(F.size("tokens") > 0).groupBy("headword", "pos", "tokens").agg(F.min("id").alias("id")), "token-sets")
    first = followers(similar_pairs(sets, "headword", "pos")).select(F.col("b").alias("id"), F.col("a").alias("founder"))
    found = sets.join(first, "id", "left").select("headword", "pos", "tokens", F.coalesce("founder", "id")["candidate_id"].alias("cluster_id"))
    joined = rows.join(found, ["headword", "pos", "tokens"], "left")
    return joined.select("candidate_id", F.coalesce("cluster_id", "candidate_id").alias("cluster_id"))


def with_suffix(clustered: DataFrame, base: str, order: str) -> DataFrame:
    """sense_key: the base key, with -2, -3 … from the second cluster of a base on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return clustered.withColumn("__n", n).withColumn("sense_key", F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat_ws("-", base, "__n"))).drop("__n")


#: Translations a sense gets in turn, and the confidence of each way to a translation.
ALIGN_CAP = 3
ALIGNED = {"inline": 0.95, "cognate": 0.50, "token": 0.70, "position": 0.35}


def _placed(sense: Column, text: Column, method: str) -> Column:
    return F.struct(sense.cast("int").alias("sense"), F.lit(-ALIGNED[method]).alias("order"), text.alias("translation"), F.lit(method).alias("method"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: columns named in a lambda are computed again for each element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def align_translations(entries: DataFrame) -> DataFrame:
    """Entries with a column aligned: what each sense is translated by, as structs (sense, translation, confidence, method)
    by sense, falling confidence and text.

    entries: word_key, inline (an array of (text, key) for each sense: translations its gloss names) and words ((text, key) of
    the entry's own translations, in order); key is the search key of text. Inline translations stand first. The first word whose
    key is word_key is the cognate of every sense. Of the other words without an inline key, a key that shares a token of three
    characters with a sense's inline keys goes to the sense that shares most (the first of several), once; the rest goes to the
    senses in turn, ALIGN_CAP to a sense, and what is left after that to none. Nulls among words or inline ones are passed over,
    null arrays count as empty, and an entry without senses gets an empty array. All other columns stay.
    """
    none = F.array().cast("array<struct<text:string,key:string>>")

    def kept(words: Column) -> Column:
        return F.filter(F.coalesce(words, none), lambda w: w["text"].isNotNull() & w["key"].isNotNull())

    def tokens(key: Column) -> Column:
        return F.array_distinct(F.filter(F.split(key, " "), lambda t: F.length(t) >= 3))

    def taken(w: Column) -> Column:
        return (F.coalesce(F.array_max(w["shared"]), F.lit(0)) > 0) & (w["key"] != "")

    def facts(e: Column) -> Column:
        cognate = F.get(F.filter(e["words"], lambda w: w["key"] == e["word_key"]), F.lit(0))["text"]
        own = F.when(cognate.isNull(), F.array().cast("array<string>")).otherwise(F.array(e["word_key"]))
        used = F.concat(F.flatten(F.transform(e["inline"], lambda ws: F.transform(ws, lambda w: w["key"]))), own)
        sets = F.transform(e["inline"], lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: tokens(w["key"])))))
        return F.struct(cognate.alias("cognate"), used.alias("used"), sets.alias("sets"))

    def unused(e: Column, f: Column) -> Column:
        def measured(w: Column) -> Column:
            shared = _bound(tokens(w["key"]), lambda t: F.transform(f["sets"], lambda s: F.size(F.array_intersect(t, s))))
            return F.struct(w["text"].alias("text"), w["key"].alias("key"), shared.alias("shared"))

        return F.transform(F.filter(e["words"], lambda w: ~F.array_contains(f["used"], w["key"])), measured)

    def together(e: Column, f: Column, left: Column) -> Column:
        def firsts(near: Column) -> Column:
            keys = F.transform(near, lambda w: w["key"])
            first = _bound(keys, lambda k: F.filter(near, lambda w, i: F.array_position(k, w["key"]) == i + 1))
            return F.transform(first, lambda w: _placed(F.array_position(w["shared"], F.array_max(w["shared"])) - 1, w["text"], "token"))

        n = F.size(e["inline"])
        inline = F.flatten(F.transform(e["inline"], lambda ws, s: F.transform(ws, lambda w: _placed(s, w["text"], "inline"))))
        cognate = F.filter(F.transform(e["inline"], lambda _, s: _placed(s, f["cognate"], "cognate")), lambda x: x["translation"].isNotNull())
        token = _bound(F.filter(left, taken), firsts)
        rest = F.slice(F.filter(left, lambda w: ~taken(w)), F.lit(1), n * ALIGN_CAP)
        turn = F.transform(rest, lambda w, i: _placed(F.pmod(i, n), w["text"], "position"))
        return F.transform(F.array_sort(F.concat(inline, cognate, token, turn)), lambda x: F.struct(
            x["sense"].alias("sense"), x["translation"].alias("translation"), (-x["order"]).alias("confidence"), x["method"].alias("method")))

    senses = F.coalesce("inline", F.array().cast("array<array<struct<text:string,key:string>>>"))
    entry = F.struct(kept(F.col("words")).alias("words"), F.transform(senses, kept).alias("inline"), F.col("word_key").alias("word_key"))
    nothing = F.array().cast("array<struct<sense:int,translation:string,confidence:double,method:string>>")
    aligned = _bound(entry, lambda e: F.when(F.size(e["inline"]) == 0, nothing).otherwise(
        _bound(facts(e), lambda f: _bound(unused(e, f), lambda left: together(e, f, left)))))
    return entries.select("*", aligned.alias("aligned"))
