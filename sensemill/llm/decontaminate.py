"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is two runs of three words with a fixed number of ignored words between them. Seeds of
benchmark items and of documents meet by hash; each meeting names an alignment of item and
document, and along it words are compared. With the gaps used here every window of 13 words of
which at most two are substituted holds a seed, wherever the substitutions stand. An item of 3 to 12 words with
as many substitutions as it may have still holds one run of three words, so such items meet documents by single runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RUN, GAPS = 3, (0, 1, 3, 4)
WINDOW, SIMILAR = 13, 0.8
#: Shorter items must stand unchanged; those with fewer words than a run, alone in their document.
SHORTEST = 2 * RUN
#: Benchmark seeds up to this number (about 100 MB in memory) are sent to every executor; more are joined by shuffle.
MOST_SEEDS_SENT = 2_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _let(value: Column, f) -> Column:
    """f(value), with value computed once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def placed(df: DataFrame, id_: str, at: str) -> DataFrame:
    """(id, word position, head, next): for each word position but the last five, the hash of the run that begins
    there, and the hashes of the runs that may follow it, one for each gap (null beyond the text)."""

    def of_words(h: Column) -> Column:
        return F.when(F.size(h) >= 2 * RUN, F.transform(F.sequence(F.lit(0), F.size(h) - RUN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)])))

    def of_runs(g: Column) -> Column:
        after = lambda i: F.struct(*[F.get(g, i + (RUN + k)).alias(f"g{k}") for k in GAPS])
        return F.transform(F.sequence(F.lit(0), F.size(g) - RUN - 1), lambda i: F.struct(F.get(g, i).alias("head"), after(i).alias("next")))

    runs = _let(_let(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), of_words), of_runs)
    return df.select(F.col(id_), F.posexplode(runs).alias(at, "x")).select(id_, at, "x.head", "x.next")


def seeded(rows: DataFrame, *columns: str) -> DataFrame:
    """The seeds of placed rows: one for each gap after which a run follows."""
    pairs = F.array(*[F.when(F.col(f"next.g{k}").isNotNull(), F.xxhash64("head", F.col(f"next.g{k}"), F.lit(k))) for k in GAPS])
    return rows.select(*columns, F.explode(pairs).alias("seed")).where("seed is not null")


def single(df: DataFrame, id_: str, at: str) -> DataFrame:
    """(id, word position, head): the hash of the run of words that begins there, at every position that has one."""
    h = lambda v: F.when(F.size(v) >= RUN, F.transform(F.sequence(F.lit(0), F.size(v) - RUN), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(RUN)])))
    runs = _let(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), h)
    return df.select(F.col(id_), F.posexplode(runs).alias(at, "head"))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """Pairs of document and benchmark item that share a passage: docs (doc_id, text), benchmark (item_id, text).

    Returns one row per pair: doc_id, item_id, matched (most equal words in a window of the item laid
    along the document), window, similarity (matched / window).

    An item of `window` words or more is found where some window of it has at least `similar` of its
    words at the same distances in the document; one of 6 or more words where that holds for all its words; one of 3 to 5 where
    all its words stand in a row; one of 1 or 2 where the document has no other words. Words are runs of letters and digits in lower case. Null or empty texts and null
    ids are never found. Rows that repeat an id count together.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items, _ = written(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct(),
        "items",
    )
    known, _ = written(seeded(placed(items, "item_id", "item_at"), "item_id", "item_at", "head").distinct(), "seeds")
    heads = known.select("head").distinct()
    if known.limit(MOST_SEEDS_SENT + 1).count() <= MOST_SEEDS_SENT:
        known, heads = F.broadcast(known), F.broadcast(heads)
    # Most word positions begin no run of any item, so they go before their seeds are made.
    hits, _ = written(
        seeded(placed(docs, "doc_id", "doc_at").join(heads, "head", "left_semi"), "doc_id", "doc_at").join(known, "seed")
        .groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.count(F.lit(1)).alias("n_seeds")),
        "hits",
    )
    # Items shorter than the window; most benchmarks have none, and then documents are not looked through for them.
    few = items.where(F.size(words(F.col("text"))).between(1, window - 1))
    short = not few.isEmpty()
    if short:
        runs = single(few, "item_id", "item_at")
        found = single(docs, "doc_id", "doc_at").join(runs, "head").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
        hits, _ = written(hits.select("doc_id", "item_id", "shift").unionByName(found).distinct(), "hits")
    a = docs.join(hits, "doc_id").select("doc_id", "item_id", "shift", words(F.col("text")).alias("a"))
    b = items.select("item_id", words(F.col("text")).alias("b"))
    at = F.sequence(F.lit(0), F.size("b") - 1)
    # get() gives null outside the document; words before its start are asked for at -1 and so null too
    equal = F.transform(at, lambda j: F.coalesce(F.get(F.col("a"), F.greatest(j + F.col("shift"), F.lit(-1))) == F.get(F.col("b"), j), F.lit(False)).cast("int"))
    wide = F.least(F.lit(window), F.size("e"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("e") - wide + 1), lambda s: F.aggregate(F.slice("e", s, wide), F.lit(0), lambda x, y: x + y)))
    found = (
        a.join(b, "item_id")
        .select("doc_id", "item_id", equal.alias("e"))
        .select("doc_id", "item_id", best.alias("matched"), wide.alias("window"))
        .where((F.col("matched") >= similar * F.col("window")) & ((F.col("window") >= SHORTEST) | (F.col("matched") == F.col("window"))))
        .groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched") / F.col("window"), "matched", "window")).alias("m"))
        .select("doc_id", "item_id", F.col("m.matched").cast("long").alias("matched"), F.col("m.window").cast("long").alias("window"), (F.col("m.matched") / F.col("m.window")).alias("similarity"))
    )
    if short:
        alone = lambda df, id_: df.select(id_, words(F.col("text")).alias("w")).where(F.size("w").between(1, RUN - 1)).distinct()
        n = F.size("w").cast("long")
        found = found.unionByName(alone(docs, "doc_id").join(alone(few, "item_id"), "w").select("doc_id", "item_id", n.alias("matched"), n.alias("window"), F.lit(1.0).alias("similarity")).distinct())
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without the rows whose doc_id shares a passage with a benchmark item; null doc_ids stay."""
    found, _ = written(overlaps(docs, benchmark, **parameters).select(F.col("doc_id").alias("id")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].cast("long") == found["id"], "left_anti")
