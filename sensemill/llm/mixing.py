"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A document's place in the order of its source is a hash of its doc_id. A source that is to give
t of its s words gives every document floor(t / s) times and those below a hash threshold once
more. The threshold comes from histograms: words are summed by source and the hash's leading
bits, the bucket where the running sum passes the budget is found, and only that bucket's
documents are split by the next bits, down to a single hash value. Nothing is sorted by
document, and thresholds of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

HASH_BITS, LEVEL_BITS = 60, 10
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: A table of so few sources is sent to every executor; a larger one is joined by shuffle.
MOST_SOURCES_SENT = 100_000


def _ranked(sizes: DataFrame) -> DataFrame:
    """Numbers the sources by code point, null last, in column no. They are sorted in parts of about MOST_SOURCES_SENT."""
    parts = -(-sizes.count() // MOST_SOURCES_SENT) or 1
    order = F.col("source").asc_nulls_last()
    rows, _ = written(sizes.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(offsets), "part").withColumn("no", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh `weights` in turn and share `share` times all words.
    A source stops at `cap` times its own; what is over is shared again by weight until none is
    above: each round is one sum over all sources, and sources that are full stay so.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    size = F.col("source_size").cast("double")
    rows, _ = written(_ranked(sizes).select("source", "source_size", w.alias("weight"), (size * cap).alias("full")), "weights")
    budget = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, open_ = float("-inf"), None
    while True:
        over = F.col("full") <= F.lit(level) * F.col("weight")
        full, weight, n = rows.agg(F.coalesce(F.sum(F.when(over, F.col("full"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight"))), F.count_if(~over)).first()
        if not n or n == open_:
            break
        level, open_ = (budget - full) / weight, n
    return rows.select("source", "source_size", F.least("full", F.lit(level) * F.col("weight")).alias("target"))


ADDED = ("size", "source_size", "target", "taken")


def sized(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, source, size and the hash h of 60 bits that orders the documents of a source; row: all columns of
    docs in one struct, but for those whose names the mix gives itself."""
    id_, source, text = (docs[c] for c in ("doc_id", "source", "text"))
    h = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    whole = [F.struct(*[docs[c] for c in docs.columns if c.lower() not in ADDED]).alias("row")] if row else []
    return docs.select(*whole, id_.alias("doc_id"), source.alias("source"), size.alias("size"), h.alias("h"))


def thresholds(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rows as sized() gives them. Per source: target, copies that each document gives, and the hash
    `cut` with the flag `cut_in`: documents below it, or at it if cut_in, give one more."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan, _ = written(
        targets(sizes, weights, share, cap)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")),
        "targets",
    )
    bound = plan.select("source", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("at"))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = rows.where("size > 0").withColumn("bucket", F.shiftright("h", shift))
        b = bound.withColumnRenamed("source", "of")
        if level:
            inside = inside.join(_small(b), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("prefix")))
            sums = inside.groupBy("source", "bucket", "rest", "below").agg(F.sum("size").alias("n"))
        else:
            sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("n")).join(_small(b), F.col("source").eqNullSafe(F.col("of")))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        bound, _ = written(
            sums.withColumn("upto", upto)
            .where("upto > rest and upto - n <= rest")
            .select("source", "rest", (F.col("upto") - F.col("n")).alias("below"), F.col("bucket").alias("prefix"), F.col("n").alias("at")),
            "bounds",
        )
    cut = bound.select(
        F.col("source").alias("of"), F.col("prefix").alias("cut"), (F.col("below") + F.col("at") - F.col("rest") < F.col("rest") - F.col("below")).alias("cut_in")
    )
    out, _ = written(plan.join(_small(cut), F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "cuts")
    return out


def _small(per_source: DataFrame) -> DataFrame:
    """Sends a table of one row per source to all executors if it has few rows."""
    return F.broadcast(per_source) if per_source.limit(MOST_SOURCES_SENT + 1).count() <= MOST_SOURCES_SENT else per_source


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, keep: bool = False) -> DataFrame:
    """Mixes docs (doc_id, source, text): a row for each row of docs with

    doc_id, size (words), source_size, target (of its source), taken (words the mix takes: size times
    the document's copies). keep: all columns of docs come too, and rows of which nothing is taken go.

    Each source's taken words differ from its target by at most its largest document. A null text has
    size 0; a null source is a source; rows that repeat a doc_id are taken alike. The choice depends
    on doc_id alone, so reruns agree. No rows give no rows. The four columns that the result adds
    replace columns of docs with these names, in upper or lower case; other names are free.
    """
    small, _ = written(sized(docs), "sized")
    cuts = thresholds(small, weights, share, cap).withColumnRenamed("source", "of")
    rows = sized(docs, row=True) if keep else small
    extra = F.coalesce((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("cut_in")), F.lit(False))
    out = rows.join(_small(cuts), F.col("source").eqNullSafe(F.col("of"))).withColumn("taken", F.col("size") * (F.col("copies") + extra.cast("long")))
    return out.where("taken > 0").select("row.*", *ADDED) if keep else out.select("doc_id", *ADDED)
