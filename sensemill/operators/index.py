"""Full text over a positional inverted index that is kept as a table.

A unit is one text of an entity: a field of its own, or one row of a child table. Postings (term, field, key, child, places
of the term) are stored by term bucket, so a request reads the buckets of its words only. A refresh compares the units'
digests with those of the manifest and tokenises new and changed units alone; what they supersede is listed as stale. The manifest of
a generation is written last and commits it: a generation without one is not read and is written anew.

Fields are grouped to vectors: words of a request may stand in different fields of one vector, but a child row is a vector
by itself. A phrase stands within one field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.operators.search import tokens
from sensemill.tables import session_folder

#: Term buckets, each a folder; and files that a bucket is dealt to by key, so that frequent words don't make one task.
BUCKETS, SHARES = 32, 4
_UNIT = ("field", "key", "child")
#: Words that are put in order at once, and rows of a batch of postings.
_WORDS, _ROWS = 1 << 20, 50_000

Has = Callable[[list[str]], Column]


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*_UNIT, "term", "positions"]
    for batch in batches:
        sizes = np.array([0, *pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)], np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < batch.num_rows:  # units of some _WORDS words at once, one at least
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _WORDS, "right")) - 1)
            units, n = batch.slice(a, b - a), sizes[a + 1 : b + 1]
            words = units.column("words").flatten().dictionary_encode()
            code, unit = words.indices.to_numpy(), np.repeat(np.arange(b - a), n)
            place = np.arange(len(code)) - np.repeat(ends[a:b] - ends[a], n)
            rank = np.argsort(pc.sort_indices(words.dictionary).to_numpy())
            # places of a word in a unit together and in order; by words, so that the sort of a bucket finds long runs in order
            both = rank[code] * (b - a) + unit
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.diff(both[order], prepend=-1))
            of, term = pa.array(unit[order[first]]), words.dictionary.take(pa.array(code[order[first]]))
            positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)].astype(np.int32)), pa.array(place[order].astype(np.int32)))
            rows = pa.RecordBatch.from_arrays([*(units.column(c).take(of) for c in _UNIT), term, positions], names)
            for at in range(0, rows.num_rows, _ROWS):
                yield rows.slice(at, _ROWS)
            a = b


class Index:
    """The index in a folder. Its methods other than refresh() only read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs, self._path = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.Path

    def generation(self) -> int:
        """The last one that is whole; 0 without any."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        whole = [int(n[2:]) for n in names if n.startswith("g=") and self._fs.exists(self._path(f"{self.path}/manifest/{n}/_SUCCESS"))]
        return max(whole, default=0)

    def manifest(self) -> DataFrame:
        """field, key, child, digest, at (the generation that holds the unit's postings), state (of the source)."""
        return self.spark.read.parquet(f"{self.path}/manifest/g={self.generation()}")

    def refresh(self, units: DataFrame, state: str = "") -> int:
        """Brings the index to units (field, key, child, text; each field, key and child once); returns how many units were tokenised.

        A null text has no words. A null child is child 0; units without a key are left out.
        """
        old, n = self.generation(), self.generation() + 1
        units = units.where("key is not null").select("field", F.col("key").cast("long").alias("key"), F.coalesce("child", F.lit(0)).cast("long").alias("child"), "text")
        now = units.withColumn("digest", F.xxhash64("text"))
        if old:
            held = self.manifest().drop("state")
            new = now.join(held.drop("at"), [*_UNIT, "digest"], "left_anti")
            gone = held.join(now.drop("text"), [*_UNIT, "digest"], "left_anti").select(*_UNIT, "at")
        else:
            new, gone = now, None
        posted = new.select(*_UNIT, tokens(F.col("text")).alias("words")).mapInArrow(_postings, "field string, key long, child long, term string, positions array<int>")
        posted = posted.withColumn("bucket", bucket_of(F.col("term")))
        posted.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SHARES))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings/at={n}")
        if gone is not None:
            gone.write.mode("overwrite").parquet(f"{self.path}/stale/g={n}")
            kept = held.join(now.drop("text"), [*_UNIT, "digest"], "left_semi")
            whole = kept.unionByName(new.select(*_UNIT, "digest", F.lit(n).alias("at")))
        else:
            whole = new.select(*_UNIT, "digest", F.lit(n).alias("at"))
        whole.withColumn("state", F.lit(state)).write.mode("overwrite").parquet(f"{self.path}/manifest/g={n}")
        return self.manifest().where(F.col("at") == n).count()

    def state(self) -> str | None:
        """What refresh() was told last about the source."""
        first = self.manifest().select("state").first() if self.generation() else None
        return first and first["state"]

    def postings(self, terms: list[str], fields: list[str] | None = None) -> DataFrame:
        """field, key, child, term, positions of the given terms: a scan of their buckets' folders."""
        n = self.generation()
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).collect()})
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & (F.col("at") <= n) & F.col("term").isin(terms))
        if fields is not None:
            rows = rows.where(F.col("field").isin(fields))
        if n > 1:  # superseded units: few beside the postings, and broadcast or not by their size
            stale = self.spark.read.parquet(*[f"{self.path}/stale/g={g}" for g in range(2, n + 1)])
            rows = rows.join(stale, [*_UNIT, "at"], "left_anti")
        return rows.select(*_UNIT, "term", "positions")

    def matches(self, condition: Callable[[Has], Column], terms: list[str], rank: list[str], weights: dict[str, float], vectors: dict[str, str], within: list[str] | None = None) -> DataFrame:
        """(key, score) of the entities of which a unit matches.

        condition makes a predicate of has(words), which says whether the words stand in a row in the unit; a condition that no
        word at all fulfils can't be asked of an index. terms: all words it asks for; rank: those that count for the score.
        vectors: the vector of each field. within: fields that are searched (all of vectors by default). A matching unit scores the sum of its
        fields' weights times the places of rank's words; an entity the sum over its vectors of its best unit.
        """
        asked: list[list[str]] = []

        def has(words: list[str]) -> Column:
            if words not in asked:
                asked.append(words)
            return F.col(f"has{asked.index(words)}")

        test = condition(has)
        within = list(vectors) if within is None else within
        rows = self.postings(terms, sorted({*within, *(f for f in weights if f in vectors)}))
        rows = rows.withColumn("vector", reduce(lambda a, f: a.when(F.col("field") == f, vectors[f]), vectors, F.when(F.lit(False), "")))
        # postings of a unit meet by key and child, so that an entity with very many children is spread
        unit = ["key", "vector", "child"]
        rows = rows.repartition("key", "child")
        places = {w: F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(terms)}
        weight = reduce(lambda a, f: a.when(F.col("field") == f, weights[f]), weights, F.when(F.lit(False), 0.0)).otherwise(0.0)
        count = F.sum(F.when(F.col("term").isin(rank), weight * F.size("positions")).otherwise(0.0)).alias("score")
        fields = rows.groupBy(*unit, "field").agg(count, *places.values())

        def stands(words: list[str]) -> Column:
            def begin(w: str, i: int) -> Column:
                return F.transform(F.col(f"p{terms.index(w)}"), lambda x: x - i)

            here = reduce(F.array_intersect, [begin(w, i) for i, w in enumerate(words)])
            return F.coalesce(F.size(here) > 0, F.lit(False)) & F.col("field").isin(within)

        units = fields.groupBy(*unit).agg(F.sum("score").alias("score"), *[F.bool_or(stands(w)).alias(f"has{i}") for i, w in enumerate(asked)])
        best = units.where(test).groupBy("key", "vector").agg(F.max("score").alias("score"))
        return best.groupBy("key").agg(F.sum("score").alias("score"))


def source_state(*tables: DataFrame) -> str:
    """The files of tables with their sizes and times: what changes when a table is written again."""
    spark = tables[0].sparkSession
    jvm, out = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for name in sorted({f for t in tables for f in t.inputFiles()}):
        status = jvm.Path(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm.Path(name))
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(out)


def opened(spark: SparkSession, name: str, units: DataFrame, *tables: DataFrame) -> Index:
    """The session's index of that name over units, refreshed if a file of tables has changed since."""
    index, state = Index(spark, f"{session_folder(spark)}/index-{name}"), source_state(*tables)
    if index.state() != state:
        index.refresh(units, state)
    return index
