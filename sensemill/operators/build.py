"""Steps of a corpus build and of what is kept beside it: evidence, appended positions, retirement, reports, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_evidence(candidates: DataFrame, levels: DataFrame, frequency: DataFrame, key: str = "key") -> DataFrame:
    """Candidates with all level rows of their key (an empty list without) and its best rank. Evidence is grouped by key
    before it meets the candidates, so no candidate is multiplied."""
    level = levels.groupBy(key).agg(F.array_sort(F.collect_list("level")).alias("levels"))
    rank = frequency.groupBy(key).agg(F.min("rank").alias("rank"))
    none = F.array().cast(level.schema["levels"].dataType)
    return candidates.join(level, key, "left").join(rank, key, "left").withColumn("levels", F.coalesce("levels", none))


def candidate_synsets(entries: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """entries (key, lemma, letter) with the sorted synsets of their lemma and part-of-speech letter; none is an empty list."""
    some = links.groupBy("lemma", "letter").agg(F.array_sort(F.collect_set("synset_id")).alias("synsets"))
    return entries.join(some, ["lemma", "letter"], "left").select(key, F.coalesce("synsets", F.array().cast(some.schema["synsets"].dataType)).alias("synsets"))


def appended(held: DataFrame, new: DataFrame, group: str, *order: str) -> DataFrame:
    """New rows with the positions after the last that their group holds, from 0 where it holds none."""
    last = held.groupBy(group).agg(F.max("position").alias("last"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return new.withColumn("n", n).join(last, group, "left").withColumn("position", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("long")).drop("n", "last")


def retired(entities: DataFrame, new_keys: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, str | None]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Entities whose key a rebuild still has (keys are not null), and the child rows that stay.

    children: by name a table, its foreign key and its own key; each hangs on the one before it, the first on the
    entities. A child whose own key is None has no children.
    """
    kept = entities.join(new_keys.select(key), key, "left_semi")
    gone = entities.join(new_keys.select(key), key, "left_anti").select(F.col(key).alias("of"))
    left = {}
    for name, (rows, foreign, own) in children.items():
        left[name] = rows.join(gone, rows[foreign] == gone["of"], "left_anti")
        if own:
            gone = rows.join(gone, rows[foreign] == gone["of"], "left_semi").select(F.col(own).alias("of"))
    return kept, left


def retirement_report(entities: DataFrame, kept: DataFrame, left: dict[str, DataFrame], children: dict[str, DataFrame]) -> DataFrame:
    """One row of a dry run: how many entities and child rows would go, and how many entities stay."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    parts = [(count(entities, "a"), count(kept, "b"), "entities"), *((count(children[c], "a"), count(left[c], "b"), c) for c in left)]
    out = count(kept, "kept")
    for a, b, name in parts:  # single rows
        out = out.join(F.broadcast(a.join(F.broadcast(b), F.lit(True)).select((F.col("a") - F.col("b")).alias(name))), F.lit(True))
    return out


def report(rows: DataFrame, level: str, value: str, conflict: Column) -> DataFrame:
    """Per level: rows, mean, least and most of a value, and conflicts."""
    return rows.groupBy(F.col(level).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(conflict).alias("conflicts")
    )


def taxonomy_nodes(classes: DataFrame) -> DataFrame:
    """(top, sub) as nodes: key, parent (null for a top), depth. A top without subs has a row with a null sub."""
    tops = classes.select(F.col("top").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    subs = classes.where("sub is not null").select(F.concat_ws("/", "top", "sub").alias("key"), F.col("top").alias("parent"), F.lit(1).alias("depth"))
    return tops.unionByName(subs).distinct()


def begun(log: DataFrame | None, spark: SparkSession, run_id: str, run: str, at: str) -> DataFrame:
    """The run log with one more row; a rerun of an id begins it afresh."""
    row = spark.createDataFrame([(run_id, run, "running", at, None, None)], "run_id string, run string, status string, begun string, ended string, stats string")
    return row if log is None else log.where(F.col("run_id") != run_id).unionByName(row)


def finished(log: DataFrame, stats: DataFrame, run_id: str, at: str, status: str = "finished") -> DataFrame:
    """The run log with this run's end and its counts (stats is one row) as JSON."""
    said = stats.select(F.to_json(F.struct("*")).alias("said"))
    own = F.col("run_id") == run_id
    out = log.join(F.broadcast(said), F.lit(True))  # one row
    return out.select("run_id", "run", F.when(own, status).otherwise(F.col("status")).alias("status"), "begun", F.when(own, at).otherwise(F.col("ended")).alias("ended"), F.when(own, F.col("said")).otherwise(F.col("stats")).alias("stats"))


def registered(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """The registry of sources: new rows replace those of their name."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
