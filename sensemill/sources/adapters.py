"""Readers of word lists, dictionary dumps and synset folders.

Each gives one row per record read, with a verdict (processed, skipped, failed), the reason, and a
warning; nothing is dropped silently. stats() counts them, rejects() samples them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensemill.functions.score import LEVELS
from sensemill.functions.text import collapsed, search_key, usable_headword

SAMPLE = 100

_TEXT = T.StringType()
_SENSE = "struct<glosses:array<string>,tags:array<string>,examples:array<string>,id:string>"
DUMP = f"word string, lang string, pos string, senses array<{_SENSE}>, translations array<struct<code:string,word:string>>, categories array<string>"
SYNSET = "struct<definition:array<string>,example:array<string>,ili:string,members:array<string>,partOfSpeech:string"
#: Relations of a synset that count.
RELATIONS = [
    "hypernym", "instance_hypernym", "hyponym", "instance_hyponym", "similar", "mero_part", "mero_member", "mero_substance",
    "holo_part", "holo_member", "holo_substance", "derivation", "domain_topic", "domain_region", "causes", "entails",
]


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, the number of the row in its file (the header is row 1), and shard: of a folder of shard=… folders
    with a file each, the one it is in, else null.

    multiLine keeps a file in one task, so a list comes as files of some MB; their number is free."""
    df = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.select([F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    shard = F.col("shard").cast("long") if "shard" in df.columns else F.lit(None).cast("long")
    rows = df.select(*[F.col(f"`{c}`") for c in columns], shard.alias("shard"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("seq")) + 1).drop("file", "seq")


def _record(prefix: str) -> Column:
    return F.concat_ws(":", F.lit(prefix), "shard", F.lit("row"), "row")


def _again(*key: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy("shard", "row")) > 1


def _levelled(df: DataFrame, prefix: str, valid: list[str], pos_required: bool) -> DataFrame:
    level = F.upper(collapsed(F.coalesce("CEFR", F.lit(""))))
    df = df.select("shard", "row", collapsed(F.coalesce("headword", F.lit(""))).alias("headword"), collapsed(F.coalesce("pos", F.lit(""))).alias("pos"), level.alias("level"))
    failed = F.when(F.col("headword") == "", "missing_headword").when(~F.col("level").isin(valid), "bad_level")
    warning = F.when(F.contains("headword", F.lit("/")), "slash_variants").when(_again(F.lower("headword"), F.lower("pos")), "duplicate")
    if not pos_required:
        warning = F.coalesce(F.when(F.col("pos") == "", "missing_pos"), warning)
    return df.select(
        _record(prefix).alias("record_id"), "headword", F.nullif("pos", F.lit("")).alias("pos"), "level",
        F.when(failed.isNull(), "processed").otherwise("failed").alias("verdict"), failed.alias("reason"), F.when(failed.isNull(), warning).alias("warning"),
    )


def cefr_profile(spark: SparkSession, path: str) -> DataFrame:
    return _levelled(_csv(spark, path, ["headword", "pos", "CEFR"]), "cefrj", LEVELS, True)


def advanced_profile(spark: SparkSession, path: str) -> DataFrame:
    return _levelled(_csv(spark, path, ["headword", "pos", "CEFR"]), "octanove", ["C1", "C2"], False)


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    per_million = "Adjusted Frequency per Million (U)"
    df = _csv(spark, path, ["Lemma", "SFI Rank", "SFI", per_million])
    df = df.select(
        "shard", "row", collapsed(F.coalesce("Lemma", F.lit(""))).alias("lemma"), F.col("SFI Rank").try_cast("int").alias("rank"), F.col("SFI").try_cast("double").alias("sfi"),
        F.col(f"`{per_million}`").try_cast("double").alias("per_million"),
    )
    failed = F.when(F.col("lemma") == "", "missing_lemma").when(F.col("rank").isNull() | F.col("sfi").isNull() | F.col("per_million").isNull(), "not_a_number")
    return df.select(
        _record("ngsl").alias("record_id"), "lemma", "rank", "sfi", "per_million",
        F.when(failed.isNull(), "processed").otherwise("failed").alias("verdict"), failed.alias("reason"),
        F.when(failed.isNull() & _again(F.lower("lemma")), "duplicate").alias("warning"),
    )


def _example(x: Column) -> Column:
    """An example is a plain string, or an object (which arrives as its JSON text) whose text counts."""
    return F.when(F.startswith(x, F.lit("{")), F.coalesce(F.get_json_object(x, "$.text"), x)).otherwise(x)


def dictionary_dump(spark: SparkSession, path: str, targets: DataFrame | None = None) -> DataFrame:
    """JSON lines, gzipped or not: every line is parsed before any filter. targets: a column key, the search keys of
    the headwords that are wanted. A gzipped file is one task to read, so a dump comes as many files; one that does not
    has its lines dealt out before they are parsed."""
    lines = spark.read.text(path).select("value")
    if lines.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    e = lines.select(F.from_json("value", DUMP + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("e")).select("e.*")
    glossed = F.filter(
        F.transform(F.coalesce("senses", F.array()), lambda s: F.struct(
            F.get(F.filter(s["glosses"], lambda g: F.trim(g) != ""), F.lit(0)).alias("gloss"),
            F.slice(F.coalesce(F.transform(s["examples"], _example), F.array().cast("array<string>")), 1, 3).alias("examples"),
            F.transform(F.coalesce(s["tags"], F.array().cast("array<string>")), lambda x: F.trim(x)).alias("tags"), s["id"].alias("id"),
        )),
        lambda s: s["gloss"].isNotNull(),
    )
    polish = F.filter(F.transform(F.filter(F.coalesce("translations", F.array()), lambda t: t["code"] == "pl"), lambda t: F.trim(t["word"])), lambda w: w != "")
    e = e.withColumn("senses", glossed).withColumn("polish", polish)
    if targets is not None:
        e = e.join(targets.select(F.col("key").alias("__key")).distinct().withColumn("__wanted", F.lit(True)), search_key(F.col("word")) == F.col("__key"), "left")
    else:
        e = e.withColumn("__wanted", F.lit(True))
    failed = F.when(F.col("_bad").isNotNull() | (F.col("word").isNull() & F.col("lang").isNull()), "malformed")
    skipped = (
        F.when(F.coalesce(F.col("lang") != "English", F.lit(True)), "language").when(~usable_headword(F.col("word")), "headword")
        .when(F.col("__wanted").isNull(), "not_wanted").when(F.size("senses") == 0, "no_gloss")
    )
    return e.select(
        "word", "pos", "senses", "polish", "categories",
        F.when(failed.isNotNull(), "failed").when(skipped.isNotNull(), "skipped").otherwise("processed").alias("verdict"),
        F.coalesce(failed, skipped).alias("reason"), F.when(failed.isNull() & (skipped == "no_gloss"), "no_gloss").alias("warning"),
    )


def synset_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(synsets, relations, lemma links) of a folder of JSON objects; entries-*.json give the links."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    entry = F.startswith("file", F.lit("entries-"))
    kind = SYNSET + "".join(f",{r}:array<string>" for r in RELATIONS) + ">"
    # a definition may be text or a list; text that isn't a list is wrapped before parsing
    value = F.regexp_replace("value", r'"definition"\s*:\s*("(?:[^"\\]|\\.)*")', r'"definition": [$1]')
    nodes = files.where(~entry & (F.col("file") != "frames.json")).select(F.explode(F.from_json(value, f"map<string,{kind}>")).alias("synset_id", "s"))
    first = F.get("s.definition", F.lit(0))
    synsets = nodes.select(
        "synset_id", "s.partOfSpeech", first.alias("definition"), "s.example", "s.ili", F.coalesce("s.members", F.array().cast("array<string>")).alias("members"),
        F.when(first.isNull(), "failed").otherwise("processed").alias("verdict"), F.when(F.coalesce(F.size("s.members"), F.lit(0)) <= 0, "no_members").alias("warning"),
    )
    each = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(f"s.{r}").alias("to")) for r in RELATIONS])
    relations = nodes.select("synset_id", F.explode(each).alias("r")).select(F.col("synset_id").alias("from_id"), "r.relation", F.explode("r.to").alias("to_id"))
    lemmas = files.where(entry).select(F.explode(F.from_json("value", "map<string,map<string,struct<sense:array<struct<id:string,synset:string>>>>>")).alias("lemma", "p"))
    links = lemmas.select("lemma", F.explode("p").alias("pos", "s")).select("lemma", "pos", F.explode("s.sense").alias("x")).select("lemma", "pos", "x.id", "x.synset")
    return synsets, relations, links.withColumn("verdict", F.when(F.col("synset").isNull() | F.col("id").isNull(), "failed").otherwise("processed"))


def target_keys(*profiles: DataFrame) -> DataFrame:
    """Search keys of the headword variants of several profiles, of two characters or more, each once."""
    out = None
    for p in profiles:
        one = p.where("verdict = 'processed'").select(F.explode(F.split("headword", "/")).alias("key"))
        out = one if out is None else out.unionByName(one)
    # Python sees each variant once; a plain filter would be pushed below the keys and have them made again for itself
    kept = F.filter(F.array(search_key(F.col("key"))), lambda k: F.length(k) >= 2)
    return out.distinct().select(F.explode_outer(kept).alias("key")).where("key is not null").distinct()


def examples(run: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(word, example) of the first `most` words of wanted (word, place) that have an example in a dictionary run: a look-up."""
    first = run.where("verdict = 'processed'").select("word", F.get(F.get(F.filter("senses", lambda s: F.size(s["examples"]) > 0), F.lit(0))["examples"], F.lit(0)).alias("example"))
    some = first.where("example is not null").join(wanted, "word").groupBy("word").agg(F.min("place").alias("place"), F.min("example").alias("example"))
    return some.orderBy("place", "word").limit(most).select("word", "example")


def stats(run: DataFrame) -> DataFrame:
    """One row: read, processed, skipped, failed, warnings."""
    n = {k: F.count_if(F.col("verdict") == k) for k in ("processed", "skipped", "failed")}
    return run.agg(F.count(F.lit(1)).alias("read"), *[c.alias(k) for k, c in n.items()], F.count_if(F.col("warning").isNotNull()).alias("warnings"))


def rejects(run: DataFrame) -> DataFrame:
    """A sample of what failed or was skipped, for reports."""
    return run.where("verdict <> 'processed'").limit(SAMPLE)


def profile(run: DataFrame, *columns: str) -> DataFrame:
    """Value counts of columns, most frequent first."""
    out = None
    for c in columns:
        one = run.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("column", F.desc("n"), "value")
