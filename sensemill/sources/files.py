"""Import and export files: checked rows in, joined multi-values out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.functions.score import LEVELS
from sensemill.functions.text import CANONICAL_POS, blank_to_null, split_multi

HEADERS = [
    "sense_key", "headword", "part_of_speech", "cefr_level", "definition", "priority_level", "frequency_rank", "translations_pl", "examples", "flags",
]
IMPORT_ROWS, EXPORT_ROWS = 10_000, 50_000
_SCHEMA = ", ".join(f"{h} string" for h in HEADERS)


def read_import(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a CSV file or of a JSON array of objects, all values as text. Headers outside the closed set, a
    missing headword column and more than IMPORT_ROWS rows are errors."""
    if kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True)
        df = df.select([F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in df.columns])
    elif kind == "json":
        df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    else:
        raise ValueError(f"unsupported format: {kind}")
    unknown = [c for c in df.columns if c not in HEADERS]
    if unknown or "headword" not in df.columns:
        raise ValueError(f"unknown headers: {unknown}" if unknown else "headword is missing")
    df = df.select(*[(F.col(h) if h in df.columns else F.lit(None)).cast("string").alias(h) for h in HEADERS])
    if df.limit(IMPORT_ROWS + 1).count() > IMPORT_ROWS:
        raise ValueError(f"more than {IMPORT_ROWS} rows")
    return df


#: The longest values of an import row in characters, and the flags it may name.
LONGEST = {"headword": 200, "definition": 10_000, "translations_pl": 4_000, "examples": 10_000, "flags": 500}
FLAGS = ["rare", "archaic", "obsolete", "technical", "specialized", "proper_name", "offensive", "american", "british"]


def errors(df: DataFrame) -> Column:
    """An array of what is wrong with a row, in the order of the rules; empty if nothing is. Parts of speech, levels and flags
    count in any case; blank values are none."""
    level, pos = blank_to_null(F.col("cefr_level")), blank_to_null(F.col("part_of_speech"))
    single = F.array(
        F.when(blank_to_null(F.col("headword")).isNull(), "headword is required"),
        *[F.when(F.length(c) > n, f"{c} is too long") for c, n in LONGEST.items()],
        F.when(pos.isNotNull() & ~F.lower(pos).isin(CANONICAL_POS), "unknown part_of_speech"),
        F.when(level.isNotNull() & ~F.upper(level).isin(LEVELS), "unknown cefr_level"),
        F.when(blank_to_null(F.col("frequency_rank")).isNotNull() & F.col("frequency_rank").try_cast("int").isNull(), "frequency_rank is no number"),
    )
    odd = F.filter(split_multi(F.coalesce("flags", F.lit(""))), lambda f: ~F.lower(f).isin(FLAGS))
    return F.concat(F.array_compact(single), F.transform(odd, lambda f: F.concat(F.lit("unknown flag: "), f)))


def checked(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", errors(df)).withColumn("translations", split_multi(F.coalesce("translations_pl", F.lit(""))))


def flattened(df: DataFrame, *multi: str) -> DataFrame:
    """Arrays joined by " | "."""
    return df.select(*[F.array_join(c, " | ").alias(c) if c in multi else F.col(c) for c in df.columns])


def export(df: DataFrame, path: str, kind: str, *order: str) -> None:
    """The first EXPORT_ROWS rows in order, as one CSV (CRLF) or JSON-lines file set."""
    out = df.orderBy(*order).limit(EXPORT_ROWS)
    if kind == "csv":
        out.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").csv(path, header=True)
    elif kind == "json":
        out.coalesce(1).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unsupported format: {kind}")
