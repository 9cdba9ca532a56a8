"""The corpus pipeline: STAGES in order, each on all rows that the one before it kept.

Every stage reads the documents (doc_id, text, lang, source, n_chars and what else is there) that
its predecessor wrote, so a lost executor costs the running stage at most. The last stage adds
size, source_size, target and taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.llm.common import drop, scratch, table, written
from sensemill.llm.decontaminate import without_leaks
from sensemill.llm.mixing import mix
from sensemill.llm.near_dup import keep_one
from sensemill.llm.quality import good_only
from sensemill.llm.secrets import without_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_only(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text gives way to a mark of its kind; no document goes."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with the words it takes of each."""
    return mix(docs, keep=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: A trained classifier and near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. A stage's own tables go once it is written, and its input with the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        keep: list[str] = []
        with scratch(spark, keep):
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(path)
        if before is not None:
            drop(spark, before)
        before = path
    return docs
