"""The pipeline's stages and the queries of this subpackage, over whole small tables."""

import os

import pytest

import corpus_pipeline
from sensemill.llm import queries as Q
from sensemill.llm.common import shared_dir

from ..conftest import SF, rows_of


def _tables(spark):
    return os.listdir(shared_dir(spark).removeprefix("file:"))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        left = docs.count()
        assert 0.5 * n < left <= n and docs.columns[: len(columns)] == columns, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        n = left
    before = set(_tables(spark))
    assert corpus_pipeline.run(spark, SF).count() == n
    assert [p.split("-")[0] for p in set(_tables(spark)) - before] == ["pipeline"]


def test_stages_against_sql(spark, duck):
    """Each stage on all documents keeps, drops and rewrites what the queries' SQL says of the same table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    def kept(name):
        return sorted(r["doc_id"] for r in stages[name](spark, docs, SF).select("doc_id").collect())

    def sql(name, what):
        return duck.sql(f"SELECT {what} FROM ({Q.ORACLE[name]})").fetchall()

    assert kept("near_dedup") == sorted(i for i, c in sql("op5_near_duplicates", "doc_id, class_id") if i == c)
    leaks = {i for (i,) in sql("op8_decontamination", "doc_id")}
    assert leaks and kept("decontamination") == sorted(set(text) - leaks)
    assert kept("quality") == sorted(r["doc_id"] for r in Q.op1_quality_classifier(spark, SF).where("predicted = 1").collect())
    taken = dict(sql("op7_mixing", "doc_id, taken"))
    assert {r["doc_id"]: r["taken"] for r in stages["mixing"](spark, docs, SF).collect()} == {i: t for i, t in taken.items() if t > 0}
    for i, spans in sql("op6_secret_scan", "doc_id, spans"):
        at, out = 0, []
        for kind, a, b in (x.split(":") for x in spans.split(",") if x):
            if int(a) >= at:
                out += [text[i][at : int(a)], f"<{kind}>"]
            at = max(at, int(b))
        text[i] = "".join([*out, text[i][at:]])
    assert {r["doc_id"]: r["text"] for r in stages["secret_scan"](spark, docs, SF).collect()} == text


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    r = duck.sql(Q.ORACLE[name])
    names = list(r.columns)
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [x.asDict() for x in df.collect()]) == rows_of(names, [dict(zip(names, x)) for x in r.fetchall()])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))
