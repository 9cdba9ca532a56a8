"""The positional index against plain token arrays, its refresh, and what its scans read."""

import itertools
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensemill.operators import index as index_module
from sensemill.operators.index import BUCKETS, Index, bucket_of
from sensemill.operators.requests import query_text
from sensemill.operators.search import Request, tokens

VECTORS = {"head": "own", "body": "own", "line": "lines"}
UNITS = [
    ("head", 1, None, "Red apple"), ("body", 1, None, "a red red apple, and the green pear"), ("line", 1, 1, "red pear"), ("line", 1, 2, "pear pear red"), ("head", 2, None, None),
    ("body", 2, None, "apple red"), ("head", 3, None, ""), ("line", 3, 7, "the red apple"), ("body", None, None, "red apple"), ("body", 4, None, "green " * 500 + "apple the"), ("head", 4, None, "the red"),
]
QUERIES = ["red", "red apple", '"red apple"', "apple -red", '"the red" OR pear', '"red red apple" -pear', '"green green"', "pear -green OR \"apple the\"", "nothing", '"apple red" "the green"']


def by_hand(units, query, weights, within):
    q, best = query_text(query), {}
    groups = {}
    for f, k, c, t in units:
        if k is not None:
            groups.setdefault((k, VECTORS[f], c or 0), []).append((f, re.findall(r"[^\W_]+", (t or "").lower())))
    for (k, v, c), fields in groups.items():
        def has(words):
            return any(f in within and any(ts[i : i + len(words)] == words for i in range(len(ts))) for f, ts in fields)
        if any(all(has(w.words) != w.negated for w in g) for g in q.either):
            score = sum(weights[f] * sum(t in q.rank() for t in ts) for f, ts in fields)
            best[k, v] = max(best.get((k, v), 0), score)
    out = {}
    for (k, _), s in best.items():
        out[k] = out.get(k, 0) + s
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    i = Index(spark, f"file://{tmp_path_factory.mktemp('index')}")
    assert i.generation() == 0 and i.state() is None
    assert i.refresh(spark.createDataFrame(UNITS, "field string, key long, child long, text string"), "one") == 10
    return i


@pytest.mark.parametrize("query", QUERIES)
def test_matches(index, query):
    q, weights = query_text(query), {"head": 1.0, "body": 0.4, "line": 0.1}
    for within in (list(VECTORS), ["body"]):
        got = {r["key"]: round(r["score"], 6) for r in index.matches(q.condition, q.terms(), q.rank(), weights, VECTORS, within).collect()}
        assert got == {k: round(s, 6) for k, s in by_hand(UNITS, query, weights, within).items()}


def test_request_and_refusals(index):
    r = Request(all_of=["red"], any_of=["pear", "the"], phrases=["red apple"], none_of=["green"])
    assert [x["key"] for x in index.matches(r.condition, r.terms(), r.words(), {}, VECTORS).collect()] == [3]
    with pytest.raises(ValueError):
        Request(none_of=["red"]).condition(lambda w: F.lit(True))
    with pytest.raises(ValueError):
        query_text("-red OR pear").terms()


def test_only_the_buckets_of_the_words_are_read(spark, index):
    plan = index.postings(["red"])._jdf.queryExecution().executedPlan().toString()
    bucket = spark.sql("select 'red' as t").select(bucket_of(F.col("t"))).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ (= {bucket}|IN \({bucket}\))", plan) and "PushedFilters" in plan
    folders = {re.search(r"bucket=(\d+)", f)[1] for f in index.spark.read.parquet(f"{index.path}/postings").inputFiles()}
    assert 1 < len(folders) <= BUCKETS


def test_refresh_tokenises_what_changed(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    rows = lambda units: spark.createDataFrame(units, "field string, key long, child long, text string")
    find = lambda w: sorted(r["key"] for r in index.matches(lambda has: has([w]), [w], [w], {}, VECTORS).collect())
    units = [("body", i, None, f"word{i} common") for i in range(30)]
    assert index.refresh(rows(units), "a") == 30
    assert index.refresh(rows(units), "a") == 0 and find("common") == list(range(30))
    changed = [*units[:10], ("body", 10, None, "other common"), *units[12:], ("line", 3, 1, "new common")]
    assert index.refresh(rows(changed), "b") == 2 and index.state() == "b"
    assert find("word10") == [] and find("other") == [10] and find("word11") == [] and find("new") == [3] and find("common") == [*range(11), *range(12, 30)]
    assert index.refresh(rows(units), "c") == 2 and find("common") == list(range(30)) and find("other") == [] and find("word10") == [10]
    whole = index.generation()
    # a generation without its manifest is not read, and is written again
    spark.createDataFrame([("body", 99, 0, "ghost", [0])], "field string, key long, child long, term string, positions array<int>").withColumns(
        {"at": F.lit(whole + 1), "bucket": bucket_of(F.col("term"))}
    ).write.partitionBy("at", "bucket").mode("append").parquet(f"{index.path}/postings")
    assert index.generation() == whole and find("ghost") == []
    assert index.refresh(rows([*units, ("body", 50, None, "late")]), "d") == 1 and find("late") == [50]


def test_tokens_are_those_of_the_scan(spark, index):
    texts = ["Über-Größe 12b", "a_b  c", "漢字 kana", ""]
    rows = spark.createDataFrame([("body", i, None, t) for i, t in enumerate(texts)], "field string, key long, child long, text string")
    other = Index(spark, index.path + "-tokens")
    other.refresh(rows)
    want = {(r[0], w) for r in rows.select("key", tokens(F.col("text"))).collect() for w in r[1]}
    assert {(r["key"], r["term"]) for r in other.postings(sorted({w for _, w in want})).collect()} == want
    assert list(itertools.chain(*[r["positions"] for r in other.postings(["12b"]).collect()])) == [2]


def test_postings_of_a_batch(monkeypatch):
    """Any cut of a batch gives the places of each word of each unit, words in order inside a cut; no Python object is made for a word."""
    words = [["b", "a", "b"], None, [], ["ł", "b"], ["a"] * 3]
    columns = [pa.array(["f"] * 5), pa.array([1, 2, 3, 4, 5], pa.int64()), pa.array([0] * 5, pa.int64()), pa.array(words, pa.list_(pa.string()))]
    batch = pa.RecordBatch.from_arrays(columns, ["field", "key", "child", "words"])
    expected = [(k + 1, w, [i for i, x in enumerate(ws) if x == w]) for k, ws in enumerate(words) for w in sorted(set(ws or ()))]
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(index_module, "_WORDS", size)
        out = [r for b in index_module._postings(iter([batch.slice(0, 0), batch, batch.slice(3)])) for r in b.to_pylist()]
        assert sorted((r["key"], r["term"], r["positions"]) for r in out) == sorted(expected + [x for x in expected if x[0] > 3])
    assert [r["term"] for b in index_module._postings(iter([batch])) for r in b.to_pylist()] == ["a", "a", "b", "b", "ł"]
