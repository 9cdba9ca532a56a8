import pytest
from pyspark.sql import functions as F

from sensemill.operators.composer import Filters, Tables, normalised
from sensemill.operators.learning import patched
from sensemill.operators.merge import with_current, without_implied_tops


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return Tables(
        make([(1, "bank", "noun", "A1", "HIGH", True), (2, "banking", "noun", None, None, True), (3, "run", "verb", "B1", "LOW", True), (4, "old", "adjective", "A1", "HIGH", False)], "sense_id int, headword string, pos string, cefr string, priority_level string, is_active boolean"),
        categories=make([(1, "money"), (3, "sport")], "sense_id int, key string"),
        category_tree=make([("life", None), ("money", "life"), ("sport", "life")], "key string, parent string"),
        frequency=make([(1, 500), (2, 1500), (3, 9000)], "sense_id int, rank int"),
        flags=make([(2, "rare")], "sense_id int, flag string"),
        forms=make([(3, "running")], "sense_id int, form string"),
        translations=make([(1, 0.9), (1, 0.3), (2, 0.2)], "sense_id int, confidence double"),
        assignments=make([(1, 7, True, "REVIEWING", "2024-01-01", 0), (2, 7, False, "NEW", None, 2), (3, 8, True, "NEW", "2024-05-01", 0)], "sense_id int, student_id int, is_active boolean, state string, due_at string, lapses int"),
        overrides=make([(2, 7)], "sense_id int, student_id int"),
    )


@pytest.mark.parametrize(
    ("wanted", "ids"),
    [
        ({}, {1, 2, 3}), ({"cefr": ["A1", "B1"]}, {1, 3}), ({"priority_at_least": "HIGH+"}, {1}), ({"category": "life"}, {1, 3}), ({"category": "none"}, set()),
        ({"bands": ["top1000", "top2000"]}, {1, 2}), ({"bands": ["odd"]}, set()), ({"max_rank": 1000}, {1}), ({"flags": ["rare"]}, {2}), ({"availability": "missing"}, {3}),
        ({"availability": "multiple"}, {1}), ({"availability": "uncertain"}, {2}), ({"prefix": "bank"}, {1, 2}), ({"prefix": "runn"}, {3}), ({"student": 7, "assigned": True}, {1}),
        ({"student": 7, "assigned": False}, {3}), ({"student": 7, "due": True}, {1}), ({"student": 7, "difficult": True}, {2}), ({"student": 7, "overridden": True}, {2}),
        ({"student": 7, "states": ["NEW"], "pos": ["noun"]}, {2}),
    ],
)
def test_filters(tables, wanted, ids):
    assert {r["sense_id"] for r in Filters(**wanted).apply(tables, F.lit("2024-02-01")).collect()} == ids


def test_requests():
    assert normalised("x", "x", "", 0, -1) == ("lexical", "priority", 1, 0)
    assert normalised("semantic", "relevance", "bank", 500, 3) == ("semantic", "relevance", 200, 3)
    assert normalised("hybrid", "student_status", "bank", 50, 0)[1] == "priority"
    with pytest.raises(ValueError):
        Filters(due=True).apply(None)


def test_writes(spark):
    a = spark.createDataFrame([(1, "NEW", None), (2, "REVIEWING", "HIGH")], "id int, state string, priority_override string")
    p = spark.createDataFrame([(1, None, "LOW", False), (2, None, None, True)], "id int, state string, priority_override string, reset boolean")
    assert sorted(map(tuple, patched(a, p, "id").collect())) == [(1, "NEW", "LOW"), (2, "ASSIGNED", "HIGH")]
    links = spark.createDataFrame([(1, "law", ""), (1, "law", "license"), (2, "law", "")], "sense_id int, top string, sub string")
    assert sorted(map(tuple, without_implied_tops(links).collect())) == [(1, "law", "license"), (2, "law", "")]
    history = spark.createDataFrame([(1, "v1", 0.1), (1, "v2", 0.2)], "id int, version string, score double")
    assert sorted(map(tuple, with_current(a.withColumn("score", F.lit(0.0)), history, "id", "v2", "score").select("id", "score").collect())) == [(1, 0.2), (2, None)]
