import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.functions import text as X
from sensemill.operators.learning import review


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in zip(values, _kinds(values))))
    return df.select(column.alias("x")).first()["x"]


def _kinds(values):
    names = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    return [names[type(v)] for v in values.values()]


@pytest.mark.parametrize(("text", "key"), [("Łódź  Straße!", "lodz strasse"), ("snake_case, ok", "snake_case ok"), ("Éa--b", "ea b"), ("", "")])
def test_search_key(spark, text, key):
    assert one(spark, X.search_key(F.col("a")), a=text) == key


def test_search_key_follows_python(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet="aŁßÉ_ !ñç\tZ9æ", max_size=12), min_size=200, max_size=200))
    def run(texts):
        import re

        def key(t):
            t = unicodedata.normalize("NFC", t).casefold()
            return " ".join(re.sub(r"[^\w\s]", " ", X._fold(t)).split())

        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "a string").select(X.search_key(F.col("a"))).collect()]
        assert got == [key(t) for t in texts]

    run()


@pytest.mark.parametrize(
    ("gloss", "clean"), [("(noun) (old) a  thing; 12.", "a thing"), ("a thing", "a thing"), ("(unclosed thing", "(unclosed thing"), ("edge, 3.", "edge")]
)
def test_clean_gloss(spark, gloss, clean):
    assert one(spark, X.clean_gloss(F.col("a")), a=gloss) == clean


def test_tokens_and_meaning(spark):
    assert one(spark, X.significant_tokens(F.col("a")), a="a big kid with the movie") == ["big", "child", "film"]
    assert one(spark, X.gloss_depth(F.col("a")), a="a lady s maid") == 2
    same = X.same_meaning(F.col("a"), F.col("b"))
    assert one(spark, same, a=["x", "y"], b=["x", "y", "z"]) is True
    assert one(spark, same, a=["x"], b=["x", "y"]) is False
    assert one(spark, same, a=[], b=[]) is False
    assert one(spark, X.stem(F.col("a")), a="countries") == one(spark, X.stem(F.col("a")), a="country")


def test_small_functions(spark):
    assert one(spark, X.canonical_pos(F.col("a")), a=" Adj ") == "adjective"
    assert one(spark, X.canonical_pos(F.col("a")), a=None) == "other"
    assert one(spark, X.american_spelling(F.col("a")), a="Colour centre colours") == "Color center colours"
    assert one(spark, X.inline_polish(F.col("a")), a="bank (pl: brzeg ) (Polish: ława)") == ["brzeg", "ława"]
    assert one(spark, X.split_multi(F.col("a")), a=" a | |b") == ["a", "b"]
    assert one(spark, X.relation_group(F.col("a")), a="instance_hypernym") == "hypernym"
    assert one(spark, X.embed_text(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="w", b="", c=" g ", d=["x", " ", "y"]) == "w | g | x"
    assert one(spark, X.clipboard_line(F.col("a"), F.col("b"), F.col("c")), a="w", b=[], c=None) == "w — — — —"


@pytest.mark.parametrize(("rank", "value"), [(1, 1.0), (10, 0.8511), (100, 0.7244), (60_000, 0.30)])
def test_frequency(spark, rank, value):
    assert one(spark, S.frequency_component(F.col("a")), a=rank) == value


def test_priority(spark):
    neutral = S.priority_score(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(1.0))
    assert one(spark, neutral, a=1) == 0.35
    assert one(spark, S.priority_level(F.lit(0.35)), a=1) == "LOW"
    for tags, value in ((["rare"], 0.5), (["slang"], 0.75), (["rare", "slang"], 0.375), (["rare", "slang", "vulgar"], 0.28125), (["slang", "vulgar", "internet"], 0.421875)):
        assert one(spark, S.penalty(F.col("a")), a=tags) == value


def test_ranking(spark):
    r = S.hybrid_score(F.lit(3), F.lit(7), F.lit(None).cast("int"), F.lit(False), F.lit(0.0))
    assert abs(one(spark, r, a=1) - (0.5 / 63 + 0.25 / 67)) < 1e-12
    assert abs(one(spark, S.rrf(F.lit(1)), a=1) - 1 / 61) < 1e-12
    assert one(spark, S.ordinal(F.col("a"), ["x", "y"]), a="z") is None


def test_scheduler():
    s, d, days = review(None, None, 0, 3)
    assert days == 2
    before = 0
    for wait in (3, 14, 40):
        s, d, days = review(s, d, wait, 3)
        assert days > before
        before = days
    assert review(s, d, 57, 1)[2] < before / 5
