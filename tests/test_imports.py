"""Import rows: what each is, and what a commit appends."""

from sensemill.operators import imports as I
from sensemill.sources import files

ROW = "line int, sense_key string, derived_key string, headword string, pos string, cefr string, definition string"


def test_commit(spark):
    senses = spark.createDataFrame([("a", "noun", "B1", "x"), ("b", None, None, None)], "sense_key string, pos string, cefr string, definition string")
    rows = [
        (1, "a", "z", "h", "NOUN", "b1", "x"), (2, "a", "z", "h", "verb", "B1", "x"), (3, "gone", "z", "h", "", "", ""), (4, " ", "b", "h", "", None, ""),
        (5, None, "n", "h", "Noun", "", "first"), (6, "", "n", "h", "noun", None, "first"), (7, "", "n", "h", "noun", "", "other"), (8, "n", "q", "h", "noun", "", "first"),
        (9, "m", "q", "h", "", "", ""), (10, None, "m", "h", "", "", ""), (11, None, None, "h", "", "", ""),
    ]
    marked = I.classified(spark.createDataFrame(rows, ROW), senses)
    got = {r["line"]: (r["status"], r["sense_key"]) for r in marked.collect()}
    assert got == {
        1: ("existing_match", "a"), 2: ("conflict", "a"), 3: ("error", None), 4: ("existing_match", "b"), 5: ("new", "n"), 6: ("existing_match", "n"),
        7: ("conflict", "n"), 8: ("existing_match", "n"), 9: ("error", None), 10: ("new", "m"), 11: ("error", None),
    }
    assert sorted(tuple(r) for r in I.inserted(marked).collect()) == [("m", "h", None, None, None), ("n", "h", "noun", None, "first")]
    values = [(1, 0, "Old", "old"), (1, 1, "New", "new"), (1, 2, "NEW", "new"), (2, 0, "skipped", "skipped"), (5, 0, "", ""), (5, 1, "p", "p"), (6, 0, "q", "q"), (6, 1, "P", "p"), (6, 2, None, None)]
    held = spark.createDataFrame([("a", "old", 3), ("a", "x", 0), ("b", "new", 1)], "sense_key string, norm string, position long")
    added = I.children(marked, spark.createDataFrame(values, "line int, place int, value string, norm string"), held)
    assert sorted(tuple(r) for r in added.collect()) == [("a", "New", "new", 4), ("n", "p", "p", 0), ("n", "q", "q", 1)]
    assert tuple(I.report(marked, added).first()) == (2, 4, 5, 3)
    assert tuple(I.report(marked.limit(0), added.limit(0)).first()) == (0, 0, 0, 0)


def test_row_rules(spark):
    blank = dict.fromkeys(files.HEADERS)
    rows = [
        {**blank, "headword": "bank", "part_of_speech": "Noun", "cefr_level": "b1", "flags": "Rare | british"},
        {**blank, "headword": "x" * 201, "definition": "d" * 10_001, "part_of_speech": "pronoun", "flags": "rare|odd|other"},
        {**blank, "headword": " ", "translations_pl": "t" * 4_001, "examples": "e" * 10_001, "flags": "f" * 501, "cefr_level": "C3", "frequency_rank": "many"},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{h} string" for h in files.HEADERS))
    got = [r["errors"] for r in files.checked(df).collect()]
    assert got[0] == []
    assert got[1] == ["headword is too long", "definition is too long", "unknown part_of_speech", "unknown flag: odd", "unknown flag: other"]
    assert got[2][:-1] == ["headword is required", "translations_pl is too long", "examples is too long", "flags is too long", "unknown cefr_level", "frequency_rank is no number"]
