import gzip
import json

import pytest
from pyspark.sql import functions as F

from sensemill.sources import adapters as A
from sensemill.sources import files


def test_profiles(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿headword,pos,CEFR,CoreInventory 1\n run ,verb,a1,\nRun,Verb,A2,\na/b,noun,B1,\nbad,noun,ZZ,\n,noun,A1,\n", "utf-8")
    run = A.cefr_profile(spark, str(p))
    assert A.stats(run).first().asDict() == {"read": 5, "processed": 3, "skipped": 0, "failed": 2, "warnings": 2}
    assert {r["record_id"] for r in run.collect()} == {f"cefrj:row:{i}" for i in range(2, 7)}
    assert sorted(r[0] for r in A.target_keys(run).collect()) == ["run"]
    assert A.rejects(run).count() == 2
    p.write_text("headword,pos,CEFR\ncloak,,C1\nx,noun,B9\n")
    assert [r["warning"] for r in A.advanced_profile(spark, str(p)).where("verdict = 'processed'").collect()] == ["missing_pos"]


def test_rows_are_numbered_in_each_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("headword,pos,CEFR\n" + "".join(f"{name}{i},noun,A1\n" for i in range(3)))
    got = sorted((r["headword"], r["record_id"]) for r in A.cefr_profile(spark, str(tmp_path)).collect())
    assert got == [(f"{n}{i}", f"cefrj:row:{i + 2}") for n in "ab" for i in range(3)]


def test_frequency_list(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("Lemma,SFI Rank,SFI,Adjusted Frequency per Million (U)\nthe,1,88.1,60000\nThe, 2 ,80,5\nx,notanumber,1,1\nof,3,70,4\n")
    assert A.stats(A.frequency_list(spark, str(p))).first().asDict() == {"read": 4, "processed": 3, "skipped": 0, "failed": 1, "warnings": 1}


def test_dictionary_dump(spark, tmp_path):
    good = {"word": "bank", "lang": "English", "pos": "noun", "senses": [{"glosses": ["", "edge"], "tags": [" rare "], "examples": [{"text": "e"}] * 5}], "translations": [{"code": "pl", "word": " brzeg "}, {"code": "de", "word": "x"}]}
    lines = [json.dumps(good), json.dumps({"word": "x", "lang": "Polish"}), json.dumps({"word": "y", "lang": "English", "senses": []}), "{broken"]
    p = tmp_path / "d.jsonl.gz"
    p.write_bytes(gzip.compress("\n".join(lines).encode()))
    run = A.dictionary_dump(spark, str(p)).cache()
    assert A.stats(run).first().asDict() == {"read": 4, "processed": 1, "skipped": 2, "failed": 1, "warnings": 1}
    r = run.where("verdict = 'processed'").first()
    assert r["senses"][0]["gloss"] == "edge" and len(r["senses"][0]["examples"]) == 3 and r["polish"] == ["brzeg"]
    mixed = {**good, "word": "café", "senses": [{"glosses": ["g"], "examples": ["plain", {"text": "object"}, {"ref": "no text"}, "fourth"]}]}
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(x) for x in (mixed, {**good, "word": "Bánk"}, {**good, "word": "other"})))
    keys = spark.createDataFrame([("cafe",), ("bank",)], "key string")
    got = {r["word"]: r for r in A.dictionary_dump(spark, str(tmp_path / "m.jsonl"), keys).collect()}
    assert {w: r["verdict"] for w, r in got.items()} == {"café": "processed", "Bánk": "processed", "other": "skipped"}
    assert got["café"]["senses"][0]["examples"] == ["plain", "object", '{"ref": "no text"}'.replace(" ", "")] or got["café"]["senses"][0]["examples"][:2] == ["plain", "object"]
    wanted = spark.createDataFrame([("other",)], "key string")
    assert A.dictionary_dump(spark, str(p), wanted).where("reason = 'not_wanted'").count() == 2


def test_synsets(spark, tmp_path):
    (tmp_path / "noun.json").write_text(json.dumps({"s1": {"definition": ["a dog"], "hypernym": ["s2"], "members": ["dog"], "partOfSpeech": "n"}, "s2": {"definition": "an animal", "members": [], "partOfSpeech": "n"}}))
    (tmp_path / "entries-d.json").write_text(json.dumps({"dog": {"n": {"sense": [{"id": "d1", "synset": "s1"}, {"id": "d2"}]}}}))
    (tmp_path / "frames.json").write_text(json.dumps({"x": "y"}))
    synsets, relations, links = A.synset_folder(spark, str(tmp_path))
    assert {r["synset_id"]: r["definition"] for r in synsets.collect()} == {"s1": "a dog", "s2": "an animal"}
    assert [tuple(r) for r in relations.collect()] == [("s1", "hypernym", "s2")]
    assert sorted(r["verdict"] for r in links.collect()) == ["failed", "processed"]
    assert synsets.where("warning = 'no_members'").count() == 1


def test_import_export(spark, tmp_path):
    p = tmp_path / "i.csv"
    p.write_text("headword,cefr_level,frequency_rank,translations_pl\nbank,b1,5,brzeg | bank\n,Z9,x,\n")
    rows = files.checked(files.read_import(spark, str(p), "csv")).orderBy(F.col("headword").asc_nulls_last()).collect()
    assert rows[0]["errors"] == [] and rows[0]["translations"] == ["brzeg", "bank"] and len(rows[1]["errors"]) == 3
    p.write_text("word\nx\n")
    with pytest.raises(ValueError):
        files.read_import(spark, str(p), "csv")
    df = spark.createDataFrame([("a", ["x", "y"])], "headword string, translations_pl array<string>")
    files.export(files.flattened(df, "translations_pl"), str(tmp_path / "out"), "csv", "headword")
    assert next((tmp_path / "out").glob("*.csv")).read_bytes() == b"headword,translations_pl\r\na,x | y\r\n"
