"""Profilers' bounds and the samples of an audit."""

import json

from pyspark.sql import functions as F

from sensemill.operators import audit
from sensemill.sources import profilers


def test_dump_profile_bounds(spark, tmp_path, monkeypatch):
    word = lambda i, **more: json.dumps({"word": f"w{i}", "lang": "English", "pos": "noun", "senses": [{"glosses": [f"g{i} (płsk. x)"], "tags": [f"t{i}"]}]} | more)
    lines = [word(0), "{no", json.dumps({"word": "x", "lang": "Polish"}), word(1, translations=[{"code": "pl", "word": "a"}, {"lang": "Polish"}]), word(2, extra=1), json.dumps({"word": "y"})]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    monkeypatch.setitem(profilers.SHOWN, "tag", 1)
    got = {(r["section"], r["item"]): (r["n"], r["share"]) for r in profilers.dump_profile(spark, str(tmp_path / "d.jsonl"), sample=2).collect()}
    assert got["total", "records"][0] == 6 and got["total", "malformed"][0] == 1 and got["total", "english"][0] == 3 and got["language", "?"][0] == 1
    assert got["pos", "noun"][0] == 3 and got["sense", "entries"][0] == 2 and got["sense", "glossed"] == (2, 1.0)  # fields: the first two only
    assert ("field", "extra") not in got and got["field", "translations"] == (1, 0.5) and got["polish", "entries"] == (1, 0.5) and got["polish", "translations"][0] == 2 and got["polish", "hinted"][0] == 2
    assert got["code", "pl"][0] == got["code", "?"][0] == 1 and [k for k in got if k[0] == "tag"] == [("tag", "t0")]
    (tmp_path / "none.jsonl").write_text("")
    assert spark.createDataFrame([], "a int").count() == 0 and profilers.dump_profile(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_dump_profile_is_whole(spark, tmp_path):
    with open(tmp_path / "d.jsonl", "w") as f:
        f.writelines('{"word": "w", "lang": "English", "pos": "noun", "senses": [{"glosses": ["g"], "tags": ["t"]}]}\n' for _ in range(50_003))
    got = {(r["section"], r["item"]): (r["n"], r["share"]) for r in profilers.dump_profile(spark, str(tmp_path / "d.jsonl")).collect()}
    assert got["total", "english"][0] == got["tag", "t"][0] == 50_003 and got["field", "word"] == got["sense", "entries"] == got["sense", "glossed"] == (50_003, 1.0)


def test_samples_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("level"), (F.col("id") / 1000).alias("score"))
    one = audit.samples(rows, "key", "level", 4, 7)
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in audit.samples(rows.repartition(9), "key", "level", 4, 7).collect()) and one.count() == 12
    assert {r["key"] for r in audit.samples(rows, "key", "level", 4, 8).collect()} != {r["key"] for r in one.collect()}
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["key"] for r in audit.boundary(rows, "key", "level", 2, lowest=False).collect()) == [994, 995, 996, 997, 998, 999]
