"""A build of stages: reruns, changed inputs, half-written stages; fingerprints and what a copy has otherwise."""

import pytest
from pyspark.sql import functions as F

from sensemill.operators.stages import Build, Stage, differences, fingerprint


def _stages(calls, factor=2, version="1"):
    def noted(name, f):
        def run(*tables):
            calls.append(name)
            return f(*tables)

        return run

    return [
        Stage("even", ("numbers",), noted("even", lambda n: n.where("id % 2 = 0"))),
        Stage("times", ("even",), noted("times", lambda e: e.select((F.col("id") * factor).alias("id"))), version),
        Stage("both", ("times", "names"), noted("both", lambda t, n: t.join(n, "id"))),
    ]


def test_a_rerun_does_what_has_changed(spark, tmp_path):
    path, calls = f"file://{tmp_path}/b", []
    names = spark.range(0, 100, 4).withColumn("name", F.lit("n"))
    build = Build(spark, path, _stages(calls))
    out = build.run({"numbers": spark.range(20), "names": names})
    assert sorted(r["id"] for r in out["both"].collect()) == [0, 4, 8, 12, 16, 20, 24, 28, 32, 36] and calls == ["even", "times", "both"]
    before = {k: build.manifest(k) for k in ("even", "times", "both")}
    build.run({"numbers": spark.range(20).repartition(5), "names": names.orderBy(F.desc("id"))})
    assert build.done == [] and calls == ["even", "times", "both"] and before == {k: build.manifest(k) for k in before}
    # another odd number changes the first stage's input, not its output
    build.run({"numbers": spark.range(20).union(spark.range(21, 22)), "names": names})
    assert build.done == ["even"] and build.skipped == ["times", "both"]
    changed = Build(spark, path, _stages(calls, factor=4, version="2"))
    assert changed.run({"numbers": spark.range(20), "names": names})["both"].count() == 10 and changed.done == ["times", "both"]
    assert build.manifest("both")["rows"] == 10


def test_a_half_written_stage_is_not_read(spark, tmp_path):
    path, names = f"file://{tmp_path}/b", spark.range(3).withColumn("name", F.lit("n"))

    def stopped(e):
        raise RuntimeError("stopped")

    first = Build(spark, path, [_stages([])[0], Stage("times", ("even",), stopped)])
    with pytest.raises(RuntimeError):
        first.run({"numbers": spark.range(20), "names": names})
    assert first.manifest("even") and first.manifest("times") is None
    second = Build(spark, path, _stages([]))
    # rows of a run that wrote data and died before the manifest
    second.run({"numbers": spark.range(20), "names": names})
    assert second.skipped == ["even"] and second.done == ["times", "both"]


def test_only_the_newest_versions_stay(spark, tmp_path):
    build = Build(spark, f"file://{tmp_path}/b", _stages([])[:1], keep=2)
    for n in (10, 12, 14, 16):
        build.run({"numbers": spark.range(n)})
    assert len(list((tmp_path / "b" / "data" / "even").iterdir())) == 2 and build.manifest("even")["rows"] == 8


def test_fingerprints(spark):
    rows = [(1, None), (None, 1), (2, 2), (2, 2)]
    f = lambda r: fingerprint(spark.createDataFrame(r, "a int, b int"))
    assert f(rows) == f(rows[::-1]) and f(rows)[0] == 4
    assert len({f(rows)[1], f(rows[:3])[1], f([(None, 1), (None, 1), (2, 2), (2, 2)])[1], f([(1, None), (None, 1), (2, 2), (2, 3)])[1], f([])[1], f([(3, 3), (3, 3)])[1], f([(4, 4), (4, 4)])[1]}) == 7


def test_differences(spark):
    old = [(i, f"v{i}") for i in range(200)] + [(None, "null"), (300, "a"), (300, "b")]
    new = [(i, f"v{i}") for i in range(200) if i != 5] + [(None, "other"), (300, "a"), (300, "b"), (6, "v6"), (7, "more"), (400, "new")]
    new[10] = (new[10][0], "changed")
    df = lambda r: spark.createDataFrame(r, "k int, v string")
    got = {(r["k"], r["kind"]) for r in differences(df(old), df(new), "k").collect()}
    assert got == {(5, "lost"), (None, "changed"), (6, "doubled"), (7, "changed"), (400, "added"), (new[10][0], "changed")}
    assert differences(df(old), df(old[::-1]), "k").count() == 0 and differences(df(old), df([]), "k").count() == 202
