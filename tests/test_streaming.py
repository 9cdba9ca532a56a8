import pytest

from sensemill.operators.learning import folded
from sensemill.streaming.reviews import rate_limited, review_states


def _run(spark, stream, name, mode, tmp_path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_review_states(spark, tmp_path):
    rows = [(k, 1000.0 + 86_400.0 * i * (k + 1), i, 1 + (i + k) % 4) for k in range(5) for i in range(6)]
    schema = "key long, at double, seq long, grade int"
    spark.createDataFrame(rows[: len(rows) // 2], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[len(rows) // 2 :], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in _run(spark, review_states(stream, "key"), "states", "update", tmp_path):
        if r["reps"] >= got.get(r["key"], {"reps": 0})["reps"]:
            got[r["key"]] = r.asDict()
    for r in folded(spark.createDataFrame(rows, schema), "key").collect():
        assert got[r["key"]]["reps"] == 6 and got[r["key"]]["stability"] == pytest.approx(r["stability"]) and got[r["key"]]["lapses"] == r["lapses"]


def test_rate_limit(spark, tmp_path):
    schema = "key long, at double, seq long"
    spark.createDataFrame([(1, 1e9 + t, t) for t in (0, 1, 2, 3, 60, 61)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r["seq"]: r["allowed"] for r in _run(spark, rate_limited(stream, "key", 60.0, 3), "limits", "append", tmp_path)}
    assert got == {0: True, 1: True, 2: True, 3: False, 60: True, 61: True}


def test_idle_clients_lose_their_state(spark, tmp_path):
    schema = "key long, at double, seq long"
    path = str(tmp_path / "in")
    spark.createDataFrame([(k, 1e9 + k, k) for k in range(20)], schema).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    q = rate_limited(stream, "key", 60.0, 1).writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 20
    for step in (1, 2):
        spark.createDataFrame([(99, 1e9 + 10_000.0 * step, 100 + step)], schema).coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    states = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert states == 1
