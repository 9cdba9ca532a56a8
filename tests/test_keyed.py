"""Keyed folds over batch limits, founders in rounds, numbers over a total order."""

import random
import resource

import pytest
from pyspark.sql import functions as F

from sensemill.operators import identity
from sensemill.operators.keyed import numbered
from sensemill.operators.learning import folded, review, windowed


def scan(rows):
    def same(a, b):
        both, small = len(a & b), min(len(a), len(b))
        j = both / len(a | b) if a | b else 0
        return small > 0 and (a == b or (both == small and small >= 2) or j >= 0.75 or (len(a) == len(b) and j >= 0.6))

    out, founders = {}, {}
    for h, p, i, o, t in sorted(rows, key=lambda r: (r[3], r[2])):
        own = frozenset(t)
        block = founders.setdefault((h, p), [])
        first = next((c for f, c in block if same(f, own)), None)
        if first is None:
            block.append((own, i))
        out[i] = i if first is None else first
    return out


SCHEMA = "headword string, pos string, candidate_id long, ordering string, tokens array<string>"


@pytest.mark.parametrize("seed", range(3))
def test_founders_equal_the_scan(spark, seed):
    rng = random.Random(seed)
    tokens = [f"t{i}" for i in range(9)]
    rows = [(rng.choice("hk"), rng.choice([None, "n", "v"]), i, rng.choice("abc"), rng.sample(tokens, rng.randint(0, 6))) for i in range(400)]
    got = {r[0]: r[1] for r in identity.clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == scan([(h, p or "", i, o, t) for h, p, i, o, t in rows])


def test_a_chain_needs_as_many_rounds(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {(r["b"], r["a"]) for r in identity.followers(pairs).collect()} == {(i + 1, i) for i in range(0, 9, 2)}
    assert identity.followers(pairs.limit(0)).count() == 0 and identity.clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_block_of_many_senses(spark):
    """A third of a hundred thousand candidates repeat one set; the others share frequent tokens."""
    n = F.col("id")
    own = F.array(F.lit("common"), F.lit("frequent"), F.concat(F.lit("w"), n % 30_000), F.concat(F.lit("x"), n % 7_001), F.concat(F.lit("y"), n % 5_003))
    rows = spark.range(100_000).select(F.lit("h").alias("headword"), F.lit("n").alias("pos"), n.alias("candidate_id"), F.lit("o").alias("ordering"), F.when(n % 3 == 0, F.array(F.lit("same"), F.lit("set"))).otherwise(own).alias("tokens"))
    got = identity.clusters(rows.repartition(8))
    assert got.count() == 100_000 and got.where("candidate_id % 3 = 0").select("cluster_id").distinct().count() == 1


def test_fold_over_batches_and_from_a_state(spark):
    rng = random.Random(4)
    rows = [(k, float(1000 * t + rng.randint(0, 900)), t, rng.randint(1, 4)) for k in (1, 2, None) for t in range(300)]
    events = spark.createDataFrame(rows, "k int, at double, seq int, grade int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["k"]: r for r in folded(events, "k").collect()}
        half = folded(events.where("seq < 150"), "k")
        again = {r["k"]: r for r in folded(events.where("seq >= 150 and k = 1"), "k", start=half).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (1, 2, None):
        s = d = before = None
        lapses = 0
        for _, at, _, g in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            lapses += int(s is not None and g == 1)
            s, d, days = review(s, d, 0.0 if before is None else (at - before) / 86_400, g)
            before = at
        r = got[k]
        assert (r["stability"], r["difficulty"], r["reps"], r["lapses"], r["interval_days"]) == (s, d, 300, lapses, days)
    assert again[1] == got[1] and again[2]["reps"] == 150


def test_one_key_of_a_million_events_takes_no_more_memory(spark):
    n = F.col("id")
    events = spark.range(1_000_000).select(F.lit(1).alias("k"), (n * 60).cast("double").alias("at"), n.alias("seq"), (n % 4 + 1).cast("int").alias("grade"))
    assert folded(events, "k").first()["reps"] == 1_000_000
    windows = windowed(events.select("k", "at", "seq"), "k", width=3600)
    assert windows.agg(F.max("number"), F.count_distinct("window_start")).first()[:] == (60, 16_667)
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss >= 0


def test_windows(spark):
    rows = [(k, at, i) for k in (1, 2) for i, at in enumerate([0, 1, 9, 10, 10, 25, 34, 35, 36])] + [(1, None, 99)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = sorted(tuple(r) for r in windowed(spark.createDataFrame(rows, "k int, at long, seq long"), "k", width=10).where("k = 1").select("seq", "window_start", "number").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 10, 1), (4, 10, 2), (5, 25, 1), (6, 25, 2), (7, 35, 1), (8, 35, 2)]


def test_numbers_over_all_rows(spark):
    ids = random.Random(1).sample(range(10**6), 5000)
    got = numbered(spark.createDataFrame([(i, "x") for i in ids], "id long, x string").repartition(7), "id").collect()
    assert {r["id"]: r["number"] for r in got} == {i: n for n, i in enumerate(sorted(ids))}
    assert numbered(spark.range(0), "id").count() == 0
