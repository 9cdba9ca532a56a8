"""Pairs that mean the same, against every pair compared; meanings are compared between token sets, not between members."""

import itertools

from pyspark.sql import functions as F

from sensemill.functions.text import same_meaning
from sensemill.operators.identity import clusters, meaning_pairs


def test_pairs_of_a_block(spark):
    sets = [["aa", "bb"], ["aa", "bb", "cc"], ["dd"], ["dd", "ee"], [], None, ["aa", "cc", "dd"]]
    rows = [(i if i != 40 else None, [None, "x", "y"][i % 3], sets[i * 5 % 7]) for i in range(84)]
    senses = spark.createDataFrame(rows, "k long, block string, tokens array<string>")
    out = meaning_pairs(senses, "k", "block")
    both = spark.createDataFrame([(a, b) for a, b in itertools.product([s for s in sets if s], repeat=2)], "a array<string>, b array<string>").where(same_meaning(F.col("a"), F.col("b"))).collect()
    same = {(tuple(r["a"]), tuple(r["b"])) for r in both}
    hand = [(i, j) for (i, p, s), (j, q, t) in itertools.product(rows, rows) if None not in (i, j, p, s, t) and p == q and i < j and (tuple(s), tuple(t)) in same]
    assert sorted(tuple(r) for r in out.collect()) == sorted(hand) and len(hand) > 50
    joined = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert all("array_intersect" not in x for x in joined if "idb" in x.split("ida")[-1] and "Join" in x)


def test_tokens_of_candidates_are_made_once(spark):
    rows = spark.createDataFrame([("w", "n", 1, 1, "aa bb"), ("w", "n", 2, 2, "aa bb"), ("w", "n", 3, 3, "cc")], "headword string, pos string, candidate_id long, ordering long, text string")
    out = clusters(rows.withColumn("tokens", F.split("text", " ")))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
