import random

import pytest
from pyspark.sql import functions as F

from sensemill.operators import graph, identity, merge
from sensemill.operators.filters import Evidence, at_least, page, subtree
from sensemill.operators.learning import folded, review
from sensemill.operators.search import Request, matched


def test_filters(spark):
    df = spark.createDataFrame([("HIGH",), (None,), ("LOW",), ("odd",)], "p string")
    assert df.where(at_least(F.col("p"), "HIGH+", ["VERY HIGH", "HIGH", "LOW"])).count() == 1
    with pytest.raises(ValueError):
        at_least(F.col("p"), "X", ["HIGH"])
    with pytest.raises(ValueError):
        Evidence("k", df).select(df, "none")
    assert page(df, F.col("p"), limit=0).count() == 1
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None)], "key string, parent string")
    assert {r[0] for r in subtree(tree, "a").collect()} == {"a", "b", "c"}
    assert subtree(tree, "none").count() == 0


def test_search_falls_back(spark):
    df = spark.createDataFrame([(1, "Red bolt"), (2, "blue, gear")], "id int, text string")
    assert matched(df, Request(all_of=["red", "gear"])).count() == 2
    assert matched(df, Request(phrases=["blue gear"])).count() == 1


def test_identity_is_greedy(spark):
    rows = [("w", "n", 1, "a", ["x", "y", "z"]), ("w", "n", 2, "b", ["x", "y"]), ("w", "n", 3, "c", ["q"]), ("w", "v", 4, "a", ["x", "y"]), ("w", "n", 5, "d", [])]
    got = {r[0]: r[1] for r in identity.clusters(spark.createDataFrame(rows, "headword string, pos string, candidate_id long, ordering string, tokens array<string>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def _scan(word, inline, words):
    """The four passes one after another, word by word."""
    out, used = [], {k for ws in inline for _, k in ws}
    out += [(s, t, 0.95, "inline") for s, ws in enumerate(inline) for t, _ in ws]
    own = [t for t, k in words if k == word]
    if own:
        out += [(s, own[0], 0.5, "cognate") for s in range(len(inline))]
        used.add(word)
    sets, rest = [{x for _, k in ws for x in k.split(" ") if len(x) > 2} for ws in inline], []
    for t, k in words:
        if k in used:
            continue
        shared = [len({x for x in k.split(" ") if len(x) > 2} & s) for s in sets]
        if k and max(shared, default=0):
            out.append((shared.index(max(shared)), t, 0.7, "token"))
            used.add(k)
        else:
            rest.append(t)
    out += [(i % len(inline), t, 0.35, "position") for i, t in enumerate(rest) if i < 3 * len(inline)]
    return sorted(out, key=lambda x: (x[0], -x[2], x[1]))


def test_alignment(spark):
    rng = random.Random(5)
    names = ["bank", "edge land", "river edge", "river", "u", "v", "wide edge", "", "land", "x y"]

    def some(n):
        return [(w.upper(), w) for w in rng.choices(names, k=rng.randrange(n))]

    rows = [(i, rng.choice(names), [some(3) for _ in range(rng.randrange(5))], some(14)) for i in range(400)] + [(400, "u", [], [("U", "u")]), (401, "u", [[], []], [])]
    kind = "id int, word_key string, inline array<array<struct<text:string,key:string>>>, words array<struct<text:string,key:string>>"
    got = {r["id"]: [tuple(x) for x in r["aligned"]] for r in identity.align_translations(spark.createDataFrame(rows, kind)).collect()}
    for i, word, inline, words in rows:
        assert got[i] == (_scan(word, inline, words) if inline else []), i
    odd = spark.createDataFrame([(1, None, [[("a", None), None], None], [None, ("u", "u")], "x"), (2, "u", None, None, None)], kind + ", aligned_by string")
    got = {r["id"]: [tuple(x) for x in r["aligned"]] for r in identity.align_translations(odd).collect()}
    assert got == {1: [(0, "u", 0.35, "position")], 2: []} and identity.align_translations(odd).columns[-2:] == ["aligned_by", "aligned"]


def test_graph(spark):
    edges = spark.createDataFrame([("dog", "canine"), ("canine", "animal"), ("animal", "dog")], "from_id string, to_id string")
    up = graph.closure(spark.createDataFrame([("dog",)], "start string"), edges)
    assert {r["node"] for r in up.collect()} == {"dog", "canine", "animal"}
    senses = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "sense_id int, tokens array<string>")
    ev = spark.createDataFrame([(1, "s", ["a", "b"]), (1, "t", ["q"]), (2, "u", ["z"]), (2, "v", ["y"])], "sense_id int, synset_id string, tokens array<string>")
    got = {r["sense_id"]: (r["synset_id"], r["method"]) for r in graph.link(senses, ev).collect()}
    assert got == {1: ("s", "definition-match"), 2: (None, "ambiguous")}


def test_link_senses(spark):
    """Each way to link a sense, and each reason why one stays unlinked."""
    senses = spark.createDataFrame(
        [
            (1, "cat", "noun", ["feline", "small"]), (2, "dog", "noun", ["loyal"]), (3, "owl", "noun", ["bird"]), (4, "run", "verb", ["moving", "fast", "legs"]),
            (5, "bank", "noun", ["money", "house", "river"]), (6, "fast", "adjective", ["quick", "speedy"]), (7, "none", "noun", ["x"]), (8, "cat", "verb", ["feline"]),
            (9, "weak", "noun", None), (10, None, "noun", ["a"]),
        ],
        "sense_id int, lemma string, pos string, tokens array<string>",
    )
    evidence = spark.createDataFrame(
        [("cat", "n", "c1"), ("cat", "n", "c1"), ("dog", "n", "d1"), ("owl", "n", "lost"), ("run", "v", "r1"), ("run", "v", "r2"), ("run", "n", "r3"), ("bank", "n", "b1"), ("bank", "n", "b2"),
         ("fast", "a", "f1"), ("fast", "s", "f2"), ("weak", "n", "b1"), ("weak", "n", "b2")],
        "lemma string, letter string, synset_id string",
    )
    synsets = spark.createDataFrame(
        [
            ("c1", ["feline", "small"], []), ("d1", ["wolf"], None), ("r1", ["move", "quickly", "ground", "air"], ["leg", "run"]), ("r2", ["operate", "machine"], ["run"]),
            ("b1", ["money", "house", "vault", "loan", "till"], ["bank"]), ("b2", ["money", "river", "shore", "water", "side"], ["bank"]), ("f1", ["quick", "speedy"], []), ("f2", ["quick", "speedy"], []),
            ("r3", ["moving", "fast", "legs"], []),
        ],
        "synset_id string, tokens array<string>, members array<string>",
    )
    got = {r["sense_id"]: (r["synset_id"], r["confidence"], r["method"]) for r in graph.link_senses(senses, evidence, synsets).collect()}
    assert got == {
        1: ("c1", 0.95, "definition-match"), 2: ("d1", 0.80, "monosemous"), 3: ("lost", 0.85, "sense-id"), 4: ("r1", 0.70, "shared-tokens"), 5: (None, None, "ambiguous"),
        6: (None, None, "ambiguous"), 7: (None, None, "no-evidence"), 8: (None, None, "pos-mismatch"), 9: (None, None, "weak-definition"), 10: (None, None, "no-evidence"),
    }
    assert not graph.link_senses(senses.limit(0), evidence.limit(0), synsets.limit(0)).collect()


def test_taxonomy(spark):
    """Every tier, evidence without the headword itself, and chains over edges with a cycle."""
    keywords = spark.createDataFrame([("food", None, "eat"), ("food", None, "meal"), ("food", "fruit", "appl"), ("food", "fruit", "pear"), ("food", "fruit", "plum"), ("work", None, "job")], "top string, sub string, word string")
    domains = spark.createDataFrame([("food", "nutrition"), ("work", "office")], "top string, word string")
    entries = spark.createDataFrame(
        [
            (1, "appl", ["appl", "pear"]), (2, "appl", ["appl", "bank"]), (3, "appl", ["nutrition"]), (4, "x", ["pear", "plum"]), (5, "x", ["eat", "meal"]), (6, "eat", ["meal"]),
            (7, "x", ["pear"]), (8, None, None), (9, "pear", ["eat"]), (10, "x", ["eat", "meal", "pear", "plum"]),
        ],
        "entry_id int, headword string, tokens array<string>",
    )
    links = spark.createDataFrame([(7, "s1"), (5, "s1"), (6, "s4")], "entry_id int, synset_id string")
    edges = spark.createDataFrame([("s1", "s2"), ("s2", "s3"), ("s3", "s1")], "from_id string, to_id string")
    synsets = spark.createDataFrame([("s1", ["a"]), ("s3", ["office", "office", "nutrition"]), ("s4", None)], "synset_id string, tokens array<string>")
    chains = graph.chain_words(links, edges, synsets, domains.select("word"))
    got = {(r["entry_id"], r["top"], r["sub"]): (r["confidence"], r["method"]) for r in graph.taxonomy(entries, keywords, domains, chains).collect()}
    head, chain, gloss = (0.90, "headword"), (0.85, "wordnet-chain"), (0.80, "gloss")
    assert got == {
        (1, "food", "fruit"): head, (1, "food", ""): head, (3, "food", "fruit"): head, (3, "food", ""): head, (4, "food", "fruit"): gloss, (4, "food", ""): gloss,
        (5, "food", ""): chain, (5, "work", ""): chain, (6, "food", ""): head, (7, "food", ""): chain, (7, "work", ""): chain, (9, "food", "fruit"): head, (9, "food", ""): head,
        (10, "food", "fruit"): gloss, (10, "food", ""): gloss,
    }
    none = graph.chain_words(links.limit(0), edges, synsets, domains.select("word"))
    plain = {(r["entry_id"], r["top"], r["sub"], r["confidence"]) for r in graph.taxonomy(entries.where("entry_id = 5"), keywords, domains, none).collect()}
    assert plain == {(5, "food", "", 0.70)}


def test_merge(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, merge.insert_ignore(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert merge.upsert_report(old, new, "k").first().asDict() == {"inserted": 1, "updated": 1}
    path = str(tmp_path / "t")
    merge.swap(spark, old, path)
    merge.swap(spark, merge.upsert(spark.read.parquet(path), new, "k"), path)
    assert spark.read.parquet(path).count() == 3


def test_fold_equals_steps(spark):

    rng, rows, want = random.Random(1), [], {}
    for k in range(20):
        t, s, d = 0.0, None, None
        before = None
        for i in range(8):
            t += rng.choice([10.0, 86_400.0 * rng.randint(1, 30)])
            g = rng.randint(1, 4)
            rows.append((k, t, i, g))
            s, d, _ = review(s, d, 0.0 if before is None else (t - before) / 86_400, g)
            before = t
        want[k] = (s, d)
    for r in folded(spark.createDataFrame(rows, "k int, at double, seq int, grade int"), "k").collect():
        assert r["stability"] == pytest.approx(want[r["k"]][0], rel=1e-9) and r["difficulty"] == pytest.approx(want[r["k"]][1], rel=1e-9)


def test_embeddings(spark):
    import numpy as np

    from sensemill.operators import embed

    recipes = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "bad")], "key string, text string")
    empty = spark.createDataFrame([], "key string, sha string, embedding array<float>, version string")

    def encoder(texts):
        if "bad" in texts:
            raise RuntimeError
        return embed.hashing_encoder(8)(texts)

    out = embed.generate(embed.pending(recipes, empty), encoder, 8, batch=1)
    got = {r["key"]: r for r in out.collect()}
    assert got["c"]["failed"] and abs(np.linalg.norm(got["a"]["embedding"]) - 1) < 1e-6
    store = embed.upserted(empty, out)
    assert [r["key"] for r in embed.pending(recipes, store).collect()] == ["c"]
    assert embed.problems(store, 8).count() == 0 and embed.problems(store, 9).count() == 2


def test_normalise(spark, tmp_path):
    import json

    from sensemill.operators import normalise
    from sensemill.sources.adapters import dictionary_dump

    entry = {"word": "Bank", "lang": "English", "pos": "noun", "senses": [{"glosses": ["(pl: brzeg) edge of a river 1."]}, {"glosses": ["place for money"]}], "translations": [{"code": "pl", "word": "bank"}]}
    (tmp_path / "d.jsonl").write_text(json.dumps(entry))
    rows = normalise.candidates(dictionary_dump(spark, str(tmp_path / "d.jsonl"))).orderBy("n").collect()
    assert [(r["key"], r["gloss"]) for r in rows] == [("bank", "edge of a river"), ("bank", "place for money")]
    assert rows[0]["translations"] == ["bank", "brzeg"] and rows[1]["tokens"] == ["money", "place"]
