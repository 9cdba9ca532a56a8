"""Each operator on a table with nulls, empty, blank and very long texts, ties, repeated rows and clashing columns,
against brute force; and on an empty table."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sensemill.llm import decontaminate, language_model, licenses, mixing, near_dup, neighbours, quality, secrets, substrings, warc
from sensemill.llm.graph import components

W = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (5, 5), *((i, i + 1) for i in range(20, 60)), *((100, i) for i in range(101, 150))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and got[11] == 10 and 5 not in got
    assert {got[i] for i in range(20, 61)} == {20} and {got[i] for i in range(100, 150)} == {100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(docs, none, rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None and W(t):
            w = W(t)
            sets[i].append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = {i: i for i, t in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    same = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            same[t].add(i)
    links = [(a, b) for a in ids for b in ids if a < b and any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])]
    for a, b in [*links, *((min(s), i) for s in same.values() for i in s)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    null = {i for i, t in rows if t is None}
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] not in null} == {i: find(i) for i in ids if i not in null}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] in null)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["copy_of"] == 1 and by[5]["class_id"] == by[6]["class_id"] == 5
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    left = collections.Counter(r["doc_id"] for r in kept.collect())
    assert left[1] == 1 and left[2] == left[3] == left[11] == left[12] == left[6] == 0 and left[5] == 1 and left[None] == 2 and left[4] == 1
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_one(none).count() == 0


@pytest.mark.parametrize("size", [2048, 20])
def test_large_bucket(spark, monkeypatch, size):
    """A group of near copies larger than a bucket, and members that only resemble each other."""
    monkeypatch.setattr(near_dup, "BUCKET", size)
    base = [f"w{i}" for i in range(200)]
    out = [(0, " ".join(base))]
    for i in range(1, 120):
        t = list(base)
        t[i] = f"own{i}"
        out.append((i, " ".join(t)))
    half = base[:90] + [f"z{i}" for i in range(110)]
    out += [(200, " ".join(half)), (201, " ".join([*half[:-1], "end"]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(120)} == {0} and got[200] == got[201] == 200


@pytest.mark.parametrize("size", [2048, 20])
def test_pairs_among_look_alikes(spark, monkeypatch, size):
    """Pairs just over the threshold in one group of texts just under it: no look-alike hides them, nor does a split."""
    monkeypatch.setattr(near_dup, "BUCKET", size)
    shared, out = [f"w{i}" for i in range(356)], []
    for i in range(120):
        out.append((i, " ".join(shared + [f"p{i // 2}_{k}" for k in range(8)] + [f"own{i}_{k}" for k in range(38)])))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_repeats_do_not_part_equal_sets():
    """Registers agree as the sets of shingles do, however often one text repeats some of them."""
    import numpy as np
    import pyarrow as pa

    base = [f"w{i}" for i in range(1004)]
    more = base[:100] + base[100:404] * 200 + base[404:]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "digest": ["a", "b"], "text": [" ".join(base), " ".join(more)]})
    out = pa.Table.from_batches(list(near_dup.sketcher(5, 80)(iter([batch]))))
    a, b = (set(x) for x in out.column("shingles").to_pylist())
    assert len(a & b) > 0.99 * len(a | b)
    r, s = (np.frombuffer(x, "<u2") for x in out.column("registers").to_pylist())
    assert (r == s).mean() > 0.9


def test_probability_jaccard():
    import numpy as np

    n, m = 400, 4096
    text = np.repeat([0, 1], n)
    shingle = np.r_[np.arange(n), np.arange(100, 100 + n)].astype(np.uint64) * np.uint64(7919)
    held = near_dup.signatures(text, shingle, np.ones(2 * n), 2, m)
    assert abs((held[0] == held[1]).mean() - 300 / 500) < 0.04
    weight = np.where(np.r_[np.arange(n), np.arange(100, 100 + n)] < 200, 3.0, 1.0)
    held = near_dup.signatures(text, shingle, weight, 2, m)
    a = {int(s): w for s, w in zip(shingle[:n], weight[:n])}
    b = {int(s): w for s, w in zip(shingle[n:], weight[n:])}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)
    assert abs((held[0] == held[1]).mean() - want) < 0.04


@pytest.mark.parametrize("bucket", [20_000, 0])
def test_substrings(docs, none, rows, monkeypatch, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    first = {}
    for i, t in rows:
        w = W(t)
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, t in rows:
        w = W(t)
        gone = set()
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in substrings.remove_repeats(docs).collect()) == want
    assert sum(n for (_, _, n, _) in want) > 100
    assert substrings.remove_repeats(none).count() == 0


def test_licenses(spark, docs, none, rows):
    more = [
        (900, "Under the MIT License, the mit-license; CC BY. cc by"), (901, "GNU General Public\nLicense"), (902, "the Apache  License cc"), (903, "Łcc by"),
        (904, "x " + licenses.TEMPLATES[0][2][0].upper().replace(" ", ", ") + " y"), (905, licenses.TEMPLATES[1][2][0].replace("source", "other")), (906, licenses.TEMPLATES[3][2][0]),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in [*more, *(x for x in rows if x[0] is not None)]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        at = [k for p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None)), i
    assert got[900]["base_labels"] == "cc-by,mit" and got[901]["labels"] == "gpl" and got[902]["base_labels"] == "apache" and got[903]["n_base"] == 0
    assert got[904]["labels"] == "mit" and got[904]["base_labels"] == "" and got[904]["score"] == 1.0
    assert got[905]["labels"] == ""  # its key phrase is gone
    assert got[906]["labels"] == "gpl" and got[4]["n_words"] == 0
    assert licenses.scan_licenses(none).count() == 0


def test_whole_licenses(spark):
    """Every template is found whole, among other words, and with just so many words replaced as MATCHED allows, whichever they are."""
    import random

    rng, out, want = random.Random(1), [], {}
    for n, (label, key, passages) in enumerate(licenses.TEMPLATES):
        out.append((n, " ".join(f"noise{n} Copyright {p}." for p in passages)))
        want[n] = {label}
        words = [w for p in passages for w in p.split()]
        held = next(p for p in passages if f" {key} " in f" {p} ")
        for turn in range(6):
            changed = []
            for p in passages:
                w = p.split()
                fixed = range(at := len(f" {p} ".partition(f" {key} ")[0].split()), at + len(key.split())) if p == held else ()
                for i in rng.sample([i for i in range(len(w)) if i not in fixed], int(len(w) * 0.2 + 1e-9)):
                    w[i] = f"other{i}"
                changed.append(" ".join(w))
            out.append((100 * (turn + 1) + n, "\n".join(changed)))
            want[100 * (turn + 1) + n] = {label}
        w = words[:]
        for i in rng.sample(range(len(w)), int(len(w) * 0.2 + 1e-9) + 2):
            w[i] = "gone"
        if len(passages) == 1:
            out.append((9000 + n, " ".join(w)))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    for i, labels in want.items():
        assert labels <= set(got[i]["labels"].split(",")), (i, got[i])
    assert all(label not in got[9000 + n]["labels"].split(",") or label in got[9000 + n]["base_labels"] for n, (label, _, p) in enumerate(licenses.TEMPLATES) if len(p) == 1)


def test_licence_families_insertions_and_best_template(spark):
    """Words put in or left out, larger templates before those inside them, two licences in one text, and order that must hold."""
    import random

    whole = {}
    for label, _, passages in licenses.TEMPLATES:
        if len(passages) > len(whole.get(label, [])):
            whole[label] = passages
    mit, rng = whole["mit"][0].split(), random.Random(3)
    rows = [
        (1, " ".join([*mit[:40], "inserted", *mit[40:]]) + " " + " ".join(whole["mit"][1:]), "mit"),
        (2, " ".join([*mit[:20], "two", "more", *mit[20:45], *mit[48:]]) + " " + " ".join(whole["mit"][1:]), "mit"),
        (3, ". ".join(whole["bsd-3-clause"]), "bsd-3-clause"),
        (4, ". ".join(whole["bsd-2-clause"]), "bsd-2-clause"),
        (5, whole["bsd-2-clause"][0], "bsd"),
        (6, ". ".join(whole["bsd-3-clause"]) + " and then " + ". ".join(whole["bsd-2-clause"]), "bsd-2-clause,bsd-3-clause"),
        (7, ". ".join(whole["isc"]), "isc"),
        (8, ". ".join(whole["apache"]), "apache"),
        (9, "gnu gpl " + whole["gpl-3"][0], "gpl,gpl-3"),
        (10, whole["gpl-2"][0], "gpl,gpl-2"),
        (11, " then ".join(whole["lgpl"]), "lgpl"),
        (12, " ".join(rng.sample(mit, len(mit))), ""),
        (13, ". ".join(whole["agpl"]), "agpl"),
        (14, " ".join(w + " pad" * 3 for w in mit), ""),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: labels for i, _, labels in rows}


def test_licence_words_in_order():
    """The bits' longest common subsequence against the plain table."""
    import random

    import numpy as np

    index, rng = licenses.Index(), random.Random(4)
    for _ in range(200):
        p = rng.randrange(len(index.passages))
        own = index.passages[p].tolist()
        words = [w for w in own if rng.random() < 0.8] if rng.random() < 0.5 else rng.choices([*own, -1], k=rng.randrange(2 * len(own)))
        for _ in range(rng.randrange(5)):
            words.insert(rng.randrange(len(words) + 1), -1)
        best = [0] * (len(own) + 1)
        for w in words:
            new = best[:]
            for i, o in enumerate(own):
                new[i + 1] = best[i] + 1 if o == w else max(best[i + 1], new[i])
            best = new
        assert index.in_order(p, np.array(words, np.int64)) == best[-1]


def test_secrets(spark, docs, none):
    key, token = "AKIA" + "A1B2" * 5, "Zx9" + "aB3" * 14
    more = [
        (900, f'password = "hunter2000"; Token:short; SECRET=abcdefgh', "o1"), (901, f"é日 {key} and AKIA123 {'0af9' * 8}", "o1"), (902, f"see {token} here", "o1"),
        (903, "example AAAA1bcdefghijklmnopqrstuvwxyz0123456789", "o1"), (904, "example AAAA1bcdefghijklmnopqrstuvwxyz0123456789", "o2"),
        (905, "example AAAA1bcdefghijklmnopqrstuvwxyz0123456789", None), (906, "token:secret:longvalue1 passwd==abcdefg12", "o3"), (907, "a" * 40 + " " + "ß" * 3 + "b" * 32, "o3"),
        (908, " ".join(["0123456789abcdef" * 2] * 500), "o4"),
    ]
    both = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    got = {r["doc_id"]: r for r in secrets.find_secrets(both).collect() if r["doc_id"] is not None}
    assigned = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t, _ in more:
        spans = [(m.start(), 0, m.end()) for m in assigned.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3)), i
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), i
    assert got[902]["spans"] == f"opaque:4:{4 + len(token)}" and got[902]["n_live"] == 1
    assert [got[i]["spans"] for i in (903, 904, 905)] == ["", "", ""]  # three owners: an example
    often = [(3000 + i, f"see {token}{i % 2} here", "o1") for i in range(17)]  # nine and eight repositories of one owner
    often += [(4000 + i, f"see {token}9 here", "o1") for i in range(10)]  # ten
    many = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(often, "doc_id long, text string, source string")).collect()}
    assert all((r["n_live"], r["n_example"]) == ((1, 0) if i < 4000 else (0, 0)) for i, r in many.items())
    assert got[4]["spans"] == "" and got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = secrets.without_secrets(both.withColumn("size", F.lit(1)))
    assert clean.columns == [*both.columns, "size"] and clean.count() == both.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[902] == "see <opaque> here" and texts[903] == more[3][1] and texts[900] == '<assign>"; Token:short; <assign>' and texts[4] is None
    assert texts[908] == " ".join(["<hex>"] * 500) and texts[901] == "é日 <access> and AKIA123 <hex>"
    assert secrets.find_secrets(none).count() == 0 and secrets.without_secrets(none).count() == 0


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > cap * sizes[s]}
        if not full:
            out |= {s: unit * w[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(docs, none):
    rows = [r.asDict() for r in docs.select("doc_id", "source", "text").collect()]
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(W(r["text"]))
    want = _targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    often = collections.Counter(r["doc_id"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in rows if often[r["doc_id"]] == 1}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] in source:
            assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
    kept = mixing.mix(docs, keep=True)
    assert kept.columns == [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")] + ["size", "source_size", "target", "taken"]
    assert all(r["h"] == 1 and r["copies"] == r["of"] == 7 for r in kept.collect())
    assert mixing.mix(docs.drop("size").withColumn("Size", F.lit(1)), keep=True).columns == kept.columns
    for r in kept.collect():
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, got))
    assert mixing.mix(none).count() == 0 and mixing.mix(none, keep=True).count() == 0


def test_targets_of_many_sources(spark, monkeypatch):
    """Sources sorted in parts weigh as in one order."""
    monkeypatch.setattr(mixing, "MOST_SOURCES_SENT", 7)
    sizes = {None: 5, "": 0, "Z": 1, "a": 9, "é": 3, **{f"s{i}": (i * 37) % 50 for i in range(40)}}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = _targets(sizes)
    assert len(got) == len(sizes) and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_mixing_of_one_document(spark):
    one = spark.createDataFrame([(1, "s", "a b c d"), (2, None, ""), (3, "t", None)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in mixing.mix(one).collect()}
    assert got[1]["target"] == 6.0 and got[1]["taken"] in (4, 8) and got[2]["taken"] == got[3]["taken"] == 0


def test_decontamination(spark, docs, none):
    item = [f"item{i}" for i in range(30)]
    changed = lambda *at: " ".join("changed" if i in at else w for i, w in enumerate(item))
    bench = [(1, " ".join(item)), (2, "seven words stand in this short item"), (3, "too short"), (4, None), (None, "a b c d e f g h"), (5, ""), (1, " ".join(item)), (6, "one two three four five"), (7, "a b c d e f g h i j"), (8, "solo")]
    more = [
        (910, "x one two three four five y"), (911, "one two three four other"), (912, "k a b X d e f Y h i j k"), (913, "a b X d e Y g h Z j"), (914, "z z a b c d e f g h i j"), (915, "Too, short!"), (916, "too short by far"), (917, "SOLO"), (918, "solo solo"),
        (900, "x y " + changed() + " z"), (901, changed(4, 9, 14, 19, 24)), (902, changed(3, 6, 9, 12, 15, 18, 21, 24, 27)), (903, " ".join(item[5:18])), (904, " ".join(item[5:15])),
        (905, "A, Seven words -- STAND in this short item."), (906, "seven words stand in this shorter item"), (907, changed(5, 11) + " " + changed(6)),
    ]
    benchmark = spark.createDataFrame(bench, "item_id long, text string").withColumn("matched", F.lit(1))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(both, benchmark).collect()}
    assert set(got) == {(900, 1), (901, 1), (903, 1), (905, 2), (906, 2), (907, 1), (910, 6), (912, 7), (914, 7), (915, 3), (917, 8)}
    assert got[900, 1]["similarity"] == 1.0 and got[901, 1]["matched"] == 11 and got[905, 2]["window"] == 7
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert decontaminate.overlaps(none, benchmark).count() == 0 and decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0


def test_every_substitution_is_found():
    """Whatever two of 13 words are ignored, some seed stands in the rest."""
    import itertools

    for gone in itertools.combinations(range(13), 2):
        ok = [i not in gone for i in range(13)]
        assert any(all(ok[i : i + 3]) and all(ok[i + 3 + g : i + 6 + g]) for g in decontaminate.GAPS for i in range(13 - 6 - g + 1)), gone


def test_quality(spark, docs, none, rows):
    good = [(1000 + i, "The plain text of number %d goes on and on, with words." % i + " More of it follows here. " * (i % 7)) for i in range(300)]
    bad = [(2000 + i, "BUY!! NOW!! %d " % i * (3 + i % 9)) for i in range(150)]
    more = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(4, 1, 0), (None, 1, 0), (5, None, 0), (1000, 1, 0)], "doc_id long, quality int, toxic int")
    both = docs.select("doc_id", "text").unionByName(more)
    got = quality.classify(both, labels).collect()
    assert len(got) == both.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert sum(r["predicted"] == int(r["doc_id"] < 2000) for r in held) >= 0.98 * len(held) > 50
    kept = quality.good_only(docs, labels)
    assert kept.columns == docs.columns
    assert [r["score"] for r in quality.classify(docs, labels.limit(0)).collect()] == [0.5] * len(rows)
    assert quality.classify(none, labels).count() == 0 and quality.good_only(none, labels.limit(0)).count() == 0


def test_language_model(docs, none, rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*W((t or "").translate(lower)), None]) for i, t in rows]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, z = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    want = collections.Counter((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10(c[w] + 0.1) - z for w in ws), 4)) for i, ws in tokens)
    got = language_model.score_documents(docs).collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score_documents(none).count() == 0
    schema = docs.select("doc_id", "text").schema
    several = language_model.score_documents(docs.sparkSession.createDataFrame(docs.select("doc_id", "text").collect(), schema).repartition(4)).collect()
    assert collections.Counter((r["doc_id"], round(r["base_score"], 4)) for r in several) == collections.Counter((i, b) for i, _, _, _, _, b in want.elements())
    unseen = language_model.score_documents(docs.where("doc_id is null")).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0.0 for r in unseen)


def test_model_beats_the_base(spark):
    """Held-out texts of a language in which most words tell the next one: the model learns what a unigram can't."""
    import random

    rng = random.Random(7)
    follow = {w: [rng.randrange(60) for _ in range(3)] for w in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(rng.randint(30, 90)):
            out.append(f"word{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(3000)], "doc_id long, text string").coalesce(1)
    held = language_model.score_documents(df).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] / held[2] > held[1] / held[2] + 0.3


def test_window_gradients():
    """Backpropagation through a window against differences of the likelihood, for every kind of parameter."""
    import numpy as np

    from sensemill.llm import gru

    rng, words = np.random.default_rng(4), 40
    m = gru.Model(gru.start(np.arange(words, 0, -1.0), np.ones(gru.TAIL)), words)
    m.flat += rng.normal(0, 0.3, len(m.flat)).astype(np.float32)
    before, target = rng.integers(0, 72, (5, 3)), rng.integers(0, 72, (5, 3))
    fresh, inside, h = np.zeros((5, 3), bool), np.ones((5, 3), bool), rng.normal(0, 0.5, (3, gru.HIDDEN)).astype(np.float32)
    fresh[2, 1], inside[4, 2] = True, False
    grad, node, _ = m.gradients(before, target, fresh, inside, h)

    def loss():
        return -m.log_p(m.forward(before, fresh, h)[inside], target[inside])[0].sum()

    for name, at in (("again", (3, 5)), ("again", (2, 20)), ("again", (7, 40)), ("to_class", (2, 1)), ("class_bias", (0,)), ("to_word", (int(target[0, 0]) % words, 3)), ("gates", (int(before[0, 0]), 4)), ("gates", (int(before[1, 1]), 22)), ("gates", (int(before[1, 0]), 37))):
        x = m.p[name]
        x[at] += 5e-3
        up = loss()
        x[at] -= 1e-2
        slope = (up - loss()) / 1e-2
        x[at] += 5e-3
        g = grad[name][np.searchsorted(node, at[0]), at[1]] if name == "gates" else grad[name][at]
        assert g == pytest.approx(slope, abs=2e-2), (name, at)


def test_model_is_a_distribution():
    """Whatever the text so far, the probabilities of all next words sum to one."""
    import numpy as np

    from sensemill.llm import gru

    words = 70
    m = gru.Model(gru.start(np.arange(words, 0, -1.0), np.ones(gru.TAIL)), words)
    m.train(np.random.default_rng(2).integers(0, words + gru.TAIL, 4000), np.arange(0, 4001, 100))
    state = np.tile(m.forward(np.array([[3], [5]]), np.array([[True], [False]]), np.zeros((1, gru.HIDDEN), np.float32))[-1], (words + gru.TAIL, 1))
    assert np.exp(m.log_p(state, np.arange(words + gru.TAIL))[0]).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried():
    import numpy as np

    from sensemill.llm import gru

    rng = np.random.default_rng(3)
    m = gru.Model(gru.start(np.arange(70, 0, -1.0), np.ones(gru.TAIL)), 70)
    m.train(rng.integers(0, 102, 6000), np.arange(0, 6001, 60))
    ids, first = rng.integers(0, 102, 1000), np.array([0, 400, 400, 407, 1000])
    whole = m.score(ids, first, most=3, steps=1000)
    assert np.allclose(whole, m.score(ids, first, most=2, steps=7), atol=1e-4)
    assert np.allclose(whole[407:], m.score(ids[407:], np.array([0, 593])), atol=1e-4)


def test_gradients():
    import numpy as np

    from sensemill.llm import gru

    rng = np.random.default_rng(4)
    m = gru.Model(gru.start(np.arange(40, 0, -1.0), np.ones(gru.TAIL)), 40)
    h, ids = rng.normal(0, 1, (9, gru.HIDDEN)).astype(np.float32), rng.integers(0, 72, 9)
    grad = {k: np.zeros_like(v) for k, v in m.p.items()}
    dh = m.log_p(h, ids, grad)[1]
    step = np.zeros_like(h)
    step[2, 3] = 1e-2
    slope = -(m.log_p(h + step, ids)[0].sum() - m.log_p(h - step, ids)[0].sum()) / 2e-2
    assert dh[2, 3] == pytest.approx(slope, abs=2e-3)


def test_warc(spark, none, tmp_path):
    long, other = "<p>" + "é" * 100, "x" * 99
    rows = [(3, "http://a/1", long), (2, "http://a/2", long), (2, "http://a/2", long), (9, None, long), (None, "u\r\nX: y", long), (4, "b", other), (5, "b", other), (6, "b", ""), (7, "b", None), (8, "b", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = collections.Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = b == long.encode() and i != 2
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.page_records(pages).coalesce(1).write.format("warc").option("roll_bytes", 200).mode("append").save(path)
    df = spark.read.format("warc").option("partition_bytes", 500).load(path)
    assert df.rdd.getNumPartitions() > 1
    some = df.where("record_type = 'response' and page_id in (2, 4) and target_uri like 'http%'")
    assert [(r["page_id"], r["payload"].decode()) for r in some.collect()] == [(2, long)] * 2
    rows_of = lambda w: sorted((r["page_id"] is None, r["page_id"], r["record_type"]) for r in spark.read.format("warc").load(path).where(w).select("page_id", "record_type").collect())
    records = [r.asDict() for r in spark.read.format("warc").load(path).collect()]
    digest = hashlib.sha256(long.encode()).hexdigest()
    for where, holds in (
        ("payload_bytes = 99", lambda r: r["payload_bytes"] == 99), ("payload_bytes in (0, 207)", lambda r: r["payload_bytes"] in (0, 207)), ("payload_bytes > 300", lambda r: r["payload_bytes"] > 300),
        (f"payload_digest = '{digest}'", lambda r: r["payload_digest"] == digest), ("refers_to = 2", lambda r: r["refers_to"] == 2), ("refers_to is null", lambda r: r["refers_to"] is None),
        ("page_id in (3, 8)", lambda r: r["page_id"] in (3, 8)), ("record_type = 'revisit'", lambda r: r["record_type"] == "revisit"), ("target_uri = 'b'", lambda r: r["target_uri"] == "b"), ("target_uri like 'http%'", lambda r: (r["target_uri"] or "").startswith("http")),
        ("payload = X'" + other.encode().hex() + "'", lambda r: r["payload"] == other.encode()),
    ):
        assert rows_of(where) == sorted((r["page_id"] is None, r["page_id"], r["record_type"]) for r in records if holds(r)) != [], where
    heads = spark.read.format("warc").option("payload", "false").load(path).collect()
    assert all(r["payload"] is None for r in heads) and len(heads) == len(rows)


def test_foreign_archives(spark, tmp_path):
    import gzip

    record = lambda k, body: f"WARC/1.0\r\nWARC-Type: {k}\r\nWARC-Target-URI: http://x/{k}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    body = "HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody"
    (tmp_path / "a.warc").write_bytes(record("warcinfo", "i: j") + record("response", body))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("request", "GET / HTTP/1.1\r\n\r\n")) + gzip.compress(record("response", body)))
    warc.register(spark)
    got = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert sorted(r["record_type"] for r in got) == ["request", "response", "response", "warcinfo"]
    assert [r["payload"] for r in got if r["record_type"] == "response"] == [b"body", b"body"]
    assert spark.read.format("warc").load(f"file://{tmp_path}").where("record_type = 'response'").count() == 2
    big = "HTTP/1.1 200 OK\r\n\r\n" + "line\r\n\r\nof text " * 40_000
    whole = record("warcinfo", "i: j") + record("response", body) + record("request", "GET") + record("response", big) + record("metadata", "")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.warc.gz").write_bytes(gzip.compress(whole))  # one member for all records
    (tmp_path / "c" / "cut.warc.gz").write_bytes(b"".join(gzip.compress(whole[a : a + 50_000]) for a in range(0, len(whole), 50_000)))  # members end anywhere
    (tmp_path / "c" / "plain.warc").write_bytes(whole)
    for payload in ("true", "false"):
        df = spark.read.format("warc").option("payload", payload).load(f"file://{tmp_path}/c")
        got = collections.Counter((r["record_type"], r["payload"]) for r in df.collect())
        want = [("warcinfo", None), ("request", None), ("metadata", None), ("response", b"body"), ("response", big.partition("\r\n\r\n")[2].encode())]
        assert got == collections.Counter({(k, p if payload == "true" else None): 3 for k, p in want} | ({("response", None): 6} if payload == "false" else {}))
        assert df.where("record_type = 'response' and payload_bytes = 4").count() == 3


def test_neighbours(spark):
    import random

    rng = random.Random(3)
    vectors = [(i, [float(f"{rng.gauss(0, 1 + i % 5):.3f}") for _ in range(8)]) for i in range(700)]
    vectors += [(1000 + i, vectors[20][1]) for i in range(60)]  # copies, more than k
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2100, [1.0] * 3), (2120, []), (2121, [2.0, 0.0, -1.0]), (5, vectors[5][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, shard_rows=300).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    queries = {i for i, _ in vectors if i % 20 == 0}
    assert set(got) == queries | {2100} and got.pop(2100) == [(1, 2121, 1.0)]  # of its own length
    exact = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(30)]
    for r in neighbours.nearest(spark.createDataFrame(exact, "vec_id long, embedding array<double>")).collect():
        assert abs(r["score"] - sum(a * b for a, b in zip(exact[r["query_id"]][1], exact[r["vec_id"]][1]))) < 1e-14
    import numpy as np

    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    found = 0
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        want = [int(ids[o]) for o in np.lexsort((ids, -s)) if ids[o] != q][:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(v - s[np.flatnonzero(ids == i)[0]]) < 1e-9 for _, i, v in mine)
        assert [(-v, i) for _, i, v in mine] == sorted((-v, i) for _, i, v in mine)
        found += len({i for _, i, _ in mine} & set(want))
    assert found >= 0.97 * 20 * len(queries)
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert neighbours.nearest(df.limit(0)).count() == 0
