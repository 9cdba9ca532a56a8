"""Filter audit, line dedup and spelling variants against brute force, on nulls, ties, repeats, long texts and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensemill.llm import filter_audit, line_dedup, queries, spelling

from ..conftest import SF, rows_of

W = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_dedup"])
def test_against_sql(spark, duck, name):
    df, r = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(r.columns, [dict(zip(r.columns, x)) for x in r.fetchall()])


@pytest.mark.parametrize("step", [5, 64, 1 << 18])
def test_transducer(monkeypatch, step):
    monkeypatch.setattr(filter_audit, "STEP", step)
    rng = random.Random(step)
    parts = ["a", "b", "é", "漢", "😀", " ", "\n", "\t", "A", "#", "x", "Z", "|", " ", "ab" * 300, "q" * 257, "q" * 256]
    texts = ["", "", *("".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 40, 300]))) for _ in range(60)), ""]
    raw = [t.encode() for t in texts]
    got = filter_audit.transduce(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])])
    want = [(len(W(t)), len(set(W(t))), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)) for t in texts]
    assert got.T.tolist() == [list(w) for w in want]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit.Spans, "_hash", lambda self, start, size, text: np.zeros(len(start), np.uint64))
    text = " ".join(["one", "two", "one", "three", "x" * 300, "x" * 300, "x" * 299 + "y"]).encode()
    assert filter_audit.transduce(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[:2].ravel().tolist() == [7, 5]


def audit_by_hand(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = collections.defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = W(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        docs[s or ""].append(({f for f in fails if fails[f]}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part, found in docs.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = found
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                redundant = sum(f in d[0] for d in found) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(d[0] == {f} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


def test_audit(spark, docs, none):
    plain = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    plain += [(900 + i, t, "more") for i, t in enumerate(["Loud TEXT", "#1", " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)), "漢 " * 300])]
    plain += [(900, "Loud TEXT", "more")] * 3 + [(None, "Loud TEXT", ""), (None, "Loud TEXT", None)]
    labels = [(i, q, x) for i, q, x in ((1, 1, 0), (2, 1, 1), (2, 0, None), (902, 1, 1), (903, None, 1), (None, 1, 1), (900, 0, 1))]
    rows = spark.createDataFrame(plain, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("part", "pattern", "n", "digest", "good", "step", "first", "alone")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("q", "t", "n", "part")})
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(rows, marks).collect()}
    want = audit_by_hand(plain, labels)
    assert got == want and len(got) == 600 * len({s or "" for _, _, s in plain})
    assert filter_audit.audit(rows, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    assert filter_audit.audit(none, marks).count() == 0


def lines_by_hand(rows):
    keys = lambda t: [(x, x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})) for x in (t or "").split("\n")]
    least = {}
    for i, t in rows:
        for _, k in keys(t):
            if i is not None and len(k) >= 10:
                least[k] = min(i, least.get(k, i))
    out = []
    for i, t in rows:
        kept = [x for x, k in keys(t) if i is None or len(k) < 10 or least[k] == i]
        out.append((i, len(keys(t)), len(keys(t)) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bits", [1 << 29, 1 << 8])
def test_lines(spark, docs, none, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)  # a filter that is too small makes more suspects, never other results
    rng = random.Random(2)
    shared = [" Ein langer, GLEICHER Satz.\t", "ein langer, gleicher satz.", "kurz", "ééééééééé", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "", "  ", "x\x1f" * 6, " " + "y" * 12]
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain += [(1000 + i // 2, "\n".join(rng.choice([*shared, f"own line number {i}", f"own line number {i}"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    plain += [(None, shared[0]), (7, "\n\n"), (2000, "z" * 100_000 + "\n" + "z" * 100_000), (2001, "Z" * 100_000)] + [(3000, "again and again\nonce")] * 50 + [(3001, "again and again\r")] * 50
    rows = spark.createDataFrame(plain, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "lost", "found", "line", "kept", "digest", "n_lines", "h")}).repartition(5)
    want = lines_by_hand(plain)
    key = lambda x: tuple(str(v) for v in x)
    got = [tuple(r) for r in line_dedup.dedup_lines(rows).collect()]
    assert sorted(got, key=key) == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want), key=key)
    cut = line_dedup.without_repeated_lines(rows)
    assert cut.columns == rows.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in cut.collect()), key=key) == sorted(((i, t) for i, _, _, t in want), key=key)
    assert line_dedup.dedup_lines(none).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w, k in words.items():
        near[w] = sorted((-words[v], v) for v in words if one_edit(w, v))
        form[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 2 * k else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), k, len(near[w]), words[form[w]] if form[w] else None) for w, k in words.items()}


@pytest.mark.parametrize("chunk", [2048, 7])
def test_spelling(spark, docs, none, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    plain = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is None or len(r["text"]) < 20_000]
    for i in range(150):
        words = []
        for _ in range(60):
            w, k = rng.choice(stems), rng.random()
            at = rng.randrange(len(w))
            words.append(w if k < 0.7 else w[:at] + w[at + 1 :] if k < 0.8 else w[:at] + rng.choice("abcÀéß") + w[at:] if k < 0.9 else w[:at] + rng.choice("aÉ×") + w[at + 1 :])
        plain.append((i, rng.choice([" ", "-", "漢", "\n"]).join(words).upper() if i % 3 else " ".join(words)))
    plain += [(None, "colour colour colour"), (None, "color " * 7), (5, "y" * 30_000), (6, "y" * 30_000), (7, "y" * 30_000), (8, ("y" * 30_001 + " ") * 9)]
    plain += [(4000 + k, ("kettenwort" + "stu"[:k] + " ") * (4 << 2 * k)) for k in range(4)]  # a chain of forms
    rows = spark.createDataFrame(plain, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "block", "name", "id", "root", "form")}).repartition(5)
    want = variants_by_hand(plain)
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in spelling.group_variants(rows).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 50 and any(v[0] and v[1] != v[0] for v in want.values())
    assert spelling.group_variants(none).count() == 0


def test_runs_over_slices(monkeypatch):
    monkeypatch.setattr(spelling, "_SLICE", 7)
    text = "Überlange Wörter, ganz kurze; 漢字 und ÷zeichen " * 5 + "Ende"
    assert spelling.runs_of(text) == collections.Counter(r.translate({c: c + 32 for c in range(65, 91)}).encode("latin-1") for r in re.findall("[A-Za-zÀ-ÿ]+", text))


def test_groups_change_work_only(spark, monkeypatch):
    words = spark.createDataFrame([("".join(x), 3 + i) for i, x in enumerate(itertools.product("abz", repeat=5))], "word string, n long")
    want = None
    for groups in (1, 3, 9):
        monkeypatch.setattr(spelling, "groups_for", lambda n: groups)
        got = sorted(tuple(r) for r in spelling.near_words(words).collect())
        assert want in (None, got) and len(got) == 243 and all(r[1] == 10 for r in got)
        want = got


def test_nothing_of_the_vocabulary_is_broadcast(spark):
    """Small files hold large tables of pairs, so no join is left to their sizes."""
    words = spark.createDataFrame([("abcde", 3), ("abcdf", 7)], "word string, n long")
    for df in (spelling.near_words(words), spelling.group_variants(spark.createDataFrame([(1, "abcde abcdf")], "doc_id long, text string"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
