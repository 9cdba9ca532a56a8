"""Rows repeated a thousand times, and archives with broken records."""

import gzip
import random
import time

from sensemill.llm import near_dup, quality, substrings, warc


def test_substrings_of_repeated_rows(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(900)]
    one, two = " ".join(words), " ".join(words[:400] + ["other"] + words[400:])
    def run(k):
        rows = spark.createDataFrame([(1, one)] * k + [(2, two)] * k, "doc_id long, text string").repartition(4)
        began = time.time()
        got = {tuple(r)[:3] for r in substrings.remove_repeats(rows).collect()}
        return got, time.time() - began
    few, _ = run(1)
    assert few == {(1, 900, 0), (2, 901, 900)}
    many, seconds = run(1000)
    assert many == few and seconds < 120


def test_one_row_of_each_labelled_id_reaches_the_driver(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("1L as doc_id", "'some words of no use' as text").union(spark.range(2, 40).selectExpr("id", "repeat('good text ', int(id))"))
    labels = spark.range(1, 40).selectExpr("id as doc_id", "int(id % 2) as quality")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **k: seen.append(len(x)) or fit(x, y, **k))
    quality.train(docs, labels, most=10)
    assert 0 < seen[0] <= 10


def test_near_duplicates_of_repeated_rows(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    rows = [(1, " ".join(words))] * 1000 + [(2, " ".join(words[:-1] + ["x"]))] * 1000 + [(3, " ".join(words[:20]))]
    began = time.time()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 2001 and {tuple(r) for r in got} == {(1, 1, 1), (2, 1, 2), (3, 3, 3)} and time.time() - began < 120


def test_broken_archives(spark, tmp_path):
    def record(n, body, length=None):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u{n}\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n{body}\r\n\r\n".encode()
    http = "HTTP/1.1 200 OK\r\nContent-Length: {}\r\n\r\nbody"
    good = record(1, http.format(4))
    bad = [record(2, http.format(4), "x"), record(3, http.format(4), ""), record(4, http.format("4x")), record(5, "HTTP/1.1 200 OK\nContent-Length: 4\n\nbody"), b"no record\r\n"]
    whole = good + b"".join(bad) + record(6, http.format(4))
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole) + b"what follows the last member")
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (good, *bad, record(6, http.format(4)))) + b"\x00\x00junk")
    broken = bytearray(gzip.compress(whole * 50))
    broken[len(broken) // 2] ^= 0xFF
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "d.warc.gz").write_bytes(bytes(broken))
    warc.register(spark)
    got = sorted((r["target_uri"], r["payload"], r["payload_bytes"]) for r in spark.read.format("warc").load(f"file://{tmp_path}").collect() if r["payload_bytes"] is not None)
    assert got == sorted([("u1", b"body", 4), ("u5", b"body", 4), ("u6", b"body", 4)] * 3)
    null = [(r["target_uri"], r["payload"]) for r in spark.read.format("warc").load(f"file://{tmp_path}").where("payload_bytes is null").collect()]
    assert null == [("u4", b"body")] * 3
    assert spark.read.format("warc").load(f"file://{tmp_path}/d").count() < 200

    # the writer's own members, one of which is broken
    pages = spark.createDataFrame([(i, "u", "x" * 3000) for i in range(3)], "page_id long, url string, html string")
    path = f"{tmp_path}/own"
    warc.page_records(pages).coalesce(1).write.format("warc").mode("append").save(f"file://{path}")
    import glob

    (name,) = [f for f in glob.glob(f"{path}/*.gz")]
    raw = bytearray(open(name, "rb").read())
    raw[30:34] = b"\xff\xff\xff\xff"
    open(name, "wb").write(bytes(raw))
    assert spark.read.format("warc").load(f"file://{path}").count() == 2
