"""Line dedup with two Bloom filters, for line hashes seen once and seen twice.

1. A scan gives the 64-bit hash of each line key, once for each document; a batch sends a hash at most twice.
   Each hash range passes its hashes through a filter of those seen once; what that filter knows already
   goes into the filter of those seen twice. The ranges' second filters are one, joined word by word.
2. Every task of the second scan holds the filter of those seen twice. Only lines it knows are shuffled: by
   SHA-256 of their key, where the smallest document is found and false positives and lines of one
   document are let go.
3. Lost keys are gathered by document, and the texts that lose lines are read again and cut. What loses none
   needs its text's digest only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import map_arrow, written

LEAST_CHARS = 10
_STRIP = b" \t\n\v\f\r"
#: Hashes that one range's first filter is made for, and bits a hash: 8 MB.
RANGE_HASHES, BITS = 4 << 20, 16
#: The second filter is broadcast: 16 bits for each hash that is sent, but at most so many in all (64 MB). Where repeats are more than
#: some 30 million, more lines are suspected by mistake, which the exact confirmation lets go again.
MOST_BITS = 1 << 29


def keys_of(text: bytes, least: int = LEAST_CHARS) -> list[bytes]:
    """The keys of a text's lines, in order; empty for those of fewer than `least` code points."""
    out = []
    for line in text.lower().split(b"\n"):
        line = line.strip(_STRIP)
        out.append(line if len(line) >= least and (len(line) >= 4 * least or line.isascii() or len(line.decode("utf-8", "replace")) >= least) else b"")
    return out


class Bloom:
    """A blocked Bloom filter over 64-bit hashes: one word of 64 bits for each hash, four bits in it."""

    def __init__(self, bits: int) -> None:
        self.words = np.zeros(max(1 << 10, 1 << max(0, bits - 1).bit_length() >> 6), np.uint64)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = K.mix(h)
        bits = np.zeros(len(h), np.uint64)
        for i in range(4):
            bits |= K.U(1) << (h >> K.U(6 * i) & K.U(63))
        return (h >> K.U(24) & K.U(len(self.words) - 1)).astype(np.int64), bits

    def add(self, h: np.ndarray) -> None:
        at, bits = self._place(h)
        np.bitwise_or.at(self.words, at, bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        at, bits = self._place(h)
        return self.words[at] & bits == bits


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.unique(_hash([k for k in keys_of(text.as_py().encode(), least) if k])) for text in batch.column("text")]
            if seen:
                h, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, np.minimum(n, 2)).view(np.int64))], ["h"])

    return run


def _seen_twice(once_bits: int, twice_bits: int):
    """Of a range of hashes: the words of the second filter that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(once_bits), Bloom(twice_bits)
        for batch in batches:
            h, n = np.unique(batch.column("h").to_numpy().view(np.uint64), return_counts=True)
            twice.add(h[(n > 1) | once.has(h)])
            once.add(h)
        at = np.flatnonzero(twice.words)
        for a in range(0, len(at), 1 << 18):
            some = at[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(twice.words[some].view(np.int64))], ["at", "bits"])

    return run


def _sha(line: bytes) -> bytes:
    return hashlib.sha256(line).digest()


def _scan(held, least: int):
    """Number of lines of each text, and the digests of its suspected lines' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, found = [], []
            for text in batch.column("text"):
                raw = text.as_py().encode()
                keys = list({k for k in keys_of(raw, least) if k})
                known = np.flatnonzero(held.value.has(_hash(keys))).tolist()
                n_lines.append(raw.count(b"\n") + 1)
                found.append([_sha(keys[i]) for i in known] or None)
            columns = [pa.array(n_lines, pa.int64()), pa.array(found, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest")), *columns], ["doc_id", "digest", "n_lines", "found"])

    return run


def kept_lines(text: bytes, lost: set[bytes], least: int = LEAST_CHARS) -> list[bytes]:
    return [line for line, key in zip(text.split(b"\n"), keys_of(text, least)) if not key or _sha(key) not in lost]


def _cutter(least: int, whole: bool):
    """Cuts column text by column lost; whole gives the kept text, else its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, out = [], [], []
            for text, lost in zip(batch.column("text"), batch.column("lost")):
                raw = text.as_py().encode()
                kept = kept_lines(raw, set(lost.as_py()), least)
                lines.append(raw.count(b"\n") + 1)
                dropped.append(lines[-1] - len(kept))
                kept = b"\n".join(kept)
                out.append(kept.decode("utf-8", "replace") if whole else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], ["row", "n_lines", "n_dropped", "kept"])

    return run


def seen_twice(rows: DataFrame, least: int = LEAST_CHARS) -> Bloom:
    """The filter of the line hashes that two rows of rows (doc_id, text, neither null) may hold."""
    hashes, _ = written(map_arrow(rows, _hashes(least), "h long"), "line-hashes")
    n = hashes.count()
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_HASHES))
    bits = min(MOST_BITS, max(1 << 16, n * BITS))
    words = hashes.repartition(ranges, "h").mapInArrow(_seen_twice(min(RANGE_HASHES, 1 + 2 * n // ranges) * BITS, bits), "at long, bits long")
    words = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS
    twice = Bloom(bits)
    twice.words[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return twice


def _prepared(docs: DataFrame) -> DataFrame:
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), row)


def lost_keys(docs: DataFrame, least: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """What the second scan found of each row (doc_id, digest of the text, n_lines), and for each document that loses
    lines, the digests of their keys (doc_id, lost)."""
    rows = _prepared(docs).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    held = docs.sparkSession.sparkContext.broadcast(seen_twice(rows.where("doc_id is not null").select("doc_id", "text"), least))
    seen, _ = written(map_arrow(rows, _scan(held, least), "doc_id long, digest binary, n_lines long, found array<binary>"), "scanned")
    lines = seen.where("found is not null and doc_id is not null").select("doc_id", F.explode("found").alias("line")).distinct()
    least_doc = lines.groupBy("line").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")
    lost = lines.join(least_doc, "line").where("doc_id > least").groupBy("doc_id").agg(F.collect_list("line").alias("lost"))
    return seen, written(lost, "lost")[0]


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Drops the lines of docs (doc_id, text) that a document of a smaller doc_id holds too: a row for each row
    of docs with doc_id, n_lines (before), n_dropped, kept_sha256 (of the kept lines joined by line feeds).

    Lines are parted by line feeds alone; a null or empty text is one empty line. A line's key is the line without
    ASCII white space at both ends, A-Z in lower case. Keys of fewer than `least` code points stay. The first
    document keeps all its lines of a key. A row without a doc_id keeps all and takes nothing from others. Rows that
    repeat a doc_id are one document. Other columns are ignored. Keys are confirmed by SHA-256.
    """
    docs = docs.select("doc_id", "text")
    seen, lost = lost_keys(docs, least)
    same = seen.join(lost.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.lower(F.hex("digest")).alias("kept_sha256"))
    rows = _prepared(docs).select("doc_id", "text").join(lost, "doc_id")
    cut = map_arrow(rows.select(F.struct("doc_id").alias("row"), "text", "lost"), _cutter(least, False), "row struct<doc_id: long>, n_lines long, n_dropped long, kept string")
    return same.unionByName(cut.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256")))


def without_repeated_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """docs with their columns, in whose texts the lines that a smaller document holds too are gone; null texts stay null."""
    _, lost = lost_keys(docs.select("doc_id", "text"), least)
    rows = _prepared(docs).join(lost, "doc_id", "left")
    cut = map_arrow(rows.where("lost is not null").select("row", "text", "lost"), _cutter(least, True), rows.select("row").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string"))
    changed = cut.select(*[(F.when(F.col("row.text").isNotNull(), F.col("kept")) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
    return rows.where("lost is null").select("row.*").unionByName(changed)
